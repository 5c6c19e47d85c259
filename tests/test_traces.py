"""Row-level and scalar cases of the normalizer, and invariants of the operators."""

import itertools
import json
import math
import random
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tracelode.functions import parse
from tracelode.operators import normalize, ranks, severity, stats, transitions, views
from tracelode.plans import events
from tracelode.sources import traces as sources


def raw(spark, *steps):
    return spark.createDataFrame([("t1", None, "task", "h", "m", 1.0, "2", "3", "x", json.dumps(list(steps)))], sources.RAW)


def call(cmd, obs=None):
    return {"tools": [{"fn": "Bash", "cmd": cmd}], "obs": obs}


def test_unknown_and_no_tool_steps_are_left_out(spark):
    s = normalize.steps(raw(spark, {"msg": "thinking", "tools": None, "obs": None}, call("cat a.py", "x"), call("pytest", "passed")))
    t = transitions.transitions(views.view_steps(s, ["semantic_tool_tool_action_only"])).collect()
    assert [(r.current, r.next) for r in t] == [("read_file", "test")]


def test_artifacts_are_left_out(spark):
    s = normalize.steps(raw(spark, call("{json artifact}"), call("cat a.py"), call("pytest")))
    assert transitions.transitions(views.view_steps(s, ["semantic_tool_tool_action_only"])).count() == 1


@pytest.mark.parametrize("second, found", [("echo hello", []), ("cat src/a.py", ["file_path_from_output_to_next_arg"])])
def test_dependency_needs_later_use(spark, second, found):
    s = normalize.steps(raw(spark, call("grep foo .", "src/a.py: foo"), call(second)))
    assert [r.dependency_type for r in normalize.dependencies(s, normalize.objects(s)).collect()] == found


def test_large_observation(spark):
    o = normalize.objects(normalize.steps(raw(spark, call("cat a.py", "x" * 5001))))
    assert [r.stable_object for r in o.where("object_type = 'large_observation_bucket'").collect()] == [False]


def test_id_and_prefix(spark):
    o = normalize.objects(normalize.steps(raw(spark, call("cat src/pkg/a.py", "src/pkg/a.py"))))
    rows = o.where("object_type = 'file'").collect()
    assert {(r.object_id, r.object_prefix, r.object_dir, r.object_extension) for r in rows} == {("file:src/pkg/a.py", "src/pkg", "src/pkg", ".py")}
    assert sorted((r.derived_from_tool, r.derived_from_observation) for r in rows) == [(False, True), (True, False)]


def test_shuffle_breaks_order_and_keeps_labels(spark, sf_dir):
    rows = views.view_steps(events.steps(spark, sf_dir), ["semantic_tool_tool_action_only"])
    real = transitions.transitions(rows)
    for control in ("within_trace", "global_next"):
        got = transitions.shuffled(rows, control, 2)
        assert got.where("rep = 1").count() == real.count()
        key = lambda df: sorted(map(tuple, df.groupBy("current", "next").count().collect()))
        assert key(got.where("rep = 1")) != key(real)
    marginal = lambda df: sorted(map(tuple, df.groupBy("next").count().collect()))
    assert marginal(transitions.shuffled(rows, "global_next", 1)) == marginal(real)


def test_unreadable_page_fails(spark):
    spark.dataSource.register(sources.PagedTraces)
    df = spark.read.format("paged_traces").option("url", "http://127.0.0.1:9/rows").option("rows", 10).option("retries", 1).load()
    with pytest.raises(Exception, match="strict-real"):
        df.collect()


#: Commands and their tool groups.
CASES = [("grep -R foo .", "search"), ("search_dir foo src", "search"), ("cat src/app.py", "read_file"), ("open src/app.py", "read_file"), ("pytest tests/test_app.py", "test"), ("apply_patch <<'PATCH'\nPATCH", "edit"), ("sed -n '1,10p' src/app.py", "read_file"), ("sed -i 's/a/b/' src/app.py", "edit"), ("echo hello", "unknown"), ("echo hello > file.txt", "edit"), ("A=1 B=2 python -m pytest", "test"), ("bash -c 'ls -l'", "list_files"), ("sudo -n curl x", "retrieve"), ("go test ./...", "test"), ("npm test", "test"), ('cat "unclosed', "read_file")]


def test_tools_of_commands(spark):
    df = spark.createDataFrame(CASES, "cmd string, want string").withColumn("got", parse.tool_group(parse.shell("cmd", F.lit("bash"))["tool"]))
    assert [(r.cmd, r.got) for r in df.collect()] == CASES
    assert parse.explicit_write("echo hello > file.txt", "write_file") and not parse.explicit_write("echo hello", "echo")


def test_artifact_flag(spark):
    df = spark.createDataFrame([("{not a command}", True), ("cat file.txt", False), (None, True), (">>> x", True), ("x" * 4001, True)], "cmd string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", parse.artifact_flag(F.col("cmd"), F.lit("read_file"))).collect())


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, "see src/a.py, (lib/b.ts) and src/a.py; not a.pyc", parse.paths) == ["src/a.py", "lib/b.ts"]
    assert one(spark, "at https://x.org/a?b=1. and (http://y.z)", parse.urls) == ["https://x.org/a?b=1", "http://y.z"]
    assert one(spark, "FAILED tests/test_a.py::test_b, ok", parse.test_ids) == ["tests/test_a.py::test_b"]
    assert one(spark, 'File "/x/App.py", line 3, in f', parse.error_signature) == "traceback:App.py:line"
    assert one(spark, "ValueError: no", parse.error_signature) == "exception:ValueError"
    assert one(spark, "the job timed out", parse.error_signature) == "error:timeout"
    assert one(spark, "all good", parse.error_signature) is None
    assert one(spark, "run:\n```bash\nls\n$ cat x.py\n```", parse.fenced_command) == "cat x.py"
    assert one(spark, "  'Bash tool' ", parse.clean_name) == "bash"
    assert [one(spark, p, parse.object_dir) for p in ("a.py", "x/a.py", "/a.py", "x//y/./a.py")] == [".", "x", "/", "x/y"]
    assert [one(spark, p, parse.object_extension) for p in ("a/b.PY", ".bashrc", "x")] == [".py", "", ""]
    assert one(spark, "'/usr/bin/Grep'", parse.basename) == "grep"


def test_steps_take_every_form_of_call(spark):
    forms = [{"tool_calls": {"name": "sh", "command": "ls"}}, {"tool_call": "cat a.py"}, {"command": "grep x y", "tool_name": "Run"}, {"message": "```\npytest\n```", "role": "assistant"}, "plain text"]
    rows = normalize.steps(raw(spark, *forms)).orderBy("step_id").collect()
    assert [r.command_string for r in rows] == ["ls", "cat a.py", "grep x y", "pytest", None]
    assert [r.semantic_tool_clean for r in rows] == ["list_files", "read_file", "search", "test", "unknown"]
    assert [r.tool_wrapper for r in rows] == ["sh", "cat", "run", "unknown", "unknown"]


def test_bad_steps_make_no_rows(spark):
    df = spark.createDataFrame([("a", None, None, None, None, None, None, None, None, s) for s in (None, "", "not json", '{"a": 1}', "[]")], sources.RAW)
    assert normalize.steps(df).count() == 0 and normalize.traces(df, normalize.steps(df)).count() == 0


def test_unknown_view(spark, sf_dir):
    with pytest.raises(ValueError):
        views.view_steps(events.steps(spark, sf_dir), ["nothing"])


def test_sources_and_sinks(spark, tmp_path):
    file = tmp_path / "raw.jsonl"
    file.write_text(json.dumps({"trial_id": "a", "reward": 1, "steps": json.dumps([call("ls")])}) + "\n\n" + json.dumps({"trial_id": "b", "steps": json.dumps([call("cat x.py")])}) + "\n")
    df = sources.read_jsonl(spark, str(file))
    assert df.count() == 2 and sources.read_cached(df, 1).first().trial_id == "a"
    tables = normalize.normalize(df)
    sources.write_tables(tables, str(tmp_path / "out"))
    assert {k: spark.read.parquet(str(tmp_path / "out" / k)).count() for k in tables} == {"traces": 2, "steps": 2, "object_accesses": 1, "data_dependencies": 0}
    sources.write_tables({"t": tables["traces"]}, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "t")).count() == 2
    assert "| trace_id |" in sources.report("Report", {"traces": tables["traces"].select("trace_id")})


def test_unnamed_traces_stay_apart(spark):
    """Two equal traces without ids are two traces, each with its steps."""
    rows = [(None, None, "t", "h", "m", 1.0, "2", "3", "x", json.dumps([call("ls"), call("cat a.py")]))] * 2 + [("", "named", "t", "h", "m", 0.0, None, None, None, json.dumps([call("ls")]))]
    df = spark.createDataFrame(rows, sources.RAW)
    s = normalize.steps(df)
    assert sorted(r["count"] for r in s.groupBy("trace_id").count().collect()) == [1, 2, 2]
    t = normalize.traces(df, s).collect()
    assert sorted((r.total_steps, r.success) for r in t) == [(1, False), (2, True), (2, True)] and {r.dataset for r in t} == {"terminalbench"}


def test_metadata_of_a_run(spark, tmp_path):
    """Counts, rates and flags of a run as one JSON row; without steps all rates are 0."""
    df = raw(spark, call("cat a.py", "x"), {"msg": "no tool"}).union(spark.createDataFrame([("t2", *[None] * 8, "[]")], sources.RAW))
    s = normalize.steps(df)
    sources.write_tables({"metadata": normalize.quality_row(df, s, normalize.objects(s), source="cache", profile_mode="small")}, str(tmp_path), "json")
    r = spark.read.json(str(tmp_path / "metadata")).first()
    assert (r.num_traces, r.num_steps, r.num_tool_action_steps, r.num_object_accesses, r.skipped_rows, r.unknown_rate, r.command_parse_success_rate, r.source, r.profile_mode, r.used_mock) == (1, 2, 1, 1, 1, 0.5, 0.5, "cache", "small", False)
    none = df.limit(0)
    r = normalize.quality_row(none, normalize.steps(none), normalize.objects(normalize.steps(none))).first()
    assert (r.num_steps, r.unknown_rate, r.skipped_rows) == (0, 0.0, 0)


def test_p_values(spark):
    """Two-sided, with continuity and tie correction; against the definition."""
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(6) + (2 if g == "b" and f else 0)), f) for g in "ab" for f in (True, False) for _ in range(30)] + [("c", 1.0, True), ("c", 1.0, False), ("d", 1.0, True)]
    df = spark.createDataFrame(rows, "g string, x double, failed boolean")
    got = {r.g: r for r in stats.mann_whitney(df, ["g"], "x", "failed").collect()}
    for g in "ab":
        pos, neg = ([x for h, x, f in rows if h == g and f == want] for want in (True, False))
        u = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        both, n = pos + neg, len(pos) + len(neg)
        ties = sum(c**3 - c for c in Counter(both).values())
        sd = math.sqrt(len(pos) * len(neg) / 12 * (n + 1 - ties / (n * (n - 1))))
        p = math.erfc(max(0, abs(u - len(pos) * len(neg) / 2) - 0.5) / sd / math.sqrt(2))
        assert got[g].mannwhitney_u == u and abs(got[g].p_value - p) < 2e-6
    assert got["c"].p_value is None and got["d"].p_value is None
    x = [0.0, 0.1, 1.0, 2.5, 5.0]
    assert all(abs(r.y - math.erfc(r.x)) <= 2e-7 * math.erfc(r.x) for r in spark.createDataFrame([(v,) for v in x], "x double").withColumn("y", stats.erfc(F.col("x"))).collect())


def test_verdicts_have_three_values(spark):
    """Result tables made by hand: one hypothesis partly supported, one not, the others supported; and nothing to go by."""
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    view = severity.CLEAN[0]
    args = [
        table([(view, 3, 0.2), ("phase_all", 3, 0.9)], "view string, k int, delta double"), table([(view, 0.1)], "view string, low double"), table([(view, 0.04), (view, 0.9)], "view string, p double"),
        table([(True, 1), (False, 3)], "appears_in_heldout boolean, support_harnesses int"), table([("a", 5, 9.0)], "dependency_type string, count long, median_distance double"),
        table([("exact_object_id", b, h, r) for b, r in (("lastK_object", 0.5), ("random_same_count", 0.1), ("object_type_only", 0.0)) for h in (3, 5, 10)], "granularity string, baseline string, horizon int, recall double"),
        table([(3, "lastK", 0.1), (1, "early_markov", 0.9), (5, "early_markov", -0.1)], "k int, baseline string, delta_vs_best_metadata_baseline double"), table([("failure_loop_score", 0.2, 0.3)], "metric string, delta_failure_minus_success double, p_value double"),
    ]
    got = {r.hypothesis: r.verdict for r in severity.verdicts(*args).collect()}
    assert got == {"H1": "supported", "H2": "partially supported", "H3": "not supported", "H4": "supported", "H5": "partially supported", "H6": "partially supported"}
    assert {r.verdict for r in severity.verdicts(*[a.limit(0) for a in args]).collect()} == {"not supported"}
    costs = table([("predicted", 3.0), ("session_affinity", 2.0), ("wrong_prediction_stress", 1.0)], "strategy string, reduction_vs_independent double")
    for n, enough in ((4, True), (3, False)):
        r = severity.conclusion(table([(f"H{i}", "supported" if i < n else "not supported") for i in range(6)], "hypothesis string, verdict string"), costs).first()
        assert (r.supported, r.sufficient) == (n, enough)


def test_permuted_numbers(spark):
    """Every number of 0 ... n - 1 is taken once, for any n, and keys name different permutations."""
    sizes = [1, 2, 3, 5, 16, 17, 97, 255, 256, 1000, 4099]
    df = spark.createDataFrame([(n, i, k) for n in sizes for i in range(n) for k in (1, 2)], "n long, i long, k int")
    got = {}
    for r in transitions.permuted(df, "i", "n", "to", 7, "k").collect():
        got.setdefault((r.n, r.k), {})[r.i] = r.to
    assert all(sorted(x.values()) == list(range(n)) for (n, _), x in got.items())
    for n in (97, 1000, 4099):
        assert got[n, 1] != got[n, 2] and sum(i == x for i, x in got[n, 1].items()) < 12
        moved = [(x - i) % n for i, x in got[n, 1].items()]
        assert len(set(moved)) > 0.5 * n


def test_globally_shuffled_transitions(spark, sf_dir):
    """Each next label of the whole table is used once in each replicate; deltas lie about those of an ordinary shuffle."""
    rows = views.view_steps(events.steps(spark, sf_dir), ["semantic_tool_tool_action_only"])
    got = transitions.shuffled(rows, "global_next", 12)
    real = [(r.trace_id, r.current, r.next) for r in transitions.transitions(rows).collect()]
    out = got.collect()
    for rep in range(1, 13):
        own = [r for r in out if r.rep == rep]
        assert Counter(r.next for r in own) == Counter(x[2] for x in real) and Counter((r.trace_id, r.current) for r in own) == Counter(x[:2] for x in real)
    rng, plain = random.Random(2), []
    for rep in range(12):
        nexts = [x[2] for x in real]
        rng.shuffle(nexts)
        plain += [("semantic_tool_tool_action_only", rep, t, c, n) for (t, c, _), n in zip(real, nexts)]
    plain = spark.createDataFrame(plain, "view string, rep int, trace_id string, current string, next string")
    null = lambda df: [r.d for r in transitions.hits(*transitions.parts(df), ["view", "rep"], []).select(((F.col("cond_3") - F.col("glob_3")) / F.col("n")).alias("d")).collect()]
    some, full = null(got), null(plain)
    mean = lambda x: sum(x) / len(x)
    spread = math.sqrt(sum((x - mean(full)) ** 2 for x in full) / len(full))
    assert len(some) == len(full) == 12 and abs(mean(some) - mean(full)) < 2 * spread + 1e-3


def test_controls_are_counted_once(spark, sf_dir):
    """What compares the controls reads stored counts: its plan, which the driver holds whole, makes no replicate and no transitions again."""
    rows = views.view_steps(events.steps(spark, sf_dir), ["semantic_tool_tool_action_only"])
    found = transitions.permutation_test(rows, replicates=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "lead(" not in plan
    assert sorted(r.control for r in found.collect()) == ["global_next", "within_trace"]


def test_shuffled_rows_keep_what_their_trace_has(spark, sf_dir):
    rows = views.view_steps(events.steps(spark, sf_dir), ["semantic_tool_tool_action_only"]).withColumn("own", F.concat("trace_id", F.lit("!")))
    for control in ("within_trace", "global_next"):
        got = transitions.shuffled(rows, control, 2)
        assert got.columns == ["view", "rep", "trace_id", "current", "next", "own"] and got.where("own <> concat(trace_id, '!')").count() == 0
        assert got.groupBy("rep").count().where(F.col("count") == transitions.transitions(rows).count()).count() == 2


def test_bootstrap_draws(spark):
    """Each replicate draws exactly as many traces as there are, some several times; an interval of a ratio lies about it; a trace in chunks counts as one."""
    rows = [(f"t{i}", s, float(i % 7), 1.0) for i in range(60) for s in range(3)]
    df = spark.createDataFrame(rows, "trace_id string, step_id int, x double, one double")
    per = df.groupBy("trace_id").agg(F.sum("x").alias("x"), F.sum("one").alias("one")).withColumn("g", F.lit(1))
    got = transitions.resampled(per, ["g"], ["x", "one"], draws=40).collect()
    assert len(got) == 40 and all(r.drawn == 60 and r.one == 180 for r in got) and len({r.x for r in got}) > 20
    partial = lambda t: {"x": sum(t.column("x").to_pylist()), "one": float(t.num_rows)}
    both = [transitions.bootstrap_by_trace(df, partial, ["x", "one"], F.col("x") / F.col("one"), chunk=c).first() for c in (100_000, 2)]
    assert both[0] == both[1] and both[0].low < sum(x for _, _, x, _ in rows) / len(rows) < both[0].high
    assert transitions.bootstrap_by_trace(df.limit(0), partial, ["x", "one"], F.col("x") / F.col("one")).collect() == []


def test_ranks_below_and_quantiles(spark):
    """Against sorted lists: negative numbers, both zeros, infinities, NaN, nulls, very close and very large whole numbers, groups that are null."""
    rng = random.Random(6)
    values = {"a": [rng.gauss(0, 1) for _ in range(200)] + [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324], "b": [1e9 + i * 1e-6 for i in range(50)] * 2, None: [3.0, 3.0], "c": [float("inf"), float("-inf"), 2.0, 2.0]}
    df = spark.createDataFrame([(g, x) for g, v in values.items() for x in v], "g string, x double")
    n = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    got = ranks.below(n, ["g"], "x").collect()
    assert len(got) == n.count()
    assert all(r.below == sum(v < r.x for v in values[r.g]) for r in got)
    q = {r.g: r for r in ranks.quantiles(df.union(df.limit(1).select("g", F.lit(None).cast("double"))).union(spark.createDataFrame([("d", None)], "g string, x double")), ["g"], "x", {"low": 0.0, "q1": 0.25, "mid": 0.5, "high": 1.0}).collect()}
    for g in ("a", "b", None):
        v = sorted(values[g])
        for name, p in (("low", 0.0), ("q1", 0.25), ("mid", 0.5), ("high", 1.0)):
            h = p * (len(v) - 1)
            want = v[math.floor(h)] + (h - math.floor(h)) * (v[math.ceil(h)] - v[math.floor(h)])
            assert math.isclose(q[g][name], want, rel_tol=1e-12, abs_tol=1e-300)
    assert q["d"].mid is None and q["c"].mid == 2.0
    whole = [2**62, 2**62 + 1, 2**62 + 3, -(2**62)]
    n = spark.createDataFrame([(1, x, 1) for x in whole], "g int, x long, n int")
    assert {r.x: r.below for r in ranks.below(n, ["g"], "x").collect()} == {x: sum(y < x for y in whole) for x in whole}


def test_exact_p_of_small_samples(spark):
    """Against all orders; with a tie or two large samples it is the normal p."""
    rng = random.Random(5)
    rows = []
    for g, (m, n) in enumerate([(1, 1), (2, 3), (3, 5), (8, 4), (5, 5), (1, 9)]):
        x = rng.sample(range(1000), m + n)
        rows += [(g, float(v), i < m) for i, v in enumerate(x)]
    rows += [(10, float(v), i < 9) for i, v in enumerate(rng.sample(range(1000), 18))] + [(11, v, f) for v, f in ((1.0, True), (2.0, True), (2.0, False), (3.0, False))]
    got = {r.g: r for r in stats.mann_whitney(spark.createDataFrame(rows, "g int, x double, f boolean"), ["g"], "x", "f").collect()}
    for g in range(6):
        pos, neg = ([x for h, x, f in rows if h == g and f == want] for want in (True, False))
        u_of = lambda a, b: sum(x > y for x in a for y in b)
        both = sorted(pos + neg)
        every = [u_of(c, [x for x in both if x not in c]) for c in itertools.combinations(both, len(pos))]
        u = u_of(pos, neg)
        p = min(1.0, 2 * min(sum(x <= u for x in every), sum(x >= u for x in every)) / len(every))
        assert got[g].mannwhitney_u == u and abs(got[g].p_value - p) < 1e-6
    for g in (10, 11):
        pos, neg = ([x for h, x, f in rows if h == g and f == want] for want in (True, False))
        n, ties = len(pos) + len(neg), sum(c**3 - c for c in Counter(x for h, x, _ in rows if h == g).values())
        sd = math.sqrt(len(pos) * len(neg) / 12 * (n + 1 - ties / (n * (n - 1))))
        p = math.erfc(max(0, abs(got[g].mannwhitney_u - len(pos) * len(neg) / 2) - 0.5) / sd / math.sqrt(2))
        assert abs(got[g].p_value - p) < 2e-6
    assert stats.orders_up_to(8, 5000, 20) == stats.orders_up_to(5000, 8, 20) and stats.orders_up_to(4, 4, 16) == math.comb(8, 4)


def test_values_of_a_step_keep_their_types(spark):
    """Texts that look empty are commands; numbers, false, blanks and empty lists are not; calls may be texts."""
    cases = [
        ({"cmd": "0"}, "unknown", "0"), ({"cmd": 0, "command": "ls"}, "unknown", "ls"), ({"cmd": "false"}, "unknown", "false"), ({"cmd": False, "args": "ls"}, "unknown", "ls"), ({"cmd": [], "input": {}, "args": "x"}, "unknown", "x"), ({"cmd": "[]"}, "unknown", "[]"),
        ({"cmd": 0.0, "command": -0.0, "input": 7}, "unknown", "7"), ({"tool_calls": "ls -l"}, "ls", "ls -l"), ({"tools": ["  "], "cmd": "ls"}, "unknown", "ls"), ({"tools": [" cat x "]}, "cat", "cat x"), ({"tools": "[x] y"}, "[x]", "[x] y"), ({"tools": [0], "cmd": "ls"}, "unknown", "ls"),
        ({"tools": [None], "tool_calls": [{"name": "Run", "args": {"a": 1}}]}, "run", '{"a":1}'), ({"tools": [], "tool_call": {"fn": "", "name": "Go", "cmd": None, "input": "go test"}}, "go", "go test"), ({"tools": [{"fn": 5, "cmd": "ls"}]}, "5", "ls"), ({"name": "Bash", "message": "```\r\nls\r\n\t$  pwd \t\r\n```"}, "bash", "pwd"),
        ({"message": "```sh \n\n  a b\x0bc d\u2028e\n```"}, "unknown", "e"), ({"message": "```\n\t\n```"}, "unknown", None), ({"msg": 0, "message": "", "content": "hi"}, "unknown", None), ({"cmd": "  "}, "unknown", "  "),
    ]
    got = normalize.steps(raw(spark, *[c[0] for c in cases])).orderBy("step_id").collect()
    assert [(r.tool_wrapper, r.command_string) for r in got] == [c[1:] for c in cases]
    odd = spark.createDataFrame([("t1", None, "t", "h", "m", 1.0, "2", "3", "x", s) for s in ('[{"cmd": "a", "cmd": "b"}, "text", 7, null, ["x"]]', '["{\\"cmd\\": \\"ls\\"}", 1]', ' [{"role": "user", "time": 12}]')], sources.RAW)
    rows = normalize.steps(odd).select("row_hash", "step_id", "command_string", "message_len_chars", "role", "timestamp").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.step_id):
        by.setdefault(r.row_hash, []).append(tuple(r)[2:])
    assert sorted(by.values(), key=len) == [[(None, 0, "user", "12")], [(None, 13, None, None), (None, 1, None, None)], by[max(by, key=lambda h: len(by[h]))]]
    assert len(max(by.values(), key=len)) == 5


def test_rows_of_one_id_keep_their_own_counts(spark):
    """Raw rows with the same id each count their own steps; equal ones too."""
    make = lambda n: ("t1", None, "t", "h", "m", 1.0, "2", "3", "x", json.dumps([call("ls")] * n))
    df = spark.createDataFrame([make(1), make(3), make(3)], sources.RAW)
    t = normalize.traces(df, normalize.steps(df)).collect()
    assert sorted((r.total_steps, r.tool_action_steps) for r in t) == [(1, 1), (3, 3), (3, 3)]


#: The objects that the steps below access: (step, id, type, access, prefix, folder, extension, stable), by hand.
ACCESSES = [
    (0, "file:src/pkg/a.py", "file", "read", "src/pkg", "src/pkg", ".py", True), (0, "url:https://x.org/a", "url", "retrieve", "https:/x.org", "https:/x.org", "", True), (1, "file:README.md", "file", "mention", "README.md", ".", ".md", True),
    (2, "test:tests/test_a.py::test_b", "test_case", "execute", "tests/test_a.py::test_b", "tests", ".py::test_b", True), (2, "file:tests/test_a.py", "file", "execute", "tests/test_a.py", "tests", ".py", True),
    (3, "large_observation_bucket", "large_observation_bucket", "mention", None, None, None, False), (3, "error:error:timeout", "error_signature", "error", None, None, None, True),
]


def test_objects_of_steps(spark):
    listed = [call("cat src/pkg/a.py https://x.org/a"), {"message": "run\n```bash\nls\n```", "output": "README.md"}, call("pytest tests/test_a.py::test_b"), call("sleep 9", "x" * 4001 + " timed out")]
    o = normalize.objects(normalize.steps(raw(spark, *listed)))
    got = o.select("step_id", "object_id", "object_type", "access_type", "object_prefix", "object_dir", "object_extension", "stable_object").collect()
    assert sorted(map(tuple, got), key=str) == sorted(ACCESSES, key=str)


class Server:
    """Rows of a paged source over HTTP; pages at or beyond `broken` fail. Every fifth row has no steps."""

    def __init__(self, n):
        self.asked, self.broken, outer = [], None, self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
                outer.asked.append(q["offset"])
                if outer.broken is not None and q["offset"] >= outer.broken:
                    self.send_error(500)
                    return
                rows = [{"row": {"trial_id": f"r{i}", "reward": i % 2, "steps": "null" if i % 5 == 0 else json.dumps([call("ls")])}} for i in range(q["offset"], min(n, q["offset"] + q["length"]))]
                body = json.dumps({"rows": rows}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/rows"


def test_paged_load_goes_on_after_a_failure(spark, tmp_path):
    """A load that fails half-way, a partial answer, and the rest of the load: no row is lost or read twice; then the cache alone answers."""
    server, cache = Server(60), str(tmp_path / "cache")
    options = {"rows": 60, "page": 5, "batch": 2, "retries": 1}
    ids = lambda df: sorted(int(r.trial_id[1:]) for r in df.collect())
    want = [i for i in range(60) if i % 5]
    server.broken = 0
    with pytest.raises(RuntimeError, match="strict-real"):
        sources.load_traces(spark, server.url, 48, cache, partial=True, **options)  # nothing is cached
    server.broken = 30
    with pytest.raises(RuntimeError, match="strict-real"):
        sources.load_traces(spark, server.url, 48, cache, **options)
    some, said = sources.load_traces(spark, server.url, 48, cache, partial=True, **options)
    assert ids(some) == [i for i in want if i < 30] and "partial_load_error" in said
    server.broken, server.asked = None, []
    df, said = sources.load_traces(spark, server.url, 48, cache, **options)
    assert ids(df) == want and said == {} and sorted(server.asked) == list(range(30, 60, 5))
    server.asked = []
    assert len(ids(sources.load_traces(spark, server.url, 10, cache, **options)[0])) == 10 and not server.asked
    few, _ = sources.load_traces(spark, server.url, 12, str(tmp_path / "other"), **options)  # ends as soon as there are enough
    assert len(ids(few)) == 12 and max(server.asked) < 40


def test_sets_of_tables_appear_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "set")
    one = spark.createDataFrame([(i, f"x{i}", [i]) for i in range(20)], "a int, b string, c array<int>").repartition(4)
    none = one.limit(0)
    sources.write_set({"one": one, "none": none}, folder)
    read = lambda name: sorted(tuple(r) for r in sources.read_set(spark, folder, name).collect())
    assert read("one") == sorted(tuple(r) for r in one.collect()) and read("none") == [] and sources.read_set(spark, folder, "none").dtypes == one.dtypes
    bad = one.withColumn("a", F.when(F.col("a") == 19, F.raise_error(F.lit("stop"))).otherwise(F.col("a")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        sources.write_set({"one": one.where("a < 5"), "none": bad}, folder)
    assert len(read("one")) == 20 and read("none") == []
    runs = list((tmp_path / "set" / "runs").iterdir())
    assert len(runs) == 1
    sources.write_set({"one": one.where("a < 5")}, folder)
    assert len(read("one")) == 5 and len(list((tmp_path / "set" / "runs").iterdir())) == 1
    with pytest.raises(ValueError):
        read("none")


def test_three_reports(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    view = "semantic_tool_tool_action_only"
    args = [
        table([(7, True, False)], "num_traces int, strict_real boolean, used_mock boolean"), table([(view, 3, 0.25), (view, 1, 0.9)], "view string, k int, delta double"), table([(view, 0.1, 0.4)], "view string, low double, high double"),
        table([("a", 5, 3.0), ("b", 2, 5.0)], "dependency_type string, count long, median_distance double"), table([("failure_loop_score", 0.0123)], "metric string, p_value double"), table([("H1", "supported")], "hypothesis string, verdict string"),
        table([("predicted", 30.0), ("session_affinity", 20.0)], "strategy string, reduction_vs_independent double"), table([("the problem exists",)], "conclusion string"),
    ]
    got = sources.run_reports(*args, command="run it")
    assert set(got) == {"problem_existence_report", "problem_existence_audit", "limitations"}
    text = got["problem_existence_report"]
    for want in ("0.25, interval [0.1, 0.4]", "7 dependencies", "distances 4", "p = 0.0123", "saves 30, session affinity 20, wrong predictions none", "the problem exists", "| H1 | supported |"):
        assert want in text, want
    assert "`run it`" in got["problem_existence_audit"] and got["limitations"].count("\n- ") == 5
    none = sources.run_reports(*[a.limit(0) for a in args])
    assert "0 dependencies" in none["problem_existence_report"] and "p = none" in none["problem_existence_report"]


def test_paths_get_the_default_file_system(spark):
    """A bare path is completed as Spark would, so Python workers open the same place."""
    from tracelode.sources.shared import arrow_fs, qualified

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.c.link./ckpt", "file:///tmp")
    conf.set("fs.defaultFS", "viewfs://c/")
    try:
        assert qualified(spark, "/ckpt/a") == "viewfs://c/ckpt/a" and qualified(spark, "file:///ckpt/a") == "file:/ckpt/a"
    finally:
        conf.set("fs.defaultFS", before)
    assert qualified(spark, "/ckpt") == "file:/ckpt" and arrow_fs("file:/ckpt/a")[1] == arrow_fs("/ckpt/a")[1] == arrow_fs("file:///ckpt/a")[1] == "/ckpt/a"
