"""Queries over the driver's tables, one or more for each group of operators, and SQL for each."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import dependencies, early, failure, motifs, normalize, ranks, severity, stats, transitions, views, working_set
from ..sources.shared import stored
from . import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_STEPS = """e AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
steps AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step_id, event_id, k, event_type AS tool,
  CASE WHEN event_type IN ('view', 'click') THEN 'explore/read' WHEN event_type = 'signup' THEN 'edit/write' WHEN event_type = 'purchase' THEN 'execute/test' ELSE 'unknown' END AS phase,
  CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'bash' END AS wrapper, event_type <> 'error' AS act, event_type <> 'error' AND event_id % 11 <> 0 AND event_id % 13 <> 0 AS real_act FROM e),
traces AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS trace_id, CAST(user_id % 5 AS VARCHAR) AS task_id, CAST(user_id % 3 AS VARCHAR) AS harness, user_id % 2 = 0 AS success, user_id * 10.0 AS input_tokens FROM events)"""
_VIEWS = """uncollapsed AS (
  SELECT 'wrapper_tool_all' AS view, trace_id, step_id, wrapper AS label FROM steps
  UNION ALL SELECT 'semantic_tool_all', trace_id, step_id, tool FROM steps
  UNION ALL SELECT 'semantic_tool_no_unknown', trace_id, step_id, tool FROM steps WHERE lower(tool) NOT IN ('unknown', 'none', '', 'nan')
  UNION ALL SELECT unnest(['semantic_tool_tool_action_only', 'collapsed_semantic_tool_tool_action_only']), trace_id, step_id, tool FROM steps WHERE real_act
  UNION ALL SELECT 'phase_all', trace_id, step_id, phase FROM steps
  UNION ALL SELECT unnest(['phase_clean_tool_action_only', 'collapsed_phase_clean_tool_action_only']), trace_id, step_id, phase FROM steps WHERE real_act AND phase <> 'unknown'),
views AS (SELECT view, trace_id, step_id, label FROM (SELECT *, lag(label) OVER (PARTITION BY view, trace_id ORDER BY step_id) AS b FROM uncollapsed) WHERE view NOT LIKE 'collapsed%' OR b IS NULL OR b <> label),
trans AS (SELECT * FROM (SELECT view, trace_id, step_id, label AS current, lead(label) OVER (PARTITION BY view, trace_id ORDER BY step_id) AS next FROM views) WHERE next IS NOT NULL)"""
_DRAW = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
_PART = _DRAW.format("'7|' || trace_id") + " % 1000"
_OBJECTS = """objects AS (
  SELECT trace_id, step_id, 'file:k' || k AS object_id, 'file' AS object_type, 'p' || (k // 10) AS object_prefix, tool IN ('signup', 'purchase') AS by_tool, tool NOT IN ('signup', 'purchase') AS by_obs FROM steps WHERE k IS NOT NULL
  UNION ALL SELECT trace_id, step_id, 'error:e' || (k % 5), 'error_signature', NULL, false, true FROM steps WHERE tool = 'error'
  UNION ALL SELECT trace_id, step_id, 'test:t' || (k % 3), 'test_case', 't' || (k % 3), false, true FROM steps WHERE tool = 'view' AND k < 10)"""
_DEPS = """deps AS (SELECT DISTINCT a.trace_id, a.step_id AS src_step_id, b.step_id AS dst_step_id, 'file_path_from_output_to_next_arg' AS dependency_type, s.tool AS src_tool, d.tool AS dst_tool, a.object_id, a.object_type AS value_type, CASE WHEN b.step_id - a.step_id = 1 THEN 'high' ELSE 'medium' END AS confidence
  FROM objects a JOIN objects b ON a.trace_id = b.trace_id AND a.object_id = b.object_id AND b.step_id > a.step_id AND b.step_id <= a.step_id + 10 JOIN steps s ON s.trace_id = a.trace_id AND s.step_id = a.step_id JOIN steps d ON d.trace_id = b.trace_id AND d.step_id = b.step_id WHERE a.by_obs AND b.by_tool)"""
_ACC = """acc AS (SELECT 'exact_object_id' AS granularity, trace_id, step_id, object_id AS item FROM objects WHERE object_id LIKE 'file:%' UNION ALL SELECT 'path_prefix', trace_id, step_id, object_prefix FROM objects WHERE object_prefix IS NOT NULL UNION ALL SELECT 'object_type', trace_id, step_id, object_type FROM objects),
reuse AS (SELECT granularity, trace_id, step_id - lag(step_id) OVER (PARTITION BY granularity, trace_id, item ORDER BY step_id) AS distance FROM acc)"""
_S, _V, _O = f"WITH {_STEPS}", f"WITH {_STEPS}, {_VIEWS}", f"WITH {_STEPS}, {_OBJECTS}"
_D, _A = f"{_O}, {_DEPS}", f"{_O}, {_ACC}"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _views(spark, d, names=None):
    return views.view_steps(events.steps(spark, d), names)


@query("d1_d8_step_views", f"{_V} SELECT view, trace_id, step_id, label FROM views")
def d_views(spark, d):
    return _views(spark, d)


@query("e1_e2_transitions", f"{_V} SELECT view, trace_id, step_id, current, next FROM trans")
def e1(spark, d):
    return transitions.transitions(_views(spark, d))


@query("e3_split", f"{_S} SELECT trace_id, CASE WHEN {_PART} < 700 THEN 'train' ELSE 'test' END AS part FROM traces")
def e3(spark, d):
    return transitions.split(events.traces(spark, d))


_HITS = f"""pairs AS (SELECT view, current, next, count(*) AS n FROM trans WHERE {_PART} < 700 GROUP BY ALL),
cond AS (SELECT *, row_number() OVER (PARTITION BY view, current ORDER BY n DESC, next) AS r FROM pairs),
overall AS (SELECT view, next, row_number() OVER (PARTITION BY view ORDER BY sum(n) DESC, next) AS g FROM pairs GROUP BY view, next),
test AS (SELECT t.view, t.trace_id, t.current, t.next, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.view = t.view AND p.current = t.current) THEN c.r ELSE g.g END AS r, g.g FROM trans t LEFT JOIN cond c ON c.view = t.view AND c.current = t.current AND c.next = t.next LEFT JOIN overall g ON g.view = t.view AND g.next = t.next WHERE {_PART.replace("trace_id", "t.trace_id")} >= 700)"""


@query("e4_e5_recall", f"{_V}, {_HITS} SELECT view, k, count(*) AS test_transitions, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0 END), 6) AS cond_recall, round(avg(CASE WHEN g <= k THEN 1.0 ELSE 0 END), 6) AS glob_recall, round((count(*) FILTER (r <= k) - count(*) FILTER (g <= k)) / count(*), 6) AS delta FROM test, (SELECT unnest([1, 3, 5]) AS k) GROUP BY view, k")
def e5(spark, d):
    return transitions.recall(transitions.transitions(_views(spark, d)))


@query("e6_recall_by_trace", f"{_V}, {_HITS} SELECT view, trace_id, count(*) AS n, count(*) FILTER (r <= 3) AS cond_3, count(*) FILTER (g <= 3) AS glob_3 FROM test GROUP BY view, trace_id")
def e6(spark, d):
    return transitions.hits(*transitions.parts(transitions.transitions(_views(spark, d))), ["view"], ["trace_id"]).select("view", "trace_id", "n", "cond_3", "glob_3")


_LONG_DRAW = "CAST(('0x' || substr(md5({}), 1, 15)) AS BIGINT)"


@query("e8_bootstrap", f"""{_V}, {_HITS}, st AS (SELECT view, trace_id, count(*) AS n, count(*) FILTER (r <= 3) - count(*) FILTER (g <= 3) AS gain FROM test GROUP BY view, trace_id),
num AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY md5(trace_id)) - 1 AS i, count(*) OVER (PARTITION BY view) AS total FROM st),
pick AS (SELECT view, rep, {_LONG_DRAW.format("'7|draw|' || rep || '|' || i")} % total AS i FROM num, (SELECT unnest(range(1, 31)) AS rep)),
y AS (SELECT p.view, p.rep, sum(gain) / nullif(sum(n), 0) AS delta FROM pick p JOIN num ON num.view = p.view AND num.i = p.i GROUP BY p.view, p.rep)
SELECT view, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high FROM y GROUP BY view""")
def e8(spark, d):
    return transitions.bootstrap(transitions.transitions(_views(spark, d)))


@query("e9_e10_entropy", f"""{_V}, p AS (SELECT view, current, next, count(*) AS n FROM trans GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY view) AS total, sum(n) OVER (PARTITION BY view, current) AS f, sum(n) OVER (PARTITION BY view, next) AS g FROM p)
SELECT view, CAST(max(total) AS BIGINT) AS transitions, round(sum(-n / total * log2(g / total)), 6) AS h_next, round(sum(-n / total * log2(n / f)), 6) AS h_next_given_current, round(sum(-n / total * log2(g / total)) - sum(-n / total * log2(n / f)), 6) AS mutual_information FROM t GROUP BY view""")
def e9(spark, d):
    return transitions.entropy(transitions.transitions(_views(spark, d)))


def _mean_of_purchases(table: pa.Table) -> dict[str, float]:
    """Sums of one trace's rows: of values of purchases, and how many there are."""
    bought = pc.equal(table.column("event_type"), "purchase")
    return {"value": pc.sum(pc.if_else(bought, table.column("value"), 0.0)).as_py(), "n": float(pc.sum(pc.cast(bought, pa.int64())).as_py())}


@query("l2_bootstrap_by_trace", f"""WITH t AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS value, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY user_id),
num AS (SELECT *, row_number() OVER (ORDER BY md5(trace_id)) - 1 AS i, count(*) OVER () AS total FROM t),
pick AS (SELECT rep, {_LONG_DRAW.format("'7|draw|' || rep || '|' || i")} % total AS i FROM num, (SELECT unnest(range(1, 51)) AS rep)),
y AS (SELECT rep, sum(value) / nullif(sum(n), 0) AS mean FROM pick JOIN num USING (i) GROUP BY rep)
SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM y""")
def l2(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").alias("step_id"), "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    return transitions.bootstrap_by_trace(e, _mean_of_purchases, ["value", "n"], F.col("value") / F.nullif("n", F.lit(0.0)))


_PAIR = ["semantic_tool_tool_action_only", "phase_clean_tool_action_only", "collapsed_semantic_tool_tool_action_only"]
_IN_PAIR = "(" + ", ".join(f"'{v}'" for v in _PAIR) + ")"




def _feistel_sql(walks: int) -> str:
    """Tables gp0, gp1, ...: numbers that have left the rows so often go through the network again; gx has them all."""
    network, x = [], "x"
    draw = lambda r, half: _LONG_DRAW.format(f"'1007|' || rep || '|{r}|' || {half}")
    for w in range(walks):
        of = "(SELECT ga.view, rep, next, total, i AS x, CAST(ceil(sqrt(total)) AS BIGINT) AS a FROM ga, reps)" if w == 0 else f"(SELECT view, rep, next, total, x, a FROM gp{w - 1} WHERE x >= total)"
        network.append(f"""gp{w} AS MATERIALIZED (SELECT view, rep, next, total, a, l * b + r AS x FROM (SELECT * REPLACE ((r + {draw(3, "l")}) % b AS r) FROM (SELECT * REPLACE ((l + {draw(2, "r")}) % a AS l) FROM (SELECT * REPLACE ((r + {draw(1, "l")}) % b AS r) FROM (SELECT * REPLACE ((l + {draw(0, "r")}) % a AS l)
  FROM (SELECT *, x // b AS l, x % b AS r FROM (SELECT *, (total + a - 1) // a AS b FROM {of})))))))""")
    return ",\n".join(network) + ",\ngx AS (" + " UNION ALL ".join(f"SELECT view, rep, next, x FROM gp{w} WHERE x < total" for w in range(walks)) + "),"


_FEISTEL = _feistel_sql(6)


@query("e11_e12_e15_permutation_test", f"""{_V}, reps AS (SELECT CAST(unnest(range(1, 26)) AS INT) AS rep),
wl AS (SELECT view, trace_id, label, rep, row_number() OVER (PARTITION BY view, trace_id, rep ORDER BY md5('1007|' || rep || '|' || trace_id || '|' || step_id)) AS i FROM views, reps WHERE view IN {_IN_PAIR}),
wt AS (SELECT * FROM (SELECT view, 'within_trace' AS control, rep, trace_id, label AS current, lead(label) OVER (PARTITION BY view, trace_id, rep ORDER BY i) AS next FROM wl) WHERE next IS NOT NULL),
ga AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY md5(trace_id || '|' || step_id)) - 1 AS i, count(*) OVER (PARTITION BY view) AS total FROM trans WHERE view IN {_IN_PAIR}),
{_FEISTEL}
allr AS (SELECT view, 'observed' AS control, 0 AS rep, trace_id, current, next FROM trans WHERE view IN {_IN_PAIR} UNION ALL SELECT * FROM wt UNION ALL SELECT a.view, 'global_next', b.rep, a.trace_id, a.current, b.next FROM ga a JOIN gx b ON a.view = b.view AND a.i = b.x),
pairs AS (SELECT view, control, rep, current, next, count(*) AS n FROM allr WHERE {_PART} < 700 GROUP BY ALL), cond AS (SELECT *, row_number() OVER (PARTITION BY view, control, rep, current ORDER BY n DESC, next) AS r FROM pairs),
overall AS (SELECT view, control, rep, next, row_number() OVER (PARTITION BY view, control, rep ORDER BY sum(n) DESC, next) AS g FROM pairs GROUP BY view, control, rep, next), known AS (SELECT DISTINCT view, control, rep, current FROM pairs),
test AS (SELECT t.view, t.control, t.rep, CASE WHEN k.current IS NOT NULL THEN c.r ELSE g.g END AS r, g.g FROM allr t LEFT JOIN known k ON k.view = t.view AND k.control = t.control AND k.rep = t.rep AND k.current = t.current LEFT JOIN cond c ON c.view = t.view AND c.control = t.control AND c.rep = t.rep AND c.current = t.current AND c.next = t.next LEFT JOIN overall g ON g.view = t.view AND g.control = t.control AND g.rep = t.rep AND g.next = t.next WHERE {_PART.replace("trace_id", "t.trace_id")} >= 700),
d AS (SELECT view, control, rep, (count(*) FILTER (r <= 3) - count(*) FILTER (g <= 3)) / count(*) AS d FROM test GROUP BY ALL), o AS (SELECT view, d AS observed FROM d WHERE control = 'observed')
SELECT view, control, round(max(observed), 6) AS observed, round(avg(d), 6) AS null_mean, round((count(*) FILTER (round(d, 9) >= round(observed, 9)) + 1) / (count(*) + 1), 6) AS p FROM d JOIN o USING (view) WHERE control <> 'observed' GROUP BY view, control""")
def e12(spark, d):
    return transitions.permutation_test(stored(_views(spark, d, _PAIR), "permutation-views"))  # three controls share them


@query("e11_within_trace_shuffle", f"""{_V}, r AS (SELECT view, trace_id, label, rep, row_number() OVER (PARTITION BY view, trace_id, rep ORDER BY md5('1007|' || rep || '|' || trace_id || '|' || step_id)) AS i FROM views, (SELECT unnest([1, 2]) AS rep) WHERE view = 'semantic_tool_tool_action_only')
SELECT rep, current, next, count(*) AS n FROM (SELECT rep, label AS current, lead(label) OVER (PARTITION BY trace_id, rep ORDER BY i) AS next FROM r) WHERE next IS NOT NULL GROUP BY ALL""")
def e11(spark, d):
    return transitions.shuffled(_views(spark, d, _PAIR[:1]), "within_trace", 2).groupBy("rep", "current", "next").agg(F.count("*").alias("n"))


@query("e13_transition_matrix", f"{_V} SELECT view, current, next, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY view, current), 6) AS p FROM trans GROUP BY view, current, next")
def e13(spark, d):
    return transitions.matrix(transitions.transitions(_views(spark, d)))


@query("f1_f7_motifs", f"""{_V}, {_OBJECTS}, c AS (SELECT CASE WHEN view LIKE '%phase%' THEN 'phase' ELSE 'tool' END AS kind, trace_id, list(label ORDER BY step_id) AS seq FROM views WHERE view LIKE 'collapsed%' GROUP BY view, trace_id),
o AS (SELECT trace_id, list(object_type || '_object' ORDER BY step_id, object_type, object_id) AS objs FROM objects GROUP BY trace_id),
s AS (SELECT * FROM c UNION ALL SELECT 'stateflow', c.trace_id, CASE WHEN objs IS NULL THEN seq[1:80] ELSE list_concat(seq, objs[1:least(50, greatest(1, len(seq) // 2))])[1:100] END FROM c LEFT JOIN o USING (trace_id) WHERE kind = 'tool'),
g AS (SELECT DISTINCT kind, trace_id, n, array_to_string(seq[i : i + n - 1], ' -> ') AS motif FROM (SELECT *, unnest(range(1, len(seq) - n + 2)) AS i FROM s, (SELECT CAST(unnest([2, 3, 4, 5]) AS INT) AS n))),
m AS (SELECT kind, n, motif, count(*) FILTER ({_PART} < 700) AS support_traces, count(*) FILTER ({_PART} >= 700) AS heldout_support, count(DISTINCT task_id) AS support_tasks, count(DISTINCT harness) AS support_harnesses, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM g JOIN traces USING (trace_id) GROUP BY kind, n, motif)
SELECT *, heldout_support > 0 AS appears_in_heldout FROM m WHERE support_traces > 0 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY support_traces DESC, motif) <= 100""")
def f(spark, d):
    s = motifs.sequences(events.steps(spark, d), events.objects(spark, d))
    return motifs.motifs(s, events.traces(spark, d))


def _deps(spark, d):
    return normalize.dependencies(events.steps(spark, d), events.objects(spark, d))


@query("c12_c13_dependencies", f"{_D} SELECT * FROM deps")
def c12(spark, d):
    return _deps(spark, d)


@query("g1_dependency_summary", f"{_D} SELECT dependency_type, count(*) AS count, count(DISTINCT trace_id) AS traces, median(dst_step_id - src_step_id) AS median_distance, round(count(*) / (SELECT count(*) FROM traces), 6) AS per_trace FROM deps GROUP BY dependency_type")
def g1(spark, d):
    return dependencies.summary(_deps(spark, d), events.traces(spark, d))


@query("g2_tool_pairs", f"{_D} SELECT src_tool, dst_tool, dependency_type, count(*) AS count FROM deps GROUP BY ALL")
def g2(spark, d):
    return dependencies.tool_pairs(_deps(spark, d))


@query("g3_top_patterns", f"{_D} SELECT src_tool, dst_tool, dependency_type, count(*) AS count FROM deps GROUP BY ALL ORDER BY count DESC, 1, 2, 3 LIMIT 100")
def g3(spark, d):
    return dependencies.top_pairs(_deps(spark, d))


@query("g4_horizons", f"{_D} SELECT dependency_type, horizon, count(*) FILTER (dst_step_id - src_step_id <= horizon) AS count FROM deps, (SELECT CAST(unnest([1, 3, 5, 10]) AS INT) AS horizon) GROUP BY dependency_type, horizon")
def g4(spark, d):
    return dependencies.by_horizon(_deps(spark, d))


@query("g5_distance_ecdf", f"{_D}, x AS (SELECT dependency_type, dst_step_id - src_step_id AS distance FROM deps) SELECT DISTINCT dependency_type, distance, round(cume_dist() OVER (PARTITION BY dependency_type ORDER BY distance), 6) AS share FROM x")
def g5(spark, d):
    return dependencies.distance_ecdf(_deps(spark, d))


@query("g6_tool_pivot", f"{_D} SELECT src_tool, count(*) FILTER (dst_tool = 'purchase') AS purchase, count(*) FILTER (dst_tool = 'signup') AS signup FROM deps GROUP BY src_tool")
def g6(spark, d):
    return dependencies.pair_pivot(_deps(spark, d), ["purchase", "signup"])


def _acc(spark, d):
    return working_set.accesses(events.objects(spark, d))


@query("w1_w10_working_set", f"""{_A}, n AS (SELECT granularity, item, count(*) AS n FROM acc GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY granularity ORDER BY n DESC, item) AS r, count(*) OVER (PARTITION BY granularity) AS items FROM n)
SELECT r.granularity, CAST(sum(n) AS BIGINT) AS accesses, max(items) AS items, round(sum(CASE WHEN r <= ceil(items * 0.1) THEN n ELSE 0 END) / sum(n), 6) AS top10pct_coverage, max(m.m) AS median_reuse_distance FROM r LEFT JOIN (SELECT granularity, median(distance) AS m FROM reuse GROUP BY granularity) m ON m.granularity = r.granularity GROUP BY r.granularity""")
def w10(spark, d):
    return working_set.summary(_acc(spark, d))


@query("w11_w12_reuse_ecdf", f"{_A} SELECT DISTINCT granularity, distance, round(cume_dist() OVER (PARTITION BY granularity ORDER BY distance), 6) AS share FROM reuse WHERE distance IS NOT NULL")
def w12(spark, d):
    return working_set.reuse_ecdf(_acc(spark, d))


@query("w13_top_items", f"{_A} SELECT granularity, item, count(*) AS n, CAST(row_number() OVER (PARTITION BY granularity ORDER BY count(*) DESC, item) AS INT) AS place FROM acc WHERE granularity <> 'object_type' GROUP BY granularity, item QUALIFY place <= 100")
def w13(spark, d):
    return working_set.top_items(_acc(spark, d))


@query("w3_future_objects", f"{_A} SELECT granularity, p.trace_id, p.step_id, horizon, count(DISTINCT item) AS items FROM acc a, steps p, (SELECT CAST(unnest([1, 3, 5, 10]) AS INT) AS horizon) WHERE granularity <> 'object_type' AND p.act AND a.trace_id = p.trace_id AND a.step_id > p.step_id AND a.step_id <= p.step_id + horizon GROUP BY ALL")
def w3(spark, d):
    return working_set.points(events.steps(spark, d), _acc(spark, d)).withColumn("items", F.size("truth").cast("long")).drop("truth")


_LASTK = """use AS (SELECT granularity, trace_id, step_id, item, row_number() OVER (PARTITION BY granularity, trace_id ORDER BY step_id, item) AS nth FROM acc WHERE granularity <> 'object_type'),
upto AS (SELECT u.granularity, p.trace_id, p.step_id, max(nth) AS nth FROM steps p JOIN use u ON u.trace_id = p.trace_id AND u.step_id <= p.step_id WHERE p.act GROUP BY ALL),
lastk AS (SELECT q.granularity, q.trace_id, q.step_id, list(DISTINCT item) AS pred FROM upto q JOIN use u ON u.granularity = q.granularity AND u.trace_id = q.trace_id AND u.nth > q.nth - 5 AND u.nth <= q.nth GROUP BY ALL)"""


@query("w4_last_k_objects", f"{_A}, {_LASTK} SELECT granularity, trace_id, step_id, array_to_string(list_sort(pred), ',') AS pred FROM lastk")
def w4(spark, d):
    return working_set.last_k(events.steps(spark, d), _acc(spark, d)).withColumn("pred", F.array_join(F.array_sort("pred"), ","))


@query("w5_w9_object_prediction", f"""{_A}, {_LASTK}, truth AS (SELECT granularity, p.trace_id, p.step_id, horizon, list(DISTINCT item) AS truth FROM acc a, steps p, (SELECT CAST(unnest([1, 3, 5, 10]) AS INT) AS horizon) WHERE granularity <> 'object_type' AND p.act AND a.trace_id = p.trace_id AND a.step_id > p.step_id AND a.step_id <= p.step_id + horizon GROUP BY ALL),
hot AS (SELECT granularity, task_id, harness, item, count(*) AS n FROM acc JOIN traces USING (trace_id) WHERE granularity <> 'object_type' GROUP BY ALL),
gh AS (SELECT granularity, list(item) AS pred FROM (SELECT granularity, item FROM hot GROUP BY granularity, item QUALIFY row_number() OVER (PARTITION BY granularity ORDER BY sum(n) DESC, item) <= 5) GROUP BY ALL),
th AS (SELECT granularity, task_id, list(item) AS pred FROM (SELECT granularity, task_id, item FROM hot GROUP BY granularity, task_id, item QUALIFY row_number() OVER (PARTITION BY granularity, task_id ORDER BY sum(n) DESC, item) <= 5) GROUP BY ALL),
hh AS (SELECT granularity, harness, list(item) AS pred FROM (SELECT granularity, harness, item FROM hot GROUP BY granularity, harness, item QUALIFY row_number() OVER (PARTITION BY granularity, harness ORDER BY sum(n) DESC, item) <= 5) GROUP BY ALL),
items AS (SELECT DISTINCT granularity, item FROM hot), rd2 AS (SELECT granularity, list(item) AS pred FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY granularity ORDER BY md5('7|' || item), item) <= 5) GROUP BY granularity),
a AS (SELECT t.*, x.task_id, x.harness FROM truth t JOIN traces x USING (trace_id)),
p AS (SELECT a.granularity, horizon, truth, 'lastK_object' AS baseline, pred FROM a LEFT JOIN lastk l ON l.granularity = a.granularity AND l.trace_id = a.trace_id AND l.step_id = a.step_id
  UNION ALL SELECT a.granularity, horizon, truth, 'global_hot_object', pred FROM a LEFT JOIN gh ON gh.granularity = a.granularity UNION ALL SELECT a.granularity, horizon, truth, 'task_hot_object', pred FROM a LEFT JOIN th ON th.granularity = a.granularity AND th.task_id = a.task_id
  UNION ALL SELECT a.granularity, horizon, truth, 'harness_hot_object', pred FROM a LEFT JOIN hh ON hh.granularity = a.granularity AND hh.harness = a.harness UNION ALL SELECT a.granularity, horizon, truth, 'random_same_count', pred FROM a LEFT JOIN rd2 ON rd2.granularity = a.granularity
  UNION ALL SELECT granularity, horizon, truth, 'object_type_only', ['file'] FROM a WHERE granularity = 'exact_object_id')
SELECT granularity, CASE WHEN granularity <> 'path_prefix' THEN baseline WHEN baseline = 'random_same_count' THEN 'random_prefix' ELSE replace(baseline, '_object', '_prefix') END AS baseline, horizon, count(*) AS points, round(avg(len(list_intersect(coalesce(pred, []), truth)) / len(truth)), 6) AS recall FROM p GROUP BY ALL""")
def w9(spark, d):
    return working_set.predictions(events.steps(spark, d), _acc(spark, d), events.traces(spark, d))


def _labels(spark, d):
    return early.labels(events.steps(spark, d))


_LAB = f"""lab AS (SELECT trace_id, kind, label, row_number() OVER (PARTITION BY trace_id, kind ORDER BY step_id) AS i FROM (SELECT *, CASE view WHEN 'semantic_tool_tool_action_only' THEN 'tool' WHEN 'phase_clean_tool_action_only' THEN 'phase' END AS kind FROM views) WHERE kind IS NOT NULL),
train AS (SELECT lab.*, task_id, harness FROM lab JOIN traces USING (trace_id) WHERE {_PART} < 700), test AS (SELECT lab.*, task_id, harness FROM lab JOIN traces USING (trace_id) WHERE {_PART} >= 700)"""


@query("i3_group_counts", f"{_V}, {_LAB} SELECT 'global' AS level, NULL AS task_id, NULL AS harness, kind, label, count(*) AS n FROM train GROUP BY kind, label UNION ALL SELECT 'task', task_id, NULL, kind, label, count(*) FROM train GROUP BY task_id, kind, label UNION ALL SELECT 'harness', NULL, harness, kind, label, count(*) FROM train GROUP BY harness, kind, label UNION ALL SELECT 'task+harness', task_id, harness, kind, label, count(*) FROM train GROUP BY task_id, harness, kind, label")
def i3(spark, d):
    return early.group_counts(_labels(spark, d), events.traces(spark, d))


_SCORES = """ks AS (SELECT CAST(unnest([1, 2, 3, 5, 8]) AS INT) AS k), tt AS (SELECT DISTINCT trace_id, task_id, harness FROM test),
g AS (SELECT kind, label, count(*) AS n FROM train GROUP BY ALL), t AS (SELECT task_id, kind, label, count(*) AS n FROM train GROUP BY ALL), h AS (SELECT harness, kind, label, count(*) AS n FROM train GROUP BY ALL), th AS (SELECT task_id, harness, kind, label, count(*) AS n FROM train GROUP BY ALL),
fixed AS (SELECT 'global' AS baseline, trace_id, kind, label, n FROM tt, g
  UNION ALL SELECT 'task', trace_id, kind, label, n FROM tt JOIN t USING (task_id) UNION ALL SELECT 'task', trace_id, kind, label, n FROM tt, g WHERE task_id NOT IN (SELECT task_id FROM t)
  UNION ALL SELECT 'harness', trace_id, kind, label, n FROM tt JOIN h USING (harness) UNION ALL SELECT 'harness', trace_id, kind, label, n FROM tt, g WHERE harness NOT IN (SELECT harness FROM h)
  UNION ALL SELECT 'task+harness', trace_id, kind, label, n FROM tt JOIN th USING (task_id, harness)
  UNION ALL SELECT 'task+harness', trace_id, kind, label, n FROM tt JOIN t USING (task_id) WHERE NOT EXISTS (SELECT 1 FROM th WHERE th.task_id = tt.task_id AND th.harness = tt.harness)
  UNION ALL SELECT 'task+harness', trace_id, kind, label, n FROM tt, g WHERE task_id NOT IN (SELECT task_id FROM t)),
first AS (SELECT k, trace_id, kind, label, count(*) AS n FROM test, ks WHERE i <= k GROUP BY ALL),
pre AS (SELECT k, trace_id, string_agg(label, chr(1) ORDER BY i) FILTER (i <= k) AS prefix FROM lab, ks WHERE kind = 'tool' GROUP BY ALL),
pt AS (SELECT k, prefix, kind, label, count(*) AS n FROM pre JOIN train USING (trace_id) GROUP BY ALL),
alike AS (SELECT pre.k, pre.trace_id, kind, label, n FROM pre JOIN tt USING (trace_id) JOIN pt ON pt.k = pre.k AND pt.prefix = pre.prefix),
s AS (SELECT k, baseline, trace_id, kind, label, n AS x FROM fixed, ks UNION ALL SELECT k, 'lastK', trace_id, kind, label, n FROM first
  UNION ALL SELECT k, 'last_step', trace_id, kind, arg_max(label, i), 1 FROM test, ks WHERE i <= k GROUP BY k, trace_id, kind
  UNION ALL SELECT k, 'early_markov', trace_id, kind, label, n FROM alike UNION ALL SELECT k, 'early_markov', trace_id, kind, label, n FROM first WHERE NOT EXISTS (SELECT 1 FROM alike WHERE alike.k = first.k AND alike.trace_id = first.trace_id AND alike.kind = first.kind))"""


def _early_sql(leak_free: bool) -> str:
    after = "WHERE i > k" if leak_free else ""
    return f"""{_V}, {_LAB}, {_SCORES},
truth AS (SELECT k, trace_id, kind, label, count(*) AS y FROM test, ks {after} GROUP BY ALL),
b AS (SELECT unnest(['global', 'task', 'harness', 'task+harness', 'lastK', 'last_step', 'early_markov']) AS baseline),
j AS (SELECT * FROM (SELECT truth.*, baseline FROM truth, b) FULL JOIN s USING (k, baseline, trace_id, kind, label)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, baseline, trace_id, kind ORDER BY x DESC NULLS LAST, label) AS r FROM j WHERE EXISTS (SELECT 1 FROM truth WHERE truth.k = j.k AND truth.trace_id = j.trace_id AND truth.kind = j.kind)),
e2 AS (SELECT k, baseline, trace_id, kind, coalesce(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 0) AS c, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND r <= 3) / count(y) AS rec FROM r GROUP BY ALL)
SELECT k, baseline, count(*) FILTER (kind = 'tool') AS traces, round(avg(c) FILTER (kind = 'tool'), 6) AS tool_cosine, round(avg(c) FILTER (kind = 'phase'), 6) AS phase_cosine, round(avg(rec) FILTER (kind = 'tool'), 6) AS future_tool_top3_recall, round(avg(rec) FILTER (kind = 'phase'), 6) AS future_phase_top3_recall, '{"after_k" if leak_free else "whole"}' AS target FROM e2 GROUP BY k, baseline"""


def _delta_sql(leak_free: bool) -> str:
    return f"SELECT k, target, baseline, future_tool_top3_recall, round(future_tool_top3_recall - max(future_tool_top3_recall) FILTER (baseline IN ('global', 'task', 'harness', 'task+harness')) OVER (PARTITION BY k), 6) AS delta_vs_best_metadata_baseline FROM ({_early_sql(leak_free)})"


@query("i4_i6_early_prediction", _early_sql(False))
def i6(spark, d):
    return early.metrics(_labels(spark, d), events.traces(spark, d), leak_free=False)


@query("i4_i6_early_prediction_leak_free", _early_sql(True))
def i6b(spark, d):
    return early.metrics(_labels(spark, d), events.traces(spark, d), leak_free=True)


@query("i6_prefix_recall", f"{_O}, n AS (SELECT trace_id, count(DISTINCT object_prefix) AS n FROM objects WHERE object_prefix IS NOT NULL AND {_PART} >= 700 GROUP BY trace_id) SELECT count(*) AS traces, round(avg(least(n, 5) / n), 6) AS object_prefix_top5_recall FROM n")
def i6c(spark, d):
    return early.prefix_recall(events.objects(spark, d), events.traces(spark, d))


def _compared(spark, d, leak_free):
    return early.against_metadata(early.metrics(_labels(spark, d), events.traces(spark, d), leak_free=leak_free))


@query("i10_delta_vs_metadata", f"{_delta_sql(True)} UNION ALL {_delta_sql(False)}")
def i10(spark, d):
    return _compared(spark, d, True).unionByName(_compared(spark, d, False))


_FAIL = """acts AS (SELECT * FROM steps WHERE act AND event_id % 13 <> 0),
hx AS (SELECT trace_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS ht FROM (SELECT trace_id, tool, count(*) AS n FROM acts GROUP BY ALL) GROUP BY trace_id), hp AS (SELECT trace_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hp FROM (SELECT trace_id, phase, count(*) AS n FROM acts GROUP BY ALL) GROUP BY trace_id),
base AS (SELECT trace_id, count(*) AS n, 1 - count(DISTINCT tool) / count(*) AS rt, 1 - count(DISTINCT phase) / count(*) AS rp, avg(CASE WHEN tool = 'error' THEN 1.0 ELSE 0.0 END) AS er FROM acts GROUP BY trace_id),
runs AS (SELECT trace_id, max(c) AS mr FROM (SELECT trace_id, tool, i, count(*) AS c FROM (SELECT trace_id, tool, row_number() OVER (PARTITION BY trace_id ORDER BY step_id) - row_number() OVER (PARTITION BY trace_id, tool ORDER BY step_id) AS i FROM acts) GROUP BY ALL) GROUP BY trace_id),
ob AS (SELECT trace_id, 1 - count(DISTINCT object_id) / count(*) AS ro, 1 - count(DISTINCT object_prefix) / count(object_prefix) AS rx, count(*) FILTER (object_type = 'error_signature') - count(DISTINCT object_id) FILTER (object_type = 'error_signature') AS re, count(*) FILTER (object_type = 'test_case') - count(DISTINCT object_id) FILTER (object_type = 'test_case') AS rtc, count(*) FILTER (object_type = 'error_signature') AS ne FROM objects GROUP BY trace_id),
f0 AS (SELECT trace_id, success, coalesce(ht, 0) AS ht, coalesce(hp, 0) AS hp, coalesce(rt, 0) AS rt, coalesce(rp, 0) AS rp, coalesce(ro, 0) AS ro, coalesce(rx, 0) AS rx, coalesce(mr, 0) AS mr, coalesce(er, 0) AS er, coalesce(re, 0) AS re, coalesce(rtc, 0) AS rtc, coalesce(ne, 0) AS ne, coalesce(n, 0) AS n FROM traces LEFT JOIN base USING (trace_id) LEFT JOIN runs USING (trace_id) LEFT JOIN ob USING (trace_id) LEFT JOIN hx USING (trace_id) LEFT JOIN hp USING (trace_id)),
f1 AS (SELECT trace_id, success, round(ht, 9) AS semantic_tool_entropy, round(hp, 9) AS phase_entropy, round(rt, 9) AS repeated_semantic_tool_ratio, round(rp, 9) AS repeated_phase_ratio, round(ro, 9) AS repeated_object_ratio, round(rx, 9) AS repeated_path_prefix_ratio, CAST(mr AS DOUBLE) AS max_same_tool_run_length, round(er, 9) AS error_rate, CAST(re AS DOUBLE) AS repeated_error_signature_count, CAST(rtc AS DOUBLE) AS repeated_test_case_count, round((rt + ro + er) / 3, 9) AS no_progress_loop_score, round((rt + rp + ro + rx + er + least(re / greatest(ne, 1), 1) + least(mr / greatest(n, 1), 1)) / 7, 9) AS failure_loop_score FROM f0)"""
_LONG = f"lg AS (SELECT trace_id, NOT success AS failed, metric, value FROM f1 UNPIVOT (value FOR metric IN ({', '.join(failure.METRICS)}))), rk AS (SELECT *, (rank() OVER (PARTITION BY metric ORDER BY value) + rank() OVER (PARTITION BY metric ORDER BY value) + count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY metric, value) AS ties FROM lg)"
_F = f"{_O}, {_FAIL}"


_ERFC = f"y * exp(-x * x {' '.join(f'{c:+} * y ** {i}' for i, c in enumerate(stats.ERFC))})"


def _metrics(spark, d):
    return failure.per_trace(events.steps(spark, d), events.objects(spark, d), events.traces(spark, d))


@query("j1_j8_failure_metrics", f"{_F} SELECT * FROM f1")
def j1(spark, d):
    return _metrics(spark, d)


@query("j9_j10_comparison", f"""{_F.replace("WITH", "WITH RECURSIVE", 1)}, {_LONG}, q AS (SELECT metric, avg(value) FILTER (NOT failed) AS a, avg(value) FILTER (failed) AS b, sum(r) FILTER (failed) AS rs, count(*) FILTER (failed) AS p, count(*) FILTER (NOT failed) AS n, sum(CAST(ties AS DOUBLE) * ties - 1) AS t FROM rk GROUP BY metric),
small AS (SELECT metric, p, n, least(rs - p * (p + 1) / 2, p * n - rs + p * (p + 1) / 2) AS u FROM q WHERE t = 0 AND least(p, n) BETWEEN 1 AND 8 AND p * n <= 1000000),
lim AS (SELECT coalesce(max(p), 0) AS p, coalesce(max(n), 0) AS n FROM small),
ways AS (SELECT 0 AS p, 0 AS n, 0 AS u, CAST(1 AS DOUBLE) AS w UNION ALL
  SELECT CAST(ways.p + side AS INT), CAST(ways.n + 1 - side AS INT), CAST(ways.u + side * ways.n AS INT), sum(w) FROM ways, lim, (SELECT unnest([0, 1]) AS side) WHERE ways.p + side <= lim.p AND ways.n + 1 - side <= lim.n GROUP BY ALL),
exact AS (SELECT metric, least(1, 2 * sum(w) FILTER (ways.u <= small.u) / sum(w)) AS e FROM small JOIN ways ON ways.p = small.p AND ways.n = small.n GROUP BY metric)
SELECT metric, round(a, 6) AS success_mean, round(b, 6) AS failure_mean, round(round(b, 6) - round(a, 6), 6) AS delta_failure_minus_success, rs - p * (p + 1) / 2 AS mannwhitney_u, CASE WHEN t >= (p + n) * (CAST(p + n AS DOUBLE) * (p + n) - 1) THEN NULL ELSE round((rs - p * (p + 1) / 2 - p * n / 2) / sqrt(p * n / 12 * (p + n + 1 - t / ((p + n) * (p + n - 1)))), 6) END AS z, round(coalesce(e, CASE WHEN t < (p + n) * (CAST(p + n AS DOUBLE) * (p + n) - 1) THEN least(1, {_ERFC}) END), 6) AS p_value
FROM (SELECT *, 1 / (1 + 0.5 * x) AS y FROM (SELECT *, greatest(0, (abs(rs - p * (p + 1) / 2 - p * n / 2) - 0.5) / nullif(sqrt(greatest(0, p * n / 12 * (p + n + 1 - t / ((p + n) * (p + n - 1))))), 0)) / sqrt(2) AS x FROM q)) LEFT JOIN exact USING (metric)""")
def j9(spark, d):
    return failure.comparison(_metrics(spark, d))


@query("j11_repeated_errors", f"{_O} SELECT object_id, count(*) AS n FROM objects WHERE object_type = 'error_signature' GROUP BY object_id ORDER BY n DESC, object_id LIMIT 100")
def j11(spark, d):
    return failure.repeated_errors(events.objects(spark, d))


@query("j12_box", f"{_F}, {_LONG} SELECT metric, failed, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM lg GROUP BY metric, failed")
def j12(spark, d):
    return failure.box(_metrics(spark, d))


@query("i7_i9_failure_auc", f"{_F}, {_LONG} SELECT 'failure' AS target, round((sum(r) FILTER (failed) - count(*) FILTER (failed) * (count(*) FILTER (failed) + 1) / 2) / (count(*) FILTER (failed) * count(*) FILTER (NOT failed)), 6) AS auc FROM rk WHERE metric = 'failure_loop_score'")
def i9(spark, d):
    return early.failure_auc(_metrics(spark, d))


@query("i8_long_trace_auc", f"{_S}, x AS (SELECT trace_id, count(*) AS len, count(*) FILTER (real_act) AS score FROM steps GROUP BY trace_id), y AS (SELECT *, len > (SELECT median(len) FROM x) AS long FROM x), z AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM y) SELECT 'long' AS target, round((sum(r) FILTER (long) - count(*) FILTER (long) * (count(*) FILTER (long) + 1) / 2) / (count(*) FILTER (long) * count(*) FILTER (NOT long)), 6) AS auc FROM z")
def i8(spark, d):
    real = F.col("is_tool_action") & ~F.col("command_artifact_flag") & ~F.col("is_no_tool_step")
    x = events.steps(spark, d).groupBy("trace_id").agg(F.count("*").alias("len"), F.count_if(real).alias("score"))
    y = x.join(F.broadcast(ranks.quantiles(x, [], "len", {"m": 0.5}))).select(F.lit("long").alias("target"), "score", (F.col("len") > F.col("m")).alias("long"))  # one row
    return stats.auc(y, ["target"], "score", "long")


@query("i8_i9_auc_by_k", f"""{_V}, {_OBJECTS}, {_FAIL}, {_LAB}, {_SCORES},
ln AS (SELECT trace_id, count(lab.label) AS n FROM traces LEFT JOIN (SELECT * FROM lab WHERE kind = 'tool') lab USING (trace_id) GROUP BY trace_id), y AS (SELECT trace_id, n > (SELECT median(n) FROM ln) AS long FROM ln WHERE {_PART} >= 700),
tot AS (SELECT k, baseline, trace_id, sum(x) AS score FROM s WHERE kind = 'tool' GROUP BY ALL), rl AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY k, baseline, score) - 1) / 2 AS r FROM tot JOIN y USING (trace_id) WINDOW w AS (PARTITION BY k, baseline ORDER BY score)),
rf AS (SELECT success, rank() OVER (ORDER BY failure_loop_score) + (count(*) OVER (PARTITION BY failure_loop_score) - 1) / 2 AS r FROM f1 WHERE {_PART} >= 700),
fa AS (SELECT round((sum(r) FILTER (NOT success) - count(*) FILTER (NOT success) * (count(*) FILTER (NOT success) + 1) / 2) / (count(*) FILTER (NOT success) * nullif(count(*) FILTER (success), 0)), 6) AS failure_loop_auc FROM rf)
SELECT k, baseline, round((sum(r) FILTER (long) - count(*) FILTER (long) * (count(*) FILTER (long) + 1) / 2) / (nullif(count(*) FILTER (long), 0) * nullif(count(*) FILTER (NOT long), 0)), 6) AS long_trajectory_auc, any_value(failure_loop_auc) AS failure_loop_auc FROM rl, fa GROUP BY k, baseline""")
def i8b(spark, d):
    return early.auc_by_k(_labels(spark, d), events.traces(spark, d), _metrics(spark, d))


@query("j12_cumulative", f"{_F} SELECT DISTINCT metric, success, value, round(cume_dist() OVER (PARTITION BY metric, success ORDER BY value), 6) AS share FROM (SELECT success, metric, value FROM f1 UNPIVOT (value FOR metric IN (repeated_error_signature_count, max_same_tool_run_length)))")
def j12b(spark, d):
    return failure.cumulative(_metrics(spark, d))


_SEV = f"""{_O}, q AS (SELECT trace_id, object_id, CAST(sum(length(object_id)) AS DOUBLE) AS bytes, count(*) AS n FROM objects GROUP BY ALL),
c AS (SELECT (SELECT coalesce(sum(bytes - bytes / n) FILTER (n > 1), 0) FROM q) AS r, (SELECT sum(0.15 * input_tokens) FROM traces) AS p, (SELECT CAST(count(*) AS DOUBLE) FROM steps JOIN traces USING (trace_id) WHERE act AND NOT success) AS w, (SELECT greatest(0, max(delta_vs_best_metadata_baseline)) FROM ({_delta_sql(False)})) AS gain),
v AS (SELECT *, r + p + 500 * w AS base, 0.2 * r AS session, 0.65 * r + 0.25 * p + 250 * w AS oracle FROM c)"""
_COSTS = "x AS (SELECT unnest(['independent_call', 'session_affinity', 'oracle_upper_bound', 'predicted', 'wrong_prediction_stress', 'object_type_only']) AS strategy, unnest([0.0, session, oracle, session + oracle * least(0.35, 0.1 + gain), 0.85 * session, 0.95 * session]) AS red, base FROM v), costs AS (SELECT strategy, round(base - red, 3) AS estimated_cost, round(red, 3) AS reduction_vs_independent FROM x)"


def _components(spark, d):
    return severity.components(events.steps(spark, d), events.objects(spark, d), events.traces(spark, d), severity.gain(_compared(spark, d, False)))


@query("k1_k5_strategies", f"{_SEV}, {_COSTS} SELECT * FROM costs")
def k5(spark, d):
    return severity.strategies(_components(spark, d))


@query("k5_opportunity", f"{_SEV}, {_COSTS} SELECT * FROM costs WHERE strategy <> 'independent_call'")
def k5b(spark, d):
    return severity.opportunity(severity.strategies(_components(spark, d)))


@query("k6_breakdown", f"{_SEV} SELECT unnest(['repeated_object_bytes', 'estimated_redundant_prefill_tokens', 'failure_loop_wasted_steps_proxy', 'object_movement_bytes_proxy', 'kv_eviction_opportunity_loss_proxy']) AS component, round(unnest([r, p, 500 * w, 0.3 * r, 0.2 * p]), 3) AS cost FROM v")
def k6(spark, d):
    return severity.breakdown(_components(spark, d))


def _few(df: DataFrame) -> DataFrame:
    """A result of a few rows, stored before the next one is planned, so that the driver never holds the plans of several."""
    return stored(df, "verdicts")


def _tables(spark, d):
    """Steps, objects, traces and early prediction against metadata, which all results share. Traces meet by merging whatever their number, as large tables do: each broadcast passes through the driver."""
    s, o, t = (stored(f(spark, d), "verdicts").hint("merge") for f in (events.steps, events.objects, events.traces))
    return s, o, t, _few(early.against_metadata(early.metrics(early.labels(s), t, leak_free=False)))


def _verdicts(s, o, t, compared):
    rows = stored(views.view_steps(s, severity.CLEAN), "verdicts")
    tr, acc = stored(transitions.transitions(rows), "verdicts"), working_set.accesses(o)
    by_trace = stored(transitions.hits(*transitions.parts(tr), ["view"], ["trace_id"]), "verdicts")
    by_view = by_trace.groupBy("view").agg(*[F.sum(c).alias(c) for c in by_trace.columns if c not in ("view", "trace_id")])
    h1 = _few(transitions.recall_of(by_view)), _few(transitions.bootstrap_of(by_trace)), _few(transitions.permutation_test(rows, replicates=25))
    found, deps = _few(motifs.motifs(motifs.sequences(s, o), t)), _few(dependencies.summary(normalize.dependencies(s, o), t))
    preds, failed = _few(working_set.predictions(s, acc, t)), _few(failure.comparison(failure.per_trace(s, o, t)))
    return severity.verdicts(*h1, found, deps, preds, compared, failed)


def _table(name: str) -> str:
    return f"({ORACLES[name]})"


_VERDICTS = f"""SELECT 'H1' AS hypothesis, CASE WHEN (SELECT max(delta) > 0.08 FROM {_table("e4_e5_recall")} WHERE k = 3 AND view LIKE '%semantic_tool_tool_action_only') AND (SELECT max(low) > 0 FROM {_table("e8_bootstrap")} WHERE view LIKE '%semantic_tool_tool_action_only') AND (SELECT min(p) < 0.05 FROM {_table("e11_e12_e15_permutation_test")} WHERE view LIKE '%semantic_tool_tool_action_only') THEN 'supported' ELSE 'not supported' END AS verdict
UNION ALL SELECT 'H2', CASE WHEN count(*) FILTER (appears_in_heldout) >= 3 AND max(support_harnesses) > 1 THEN 'supported' WHEN bool_or(appears_in_heldout) THEN 'partially supported' ELSE 'not supported' END FROM {_table("f1_f7_motifs")}
UNION ALL SELECT 'H3', CASE WHEN sum(count) > 0 AND coalesce(median(median_distance), 999) <= 5 THEN 'supported' ELSE 'not supported' END FROM {_table("g1_dependency_summary")}
UNION ALL SELECT 'H4', CASE WHEN avg(recall) FILTER (baseline = 'lastK_object') > greatest(coalesce(avg(recall) FILTER (baseline = 'random_same_count'), -1), coalesce(avg(recall) FILTER (baseline = 'object_type_only'), -1)) + 0.05 THEN 'supported' ELSE 'not supported' END FROM {_table("w5_w9_object_prediction")} WHERE granularity = 'exact_object_id' AND horizon IN (3, 5, 10)
UNION ALL SELECT 'H5', CASE WHEN count(*) FILTER (delta_vs_best_metadata_baseline > 0) >= 2 THEN 'supported' WHEN count(*) FILTER (delta_vs_best_metadata_baseline > 0) > 0 THEN 'partially supported' ELSE 'not supported' END FROM ({_delta_sql(False)}) WHERE baseline IN ('lastK', 'early_markov') AND k IN (3, 5, 8)
UNION ALL SELECT 'H6', CASE WHEN bool_or(delta_failure_minus_success > 0 AND p_value < 0.05) THEN 'supported' WHEN bool_or(delta_failure_minus_success > 0) THEN 'partially supported' ELSE 'not supported' END FROM {_table("j9_j10_comparison")} WHERE metric = 'failure_loop_score'"""


@query("k7_verdicts", _VERDICTS)
def k7(spark, d):
    return _verdicts(*_tables(spark, d))


@query("k8_conclusion", f"""WITH n AS (SELECT count(*) FILTER (verdict = 'supported') AS supported FROM ({_VERDICTS})), c AS (SELECT max(reduction_vs_independent) FILTER (strategy = 'predicted') AS predicted, max(reduction_vs_independent) FILTER (strategy = 'session_affinity') AS session, max(reduction_vs_independent) FILTER (strategy = 'wrong_prediction_stress') AS wrong FROM {_table("k1_k5_strategies")})
SELECT *, supported >= 4 AND predicted > session AND predicted > wrong AS sufficient, CASE WHEN supported >= 4 AND predicted > session AND predicted > wrong THEN 'the problem exists' ELSE 'the problem is not sufficiently shown' END AS conclusion FROM n, c""")
def k8(spark, d):
    s, o, t, compared = _tables(spark, d)
    costs = _few(severity.strategies(severity.components(s, o, t, severity.gain(compared))))
    return severity.conclusion(_few(_verdicts(s, o, t, compared)), costs)


_KNOWN = """e AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS step_id FROM events),
known AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, step_id, k, event_type AS t, event_id % 11 = 0 AS none, event_id % 11 <> 0 AND event_id % 13 = 0 AS art, event_id % 11 <> 0 AND event_id % 13 <> 0 AS ok FROM e)"""


@query("b_c_parsed_steps", f"""WITH {_KNOWN} SELECT trace_id, step_id, CASE WHEN none THEN 'unknown' ELSE 'bash' END AS tool_wrapper,
  CASE WHEN NOT ok THEN 'unknown' WHEN t = 'view' THEN 'read_file' WHEN t = 'click' THEN 'search' WHEN t = 'signup' THEN 'edit' WHEN t = 'purchase' THEN 'test' ELSE 'unknown' END AS semantic_tool_clean,
  CASE WHEN NOT ok THEN 'unknown' WHEN t IN ('view', 'click') THEN 'explore/read' WHEN t = 'signup' THEN 'edit/write' WHEN t = 'purchase' THEN 'execute/test' ELSE 'unknown' END AS phase_clean,
  ok AND t <> 'error' AS is_tool_action, none OR art AS command_artifact_flag, t = 'error' AS error_flag FROM known""")
def b_c(spark, d):
    return normalize.steps(events.raw(spark, d)).select("trace_id", "step_id", F.when(F.col("tool_wrapper") == "unknown", "unknown").otherwise("bash").alias("tool_wrapper"), "semantic_tool_clean", "phase_clean", "is_tool_action", "command_artifact_flag", "error_flag")


@query("c4_c10_object_counts", f"""WITH {_KNOWN}, o AS (
  SELECT 'file' AS object_type, 'command' AS object_source, CASE WHEN t = 'signup' THEN 'write' ELSE 'read' END AS access_type, 'file:src/pkg' || (k % 7) || '/f' || k || '.py' AS object_id FROM known WHERE ok AND t IN ('view', 'click', 'signup')
  UNION ALL SELECT 'file', 'command', 'execute', 'file:tests/test_m' || (k % 5) || '.py' FROM known WHERE ok AND t = 'purchase'
  UNION ALL SELECT 'test_case', 'mixed', 'execute', 'test:test_m' || (k % 5) || '.py' FROM known WHERE ok AND t = 'purchase'
  UNION ALL SELECT 'file', 'observation', 'mention', 'file:src/pkg' || (k % 7) || '/f' || k || '.py' FROM known WHERE t = 'click'
  UNION ALL SELECT 'file', 'observation', 'mention', 'file:/app/Mod' || (k % 5) || '.py' FROM known WHERE t = 'error'
  UNION ALL SELECT 'error_signature', 'observation', 'error', 'error:traceback:Mod' || (k % 5) || '.py:line' FROM known WHERE t = 'error')
SELECT object_type, object_source, access_type, object_id, count(*) AS n FROM o GROUP BY ALL""")
def c10(spark, d):
    o = normalize.objects(normalize.steps(events.raw(spark, d)))
    return o.groupBy("object_type", "object_source", "access_type", "object_id").agg(F.count("*").alias("n"))


@query("c11_traces", f"WITH {_KNOWN} SELECT trace_id, true AS success, 1.5 AS duration, CAST(NULL AS DOUBLE) AS input_tokens, count(*) AS total_steps, count(*) FILTER (ok AND t <> 'error') AS tool_action_steps FROM known GROUP BY trace_id")
def c11(spark, d):
    raw = events.raw(spark, d)
    return normalize.traces(raw, normalize.steps(raw)).select("trace_id", "success", "duration", "input_tokens", "total_steps", "tool_action_steps")


@query("c14_c15_quality", f"""WITH {_KNOWN} SELECT count(*) AS num_steps, count(*) FILTER (ok AND t <> 'error') AS num_tool_action_steps, count(DISTINCT trace_id) AS num_traces, round(avg(CASE WHEN NOT ok OR t = 'error' THEN 1.0 ELSE 0 END), 6) AS unknown_rate, round(avg(CASE WHEN none OR art THEN 1.0 ELSE 0 END), 6) AS artifact_rate, round(avg(CASE WHEN none THEN 0.0 ELSE 1 END), 6) AS command_parse_success_rate,
(SELECT sum(n) FROM ({ORACLES["c4_c10_object_counts"]})) AS num_object_accesses, 0 AS skipped_rows, 'terminalbench' AS dataset, 'events' AS source, true AS strict_real, false AS used_mock, '' AS profile_mode FROM known""")
def c14(spark, d):
    raw = events.raw(spark, d)
    s = normalize.steps(raw)
    return normalize.quality_row(raw, s, normalize.objects(s), source="events")


#: Commands ({} is a file's path) with the tool that they run, its group, and whether they write: worked out by hand. Each event is one of them, about a file of its own.
COMMANDS = [
    ("grep -R foo {}", "grep", "search", False), ("search_dir foo {}", "search_dir", "search", False), ("cat pytest.ini {}", "cat", "read_file", False), ("grep -rn pytest {}", "grep", "search", False), ("pip install {}", "pip", "pip", False),
    ("sudo time ls {}", "ls", "list_files", False), ("/usr/bin/sudo ls", "ls", "list_files", False), ("env -i timeout -k5 /bin/cat {}", "cat", "read_file", False), ("python -u -m unittest {}", "unittest", "test", False), ("python3 -m http.server {}", "python", "execute", False),
    ("python run_pytest.py {}", "pytest", "test", False), ("A=1 B=2 python -m pytest {}", "pytest", "test", False), ("ls {} | tee out", "ls", "list_files", False), ("tee {}", "tee", "edit", True), ("tee -a", "tee", "edit", True), ("touch {}", "touch", "edit", True),
    ("mkdir -p {}", "mkdir", "edit", True), ("sed -n 1,10p {}", "sed_read", "read_file", False), ("sed -i s/a/b/ {}", "edit", "edit", True), ("sed -i.bak s/a/b/ {}", "edit", "edit", True), ("echo {}", "echo", "unknown", False), ("echo hello > {}", "write_file", "edit", True),
    ("cat a.txt >> {}", "cat", "read_file", True), ("bash -c 'ls -l {}'", "ls", "list_files", False), ("bash {}", "bash", "execute", False), ("go test {}", "go_test", "test", False), ("go build {}", "go", "execute", False), ("npm test", "npm_test", "test", False), ("$ curl {}", "curl", "retrieve", False),
    ("submit", "submit", "final", False), ('cat "{}', "cat", "read_file", False), ("", "unknown", "unknown", False), ("X={}", "unknown", "unknown", False), ("(ls {})", "unknown", "unknown", False),
]
#: Observations ({} is the name of a module) with their error's signature and flag, by hand. Each event is one of them.
OBSERVATIONS = [
    ('Traceback\n  File "/x/{}.py", line 3, in f\nValueError: bad', "traceback:{}.py:line", True), ('File "/x/{}.txt", line 3', None, False), ("pkg.{}.ParseError: no", "exception:pkg.{}.ParseError", True), ("Exception: {}", "exception:Exception", True),
    ("FAILED tests/test_{}.py::test_b, ok", "failed_test:tests/test_{}.py::test_b", True), ("the job of {} timed out", "error:timeout", True), ("an error in {}", "error:generic", True), ("{}: exit code 3", None, True), ("{}: exit code 0", None, False), ("{}: 0 failures", None, False), ("{}: all good", None, False),
]


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _cases(spark, d, cases: list[tuple], name) -> DataFrame:
    """event_id, and the first text of the case that its number names, with the event's own name in it."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    text = F.element_at(F.array(*[F.lit(c[0]) for c in cases]), (F.pmod("event_id", F.lit(len(cases))) + 1).cast("int"))
    return e.select("event_id", F.replace(text, F.lit("{}"), name).alias("text"))


_NAMED = "SELECT event_id, 'src/pkg' || (user_id % 7) || '/f' || CAST(json_extract_string(props, '$.k') AS BIGINT) || '.py' AS file, 'Mod' || (user_id % 50) AS module FROM events"


@query("b9_b11_commands", f"""WITH c AS (SELECT * FROM ({_values([(i, *c) for i, c in enumerate(COMMANDS)])}) t(i, command, tool, tool_group, writes))
SELECT event_id, replace(command, '{{}}', file) AS command, tool, tool_group, writes FROM ({_NAMED}) e JOIN c ON c.i = e.event_id % {len(COMMANDS)}""")
def b10(spark, d):
    file = F.concat(F.lit("src/pkg"), F.col("user_id") % 7, F.lit("/f"), F.col("k"), F.lit(".py"))
    df = _cases(spark, d, COMMANDS, file).withColumn("s", parse.shell("text", F.lit("execute_bash")))
    return df.select("event_id", F.col("text").alias("command"), F.col("s.tool").alias("tool"), parse.tool_group(F.col("s.tool")).alias("tool_group"), F.col("s.writes").alias("writes"))


@query("b18_b27_signatures", f"""WITH c AS (SELECT * FROM ({_values([(i, *o) for i, o in enumerate(OBSERVATIONS)])}) t(i, observation, signature, error_flag))
SELECT event_id, replace(observation, '{{}}', module) AS observation, replace(signature, '{{}}', module) AS signature, error_flag FROM ({_NAMED}) e JOIN c ON c.i = e.event_id % {len(OBSERVATIONS)}""")
def b18(spark, d):
    df = _cases(spark, d, OBSERVATIONS, F.concat(F.lit("Mod"), F.col("user_id") % 50))
    return df.select("event_id", F.col("text").alias("observation"), parse.error_signature(F.col("text")).alias("signature"), parse.error_flag(F.col("text")).alias("error_flag"))


@query("c4_c10_accesses", r"""WITH u AS (SELECT page_id, regexp_replace(url, '[.,;)]+$', '') AS url, length(html) + 2 + length(url) AS n FROM pages),
v AS (SELECT *, regexp_replace(url, '/+', '/', 'g') AS path FROM u),
w AS (SELECT *, regexp_extract(path, '[^/]*$') AS last, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.', '..')) AS parts FROM v),
h AS (SELECT page_id, regexp_extract(url, '^https?:/(/[^?#]*\.html)($|[^\w./-])', 1) AS path FROM pages),
f AS (SELECT doc_id, doc_id % 2 = 0 AS deep, CASE WHEN doc_id % 2 = 0 THEN './data/' || source || '/' || lang || '/doc' || doc_id || '.md' ELSE 'doc' || doc_id || '.json' END AS path, source FROM documents)
SELECT 'page' || page_id AS trace_id, 'url:' || url AS object_id, 'url' AS object_type, 'retrieve' AS access_type, CAST(length(url) AS INT) AS object_size, array_to_string(parts[1:2], '/') AS object_prefix, regexp_replace(path, '/[^/]*$', '') AS object_dir, lower(regexp_extract(last, '^.+(\.[^.]+)$', 1)) AS object_extension, true AS stable_object FROM w
UNION ALL SELECT 'page' || page_id, 'large_observation_bucket', 'large_observation_bucket', 'mention', CAST(n AS INT), NULL, NULL, NULL, false FROM u WHERE n > 4000
UNION ALL SELECT 'page' || page_id, 'file:' || path, 'file', 'retrieve', CAST(length(path) AS INT), array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:2], '/'), regexp_replace(path, '/[^/]*$', ''), '.html', true FROM h WHERE path <> ''
UNION ALL SELECT 'doc' || doc_id, 'file:' || path, 'file', CASE WHEN deep THEN 'read' ELSE 'write' END, CAST(length(path) AS INT), CASE WHEN deep THEN 'data/' || source ELSE path END, CASE WHEN deep THEN regexp_replace(substr(path, 3), '/[^/]*$', '') ELSE '.' END, CASE WHEN deep THEN '.md' ELSE '.json' END, true FROM f""")
def c4(spark, d):
    o = normalize.objects(normalize.steps(events.raw_pages(spark, d)))
    kept = o.where("object_type in ('url', 'large_observation_bucket') or (object_type = 'file' and object_source = 'command')")
    return kept.select("trace_id", "object_id", "object_type", "access_type", "object_size", "object_prefix", "object_dir", "object_extension", "stable_object")
