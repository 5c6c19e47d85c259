"""Early prediction: which labels a trace will have, from its first K steps or what is known of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ranks import quantiles
from .stats import auc
from .transitions import draw
from .views import view_steps

KS = (1, 2, 3, 5, 8)
#: Baselines that know only what is known of a trace beforehand.
METADATA = ["global", "task", "harness", "task+harness"]
_VIEW = {"semantic_tool_tool_action_only": "tool", "phase_clean_tool_action_only": "phase"}


def labels(steps: DataFrame) -> DataFrame:
    """(trace_id, kind, i, label): tools and phases of tool actions, each kind numbered from 1."""
    kind = F.create_map(*[F.lit(x) for pair in _VIEW.items() for x in pair])[F.col("view")]
    rows = view_steps(steps, list(_VIEW)).withColumn("kind", kind)
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("trace_id", "kind").orderBy("step_id"))).select("trace_id", "kind", "i", "label")


def group_counts(lab: DataFrame, traces: DataFrame, seed: int = 7) -> DataFrame:
    """(level, task_id, harness, kind, label, n): counts of training traces at four levels, by one GROUPING SETS."""
    rows = lab.join(traces.select("trace_id", "task_id", "harness"), "trace_id").where(draw(seed, "trace_id") % 1000 < 700)
    t, h, kind, label = (F.col(c) for c in ("task_id", "harness", "kind", "label"))
    n = rows.groupingSets([[t, h, kind, label], [t, kind, label], [h, kind, label], [kind, label]], t, h, kind, label).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, "task+harness").when(F.col("gid") == 4, "task").when(F.col("gid") == 8, "harness").otherwise("global")
    return n.select(level.alias("level"), "task_id", "harness", "kind", "label", "n")


def _prefixes(lab: DataFrame) -> DataFrame:
    """(trace_id, k, prefix): the first k tools, for every k."""
    first = lab.where((F.col("kind") == "tool") & (F.col("i") <= max(KS))).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]).alias("seq"))
    return first.select("trace_id", "seq", F.explode(F.array(*map(F.lit, KS))).alias("k")).withColumn("prefix", F.array_join(F.slice("seq", 1, F.col("k")), "\x01")).drop("seq")


def _name(kind: str, *columns: str) -> Column:
    """The name of a vector of scores: what made it, and for what."""
    return F.array(F.lit(kind), *[F.col(c).cast("string") for c in columns])


def vectors(lab: DataFrame, traces: DataFrame, seed: int = 7) -> DataFrame:
    """(vec, kind, label, score): every vector of scores once, however many held-out traces use it. Counts of the groups of training traces, of training traces by their first k tools, and of each held-out trace its first k labels and its k-th."""
    g = stored(group_counts(lab, traces, seed), "early-groups")  # four levels share them
    at = lambda level, *on: g.where(F.col("level") == level).select(_name(level, *on), "kind", "label", F.col("n").alias("score"))
    held = draw(seed, "trace_id") % 1000 >= 700
    seen = lab.where(held).select(F.explode(F.array(*map(F.lit, KS))).alias("k"), "*").where("i <= k")
    first = seen.groupBy("k", "trace_id", "kind", "label").agg(F.count("*").alias("score")).select(_name("first", "k", "trace_id"), "kind", "label", "score")
    last = seen.groupBy("k", "trace_id", "kind").agg(F.max_by("label", "i").alias("label")).select(_name("last", "k", "trace_id"), "kind", "label", F.lit(1).cast("long").alias("score"))
    own = lab.where(~held).groupBy("trace_id", "kind", "label").agg(F.count("*").alias("n"))
    alike = _prefixes(lab).where(~held).join(own, "trace_id").groupBy("k", "prefix", "kind", "label").agg(F.sum("n").alias("score")).select(_name("prefix", "k", "prefix"), "kind", "label", "score")
    out = None
    for part in (at("global"), at("task", "task_id"), at("harness", "harness"), at("task+harness", "task_id", "harness"), first, last, alike):
        part = part.toDF("vec", "kind", "label", "score")
        out = part if out is None else out.unionByName(part)
    return out


#: Names of the baselines.
BASELINES = [*METADATA, "lastK", "last_step", "early_markov"]


def asked(keys: DataFrame, lab: DataFrame, traces: DataFrame, vecs: DataFrame, seed: int = 7) -> DataFrame:
    """keys (k, trace_id, kind, and more) once for each baseline, with the vector that the baseline uses there: a trace whose task or harness training does not know falls back, and so does a prefix that it does not know for that kind."""
    known = lambda level, *on: vecs.where(F.col("vec")[0] == level).select(*[F.col("vec")[i + 1].alias(c) for i, c in enumerate(on)]).distinct().withColumn(f"has_{level}", F.lit(True))
    about = traces.where(draw(seed, "trace_id") % 1000 >= 700).select("trace_id", F.col("task_id").cast("string").alias("task_id"), F.col("harness").cast("string").alias("harness"))
    about = about.join(known("task", "task_id"), "task_id", "left").join(known("harness", "harness"), "harness", "left").join(known("task+harness", "task_id", "harness"), ["task_id", "harness"], "left")
    task = F.when(F.col("has_task"), _name("task", "task_id")).otherwise(_name("global"))
    about = about.select("trace_id", task.alias("task"), F.when(F.col("has_harness"), _name("harness", "harness")).otherwise(_name("global")).alias("harness"), F.when(F.col("has_task+harness"), _name("task+harness", "task_id", "harness")).otherwise(task).alias("task+harness"))
    about = stored(about, "early-traces")  # apart from the joins below, so that the driver does not hold all small tables at once
    markov = vecs.where(F.col("vec")[0] == "prefix").select(F.col("vec")[1].cast("int").alias("k"), F.col("vec")[2].alias("prefix"), "kind").distinct()
    markov = _prefixes(lab).where(draw(seed, "trace_id") % 1000 >= 700).join(markov, ["k", "prefix"]).select("k", "trace_id", "kind", _name("prefix", "k", "prefix").alias("alike"))
    rows = keys.join(about, "trace_id").join(markov, ["k", "trace_id", "kind"], "left")
    uses = {"global": _name("global"), **{b: F.col(f"`{b}`") for b in ("task", "harness", "task+harness")}, "lastK": _name("first", "k", "trace_id"), "last_step": _name("last", "k", "trace_id"), "early_markov": F.coalesce("alike", _name("first", "k", "trace_id"))}
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("baseline"), uses[b].alias("vec")) for b in BASELINES])).alias("use")
    return rows.select(*keys.columns, pairs).select(*keys.columns, "use.baseline", "use.vec")


def metrics(lab: DataFrame, traces: DataFrame, leak_free: bool, seed: int = 7) -> DataFrame:
    """(k, baseline, target, traces, and for tools and phases cosine and top-3 recall) over held-out traces.

    target `whole` counts all labels of a trace, the observed ones too, as published figures do: baselines made of
    observed labels are right by construction. target `after_k` counts only what follows; traces without any are left out.

    A trace meets only the scores of labels that it has; a vector's length and its three best labels are worked out once for all traces that use it.
    """
    ks = F.explode(F.array(*map(F.lit, KS))).alias("k")
    lab = stored(lab, "early-labels")
    vecs = stored(vectors(lab, traces, seed), "early-vectors")
    held = lab.where(draw(seed, "trace_id") % 1000 >= 700).select(ks, "*")
    truth = (held.where("i > k") if leak_free else held).groupBy("k", "trace_id", "kind", "label").agg(F.count("*").cast("double").alias("truth"))
    w, score = Window.partitionBy("vec", "kind"), F.col("score").cast("double")
    place = F.row_number().over(w.orderBy(F.desc("score"), "label"))
    scored = vecs.select("vec", "kind", "label", score.alias("score"), (place <= 3).alias("top"), F.sum(score * score).over(w).alias("xx"))
    met = asked(truth, lab, traces, vecs, seed).join(scored, ["vec", "kind", "label"], "left")
    each = met.groupBy("k", "baseline", "trace_id", "kind", "vec").agg(F.sum(F.col("score") * F.col("truth")).alias("xy"), F.sum(F.col("truth") * F.col("truth")).alias("yy"), F.max("xx").alias("xx"), (F.count_if("top") / F.count("*")).alias("rec"))
    each = each.withColumn("cos", F.coalesce(F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")), F.lit(0.0)))
    mean = lambda c, kind, name: F.round(F.avg(F.when(F.col("kind") == kind, F.col(c))), 6).alias(name)
    return each.groupBy("k", "baseline").agg(
        F.count_if(F.col("kind") == "tool").alias("traces"), mean("cos", "tool", "tool_cosine"), mean("cos", "phase", "phase_cosine"),
        mean("rec", "tool", "future_tool_top3_recall"), mean("rec", "phase", "future_phase_top3_recall"),
    ).withColumn("target", F.lit("after_k" if leak_free else "whole"))


def prefix_recall(objects: DataFrame, traces: DataFrame, top: int = 5, seed: int = 7) -> DataFrame:
    """One row: of held-out traces with object prefixes, the mean share of a trace's prefixes that are among its first `top`; the same for every k and baseline."""
    held = traces.where(draw(seed, "trace_id") % 1000 >= 700).select("trace_id")
    n = objects.where("stable_object and object_prefix is not null").join(held, "trace_id", "left_semi").groupBy("trace_id").agg(F.count_distinct("object_prefix").alias("n"))
    return n.agg(F.count("*").alias("traces"), F.round(F.avg(F.least("n", F.lit(top)) / F.col("n")), 6).alias("object_prefix_top5_recall"))


def against_metadata(m: DataFrame) -> DataFrame:
    """Each baseline's tool recall less the best of the four that know only metadata, for each k."""
    best = F.max(F.when(F.col("baseline").isin(METADATA), F.col("future_tool_top3_recall"))).over(Window.partitionBy("k", "target"))
    return m.select("k", "target", "baseline", "future_tool_top3_recall", F.round(F.col("future_tool_top3_recall") - best, 6).alias("delta_vs_best_metadata_baseline"))


def auc_by_k(lab: DataFrame, traces: DataFrame, per_trace: DataFrame, seed: int = 7) -> DataFrame:
    """(k, baseline, long_trajectory_auc, failure_loop_auc) over held-out traces: how well the sum of a baseline's tool scores tells traces with more tool actions than the median of all, and the failure-loop score failures (the same for all)."""
    lab = stored(lab, "early-labels")
    vecs = stored(vectors(lab, traces, seed), "early-vectors")
    n = traces.select("trace_id").join(lab.where("kind = 'tool'").groupBy("trace_id").agg(F.count("*").alias("n")), "trace_id", "left").na.fill(0)
    middle = F.broadcast(quantiles(n, [], "n", {"m": 0.5}))  # one row
    held = n.join(middle).where(draw(seed, "trace_id") % 1000 >= 700).select("trace_id", (F.col("n") > F.col("m")).alias("long"))
    keys = lab.where(draw(seed, "trace_id") % 1000 >= 700).select("trace_id").distinct().select(F.explode(F.array(*map(F.lit, KS))).alias("k"), "trace_id", F.lit("tool").alias("kind"))
    total = vecs.where("kind = 'tool'").groupBy("vec").agg(F.sum("score").alias("score"))
    scored = asked(keys, lab, traces, vecs, seed).join(total, "vec").join(held, "trace_id")
    by_length = auc(scored, ["k", "baseline"], "score", "long").withColumnRenamed("auc", "long_trajectory_auc")
    failed = per_trace.where(draw(seed, "trace_id") % 1000 >= 700)
    return by_length.join(F.broadcast(failure_auc(failed).select(F.col("auc").alias("failure_loop_auc"))))  # one row


def failure_auc(metrics: DataFrame) -> DataFrame:
    """AUC of the whole-trace failure-loop score for failure."""
    return auc(metrics.withColumn("failed", ~F.col("success")).withColumn("target", F.lit("failure")), ["target"], "failure_loop_score", "failed")
