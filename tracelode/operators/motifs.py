"""Frequent label n-grams of traces, with support in held-out traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .transitions import draw
from .views import view_steps

KINDS = {"collapsed_semantic_tool_tool_action_only": "tool", "collapsed_phase_clean_tool_action_only": "phase"}


def sequences(steps: DataFrame, objects: DataFrame) -> DataFrame:
    """(kind, trace_id, seq): collapsed tool and phase labels, and tools followed by the kinds of the first objects (stateflow)."""
    rows = view_steps(steps, list(KINDS))
    kind = F.when(F.col("view") == "collapsed_phase_clean_tool_action_only", "phase").otherwise("tool")
    seq = rows.groupBy(kind.alias("kind"), "trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_id", "label"))), lambda x: x["label"]).alias("seq"))
    first = F.row_number().over(Window.partitionBy("trace_id").orderBy("step_id", "object_type", "object_id"))
    objs = objects.select("trace_id", "step_id", "object_type", "object_id", first.alias("r")).where("r <= 50").groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("object_type", F.lit("_object")).alias("o")))), lambda x: x["o"]).alias("objs"))
    flow = seq.where("kind = 'tool'").join(objs, "trace_id", "left")
    n = F.greatest(F.lit(1), F.floor(F.size("seq") / 2).cast("int"))
    joined = F.when(F.col("objs").isNotNull(), F.slice(F.concat("seq", F.slice("objs", 1, n)), 1, 100)).otherwise(F.slice("seq", 1, 80))
    return seq.unionByName(flow.select(F.lit("stateflow").alias("kind"), "trace_id", joined.alias("seq")))


def ngrams(seqs: DataFrame) -> DataFrame:
    """(kind, trace_id, n, motif): distinct n-grams of 2 to 5 labels of each trace."""
    grams = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(5)), lambda n: F.when(F.size("seq") >= n, F.transform(F.sequence(F.lit(1), F.size("seq") - n + 1), lambda i: F.struct(n.alias("n"), F.array_join(F.slice(F.col("seq"), i, n), " -> ").alias("motif")))).otherwise(F.array().cast("array<struct<n:int,motif:string>>"))))
    return seqs.select("kind", "trace_id", F.explode(F.array_distinct(grams)).alias("g")).select("kind", "trace_id", "g.n", "g.motif")


def motifs(seqs: DataFrame, traces: DataFrame, seed: int = 7, top: int = 100) -> DataFrame:
    """The motifs of each kind with most training traces: support in train and held-out traces, in tasks and harnesses, and the success rate.

    One aggregation of distinct (trace, motif) rows; the cut to `top` ranks only motifs, after they are counted.
    """
    about = traces.select("trace_id", "task_id", "harness", F.col("success").cast("double").alias("won"))
    rows = ngrams(seqs).withColumn("train", draw(seed, "trace_id") % 1000 < 700).join(about, "trace_id", "left")
    n = rows.groupBy("kind", "n", "motif").agg(F.count_if("train").alias("support_traces"), F.count_if(~F.col("train")).alias("heldout_support"), F.count_distinct("task_id").alias("support_tasks"), F.count_distinct("harness").alias("support_harnesses"), F.round(F.avg("won"), 6).alias("success_rate"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("support_traces"), "motif"))
    return n.where("support_traces > 0").withColumn("r", rank).where(F.col("r") <= top).drop("r").withColumn("appears_in_heldout", F.col("heldout_support") > 0)
