"""Failure-loop metrics of each trace, and their comparison between outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dependencies import ecdf
from .ranks import quantiles
from .stats import mann_whitney

#: Names of the metrics.
METRICS = ["semantic_tool_entropy", "phase_entropy", "repeated_semantic_tool_ratio", "repeated_phase_ratio", "repeated_object_ratio", "repeated_path_prefix_ratio", "max_same_tool_run_length", "error_rate", "repeated_error_signature_count", "repeated_test_case_count", "no_progress_loop_score", "failure_loop_score"]


def _acts(steps: DataFrame) -> DataFrame:
    return steps.where("is_tool_action and not command_artifact_flag")


def _entropy(acts: DataFrame, column: str, name: str) -> DataFrame:
    n = acts.groupBy("trace_id", column).agg(F.count("*").alias("n"))
    return n.groupBy("trace_id").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias(name))


def per_trace(steps: DataFrame, objects: DataFrame, traces: DataFrame) -> DataFrame:
    """One row for each trace with the twelve metrics and success (null counts as failure)."""
    acts = _acts(steps)
    repeat = lambda c: (1 - F.count_distinct(c) / F.nullif(F.count(c), F.lit(0)))
    base = acts.groupBy("trace_id").agg(F.count("*").alias("n"), repeat("semantic_tool_clean").alias("repeated_semantic_tool_ratio"), repeat("phase_clean").alias("repeated_phase_ratio"), F.avg(F.col("error_flag").cast("double")).alias("error_rate"))
    w = Window.partitionBy("trace_id").orderBy("step_id")
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("trace_id", "semantic_tool_clean").orderBy("step_id"))
    runs = acts.withColumn("i", island).groupBy("trace_id", "semantic_tool_clean", "i").agg(F.count("*").alias("run")).groupBy("trace_id").agg(F.max("run").alias("max_same_tool_run_length"))
    extra = lambda t: (F.count(F.when(F.col("object_type") == t, F.col("object_id"))) - F.count_distinct(F.when(F.col("object_type") == t, F.col("object_id"))))
    objs = objects.where("stable_object").groupBy("trace_id").agg(repeat("object_id").alias("repeated_object_ratio"), repeat("object_prefix").alias("repeated_path_prefix_ratio"), extra("error_signature").alias("repeated_error_signature_count"), extra("test_case").alias("repeated_test_case_count"), F.count_if(F.col("object_type") == "error_signature").alias("n_err"))
    own = base
    for part in (runs, objs, _entropy(acts, "semantic_tool_clean", "semantic_tool_entropy"), _entropy(acts, "phase_clean", "phase_entropy")):
        own = own.unionByName(part, allowMissingColumns=True)
    own = own.groupBy("trace_id").agg(*[F.max(x).alias(x) for x in own.columns if x != "trace_id"])  # each column comes from one part: one join instead of five
    df = traces.select("trace_id", F.coalesce("success", F.lit(False)).alias("success")).join(own, "trace_id", "left").na.fill(0)
    c = F.col
    df = df.withColumn("no_progress_loop_score", (c("repeated_semantic_tool_ratio") + c("repeated_object_ratio") + c("error_rate")) / 3)
    loops = F.least(c("repeated_error_signature_count") / F.greatest(c("n_err"), F.lit(1)), F.lit(1.0)) + F.least(c("max_same_tool_run_length") / F.greatest(c("n"), F.lit(1)), F.lit(1.0))
    score = (c("repeated_semantic_tool_ratio") + c("repeated_phase_ratio") + c("repeated_object_ratio") + c("repeated_path_prefix_ratio") + c("error_rate") + loops) / 7
    return df.withColumn("failure_loop_score", score).select("trace_id", "success", *[F.round(c(m).cast("double"), 9).alias(m) for m in METRICS])


def long(metrics: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("x")
    return metrics.select("trace_id", "success", pairs).select("trace_id", (~F.col("success")).alias("failed"), "x.*")


def comparison(metrics: DataFrame) -> DataFrame:
    """Per metric: means of successes and failures, their difference, Mann-Whitney's U of the failures, its normal deviate z and its two-sided p."""
    rows = long(metrics)
    means = rows.groupBy("metric").agg(F.round(F.avg(F.when(~F.col("failed"), F.col("value"))), 6).alias("success_mean"), F.round(F.avg(F.when(F.col("failed"), F.col("value"))), 6).alias("failure_mean"))
    return means.withColumn("delta_failure_minus_success", F.round(F.col("failure_mean") - F.col("success_mean"), 6)).join(mann_whitney(rows, ["metric"], "value", "failed"), "metric")


def cumulative(metrics: DataFrame) -> DataFrame:
    """(metric, success, value, share): how many traces of an outcome have at most so many repeated errors, or so long a run of one tool."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("repeated_error_signature_count", "max_same_tool_run_length")])).alias("x")
    return ecdf(metrics.select("success", pairs).select("success", "x.*"), ["metric", "success"], "value")


def box(metrics: DataFrame) -> DataFrame:
    """Quartiles by metric and outcome."""
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return quantiles(long(metrics), ["metric", "failed"], "value", shares).select("metric", "failed", *[F.round(c, 6).alias(c) for c in shares])


def repeated_errors(objects: DataFrame, top: int = 100) -> DataFrame:
    return objects.where("object_type = 'error_signature'").groupBy("object_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "object_id").limit(top)
