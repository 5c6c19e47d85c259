"""Summaries of data dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ranks import below, joined


def _distance(deps: DataFrame) -> DataFrame:
    return deps.withColumn("distance", F.col("dst_step_id") - F.col("src_step_id"))


def summary(deps: DataFrame, traces: DataFrame) -> DataFrame:
    """Per type: count, traces, median distance and count per trace of all; one row `none` without dependencies."""
    n = traces.agg(F.count("*").alias("all"))
    out = _distance(deps).groupBy("dependency_type").agg(F.count("*").alias("count"), F.count_distinct("trace_id").alias("traces"), F.median("distance").alias("median_distance"))
    none = deps.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("none").alias("dependency_type"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("traces"), F.lit(None).cast("double").alias("median_distance"))
    return out.unionByName(none).join(F.broadcast(n)).withColumn("per_trace", F.round(F.col("count") / F.nullif(F.col("all"), F.lit(0)), 6)).drop("all")  # one row is broadcast


def tool_pairs(deps: DataFrame) -> DataFrame:
    return deps.groupBy("src_tool", "dst_tool", "dependency_type").agg(F.count("*").alias("count"))


def top_pairs(deps: DataFrame, top: int = 100) -> DataFrame:
    return tool_pairs(deps).orderBy(F.desc("count"), "src_tool", "dst_tool", "dependency_type").limit(top)


def by_horizon(deps: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Dependencies of each type within each horizon."""
    d = _distance(deps).groupBy("dependency_type").agg(*[F.count_if(F.col("distance") <= h).alias(f"h{h}") for h in horizons])
    return d.select("dependency_type", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("count")) for h in horizons])).alias("x")).select("dependency_type", "x.*")


def ecdf(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, share of rows at or below): counted by value, and summed range by range (see ranks.below)."""
    n = stored(rows.groupBy(*group, value).agg(F.count("*").alias("n")), "values")
    total = n.groupBy(*group).agg(F.sum("n").alias("total"))
    return joined(below(n, group, value), total, group).select(*group, value, F.round((F.col("below") + F.col("n")) / F.col("total"), 6).alias("share"))


def distance_ecdf(deps: DataFrame) -> DataFrame:
    return ecdf(_distance(deps), ["dependency_type"], "distance")


def pair_pivot(deps: DataFrame, tools: list[str]) -> DataFrame:
    """Source tools by destination tools; the columns are given, so no job looks for them."""
    return deps.groupBy("src_tool").pivot("dst_tool", tools).agg(F.count(F.lit(1))).na.fill(0)
