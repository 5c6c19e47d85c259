"""Object reuse: working sets, reuse distances, and predictions of the objects used next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .dependencies import ecdf

HORIZONS = (1, 3, 5, 10)
#: Names of granularities, and the column of each.
GRANULARITIES = {"exact_object_id": "object_id", "path_prefix": "object_prefix", "object_type": "object_type"}


def accesses(objects: DataFrame) -> DataFrame:
    """Stable accesses in long form: (granularity, trace_id, step_id, item)."""
    keys = F.explode(F.array(*[F.struct(F.lit(g).alias("granularity"), F.col(c).alias("item")) for g, c in GRANULARITIES.items()])).alias("x")
    rows = objects.where("stable_object and actionable_object").select("trace_id", "step_id", "object_id", keys).select("x.granularity", "trace_id", "step_id", "x.item", "object_id")
    return rows.where("item is not null and (granularity <> 'exact_object_id' or object_id like 'file:%')").drop("object_id")


def reuse_distances(acc: DataFrame) -> DataFrame:
    """Steps since the same item was last used in the trace; 0 within a step."""
    w = Window.partitionBy("granularity", "trace_id", "item").orderBy("step_id")
    return acc.withColumn("distance", F.col("step_id") - F.lag("step_id").over(w)).where("distance is not null")


def summary(acc: DataFrame) -> DataFrame:
    """Per granularity: accesses, items, the share of accesses to the hottest tenth of items, and the median reuse distance."""
    n = acc.groupBy("granularity", "item").agg(F.count("*").alias("n"))
    same = n.groupBy("granularity", "n").agg(F.count("*").alias("m"))  # items with the same count are alike: ranked are counts, not items
    upto, every = Window.partitionBy("granularity").orderBy(F.desc("n")), Window.partitionBy("granularity")
    ranked = same.withColumn("before", F.sum("m").over(upto) - F.col("m")).withColumn("items", F.sum("m").over(every))
    within = F.greatest(F.least(F.ceil(F.col("items") * 0.1) - F.col("before"), F.col("m")), F.lit(0))
    top = ranked.groupBy("granularity").agg(F.sum(F.col("n") * F.col("m")).alias("accesses"), F.max("items").alias("items"), F.round(F.sum(F.col("n") * within) / F.sum(F.col("n") * F.col("m")), 6).alias("top10pct_coverage"))
    return top.join(reuse_distances(acc).groupBy("granularity").agg(F.median("distance").alias("median_reuse_distance")), "granularity", "left")


def reuse_ecdf(acc: DataFrame) -> DataFrame:
    return ecdf(reuse_distances(acc), ["granularity"], "distance")


def top_items(acc: DataFrame, top: int = 100) -> DataFrame:
    n = acc.where("granularity <> 'object_type'").groupBy("granularity", "item").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("granularity").orderBy(F.desc("n"), "item"))
    return n.withColumn("place", rank).where(F.col("place") <= top)


def points(steps: DataFrame, acc: DataFrame) -> DataFrame:
    """(granularity, trace_id, step_id, horizon, truth): items used within the horizon after each tool action that has any.

    A range frame per horizon over one sorted pass of steps and accesses of a trace; no self join.
    """
    use = acc.where("granularity <> 'object_type'").select("granularity", "trace_id", "step_id", "item", F.lit(False).alias("ask"))
    ask = steps.where("is_tool_action").select(F.explode(F.array(F.lit("exact_object_id"), F.lit("path_prefix"))).alias("granularity"), "trace_id", "step_id", F.lit(None).cast("string").alias("item"), F.lit(True).alias("ask"))
    w = Window.partitionBy("granularity", "trace_id").orderBy("step_id")
    rows = use.unionByName(ask).select("*", *[F.collect_set("item").over(w.rangeBetween(1, h)).alias(f"h{h}") for h in HORIZONS]).where("ask")
    long = rows.select("granularity", "trace_id", "step_id", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("truth")) for h in HORIZONS])).alias("x"))
    return long.select("granularity", "trace_id", "step_id", "x.*").where(F.size("truth") > 0)


def last_k(steps: DataFrame, acc: DataFrame, k: int = 5) -> DataFrame:
    """(granularity, trace_id, step_id, pred): items of the last k accesses up to each tool action."""
    use = acc.where("granularity <> 'object_type'").select("granularity", "trace_id", "step_id", "item", F.lit(False).alias("ask"))
    ask = steps.where("is_tool_action").select(F.explode(F.array(F.lit("exact_object_id"), F.lit("path_prefix"))).alias("granularity"), "trace_id", "step_id", F.lit(None).cast("string").alias("item"), F.lit(True).alias("ask"))
    # questions come after the accesses of their step; the frame counts accesses only, by their number
    order = Window.partitionBy("granularity", "trace_id").orderBy("step_id", "ask", "item")
    rows = use.unionByName(ask).withColumn("nth", F.count("item").over(order))
    w = Window.partitionBy("granularity", "trace_id").orderBy("nth").rangeBetween(-(k - 1), 0)
    return rows.withColumn("pred", F.collect_set("item").over(w)).where("ask").select("granularity", "trace_id", "step_id", "pred")


def item_counts(acc: DataFrame, traces: DataFrame) -> DataFrame:
    """(granularity, task_id, harness, item, n): how often an item is used."""
    return acc.where("granularity <> 'object_type'").join(traces.select("trace_id", "task_id", "harness"), "trace_id").groupBy("granularity", "task_id", "harness", "item").agg(F.count("*").alias("n"))


def hot(counts: DataFrame, by: list[str], top: int = 5) -> DataFrame:
    """The hottest items of each granularity (and task or harness) out of item_counts(): (granularity, by, pred)."""
    n = counts.groupBy("granularity", *by, "item").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("granularity", *by).orderBy(F.desc("n"), "item"))
    return n.withColumn("r", rank).where(F.col("r") <= top).groupBy("granularity", *by).agg(F.collect_set("item").alias("pred"))


def predictions(steps: DataFrame, acc: DataFrame, traces: DataFrame) -> DataFrame:
    """Mean top-5 recall by granularity, baseline and horizon: (granularity, baseline, horizon, points, recall).

    Hot lists are fit on all traces, evaluated ones too. object_type_only predicts the bare type, which never equals
    an id: its recall is 0 by construction, and it is asked of ids only. random takes five items by md5. For prefixes the baselines' names end in _prefix.
    """
    asked = points(steps, acc).join(traces.select("trace_id", "task_id", "harness"), "trace_id")
    items = acc.where("granularity <> 'object_type'").select("granularity", "item").distinct()
    rank = F.row_number().over(Window.partitionBy("granularity").orderBy(F.md5(F.concat(F.lit("7|"), F.col("item"))), "item"))
    chance = items.withColumn("r", rank).where("r <= 5").groupBy("granularity").agg(F.collect_set("item").alias("pred"))
    counts = stored(item_counts(acc, traces), "item-counts")  # three hot lists share them
    tables = [("lastK_object", last_k(steps, acc), ["granularity", "trace_id", "step_id"]), ("global_hot_object", hot(counts, []), ["granularity"]), ("task_hot_object", hot(counts, ["task_id"]), ["granularity", "task_id"]), ("harness_hot_object", hot(counts, ["harness"]), ["granularity", "harness"]), ("random_same_count", chance, ["granularity"])]
    df = asked
    for name, table, on in tables:
        table = table.withColumnRenamed("pred", name)
        df = df.join(F.broadcast(table) if on == ["granularity"] else table, on, "left")  # one list of five items for each granularity
    score = lambda p: F.size(F.array_intersect(p, "truth")) / F.size("truth")
    named = [(n, F.coalesce(F.col(n), F.array().cast("array<string>"))) for n, _, _ in tables] + [("object_type_only", F.array(F.lit("file")))]
    long = df.select("granularity", "horizon", F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), score(p).alias("recall")) for n, p in named])).alias("x")).select("granularity", "horizon", "x.*")
    prefix = F.when(F.col("baseline") == "random_same_count", "random_prefix").otherwise(F.replace("baseline", F.lit("_object"), F.lit("_prefix")))
    long = long.where("granularity = 'exact_object_id' or baseline <> 'object_type_only'").withColumn("baseline", F.when(F.col("granularity") == "path_prefix", prefix).otherwise(F.col("baseline")))
    return long.groupBy("granularity", "baseline", "horizon").agg(F.count("*").alias("points"), F.round(F.avg("recall"), 6).alias("recall"))
