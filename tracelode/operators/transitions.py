"""Label transitions: entropy, next-label recall, bootstrap intervals and permutation controls."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ranks import digest, joined, number, numbered

KS = (1, 3, 5)


def draw(seed: int | str | Column, *keys: str) -> Column:
    """A number from md5 of a seed and keys: the same in every engine, whatever the partitioning."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


def transitions(rows: DataFrame, group: tuple[str, ...] = ("view",)) -> DataFrame:
    """Consecutive labels of each trace: (group, trace_id, step_id, current, next)."""
    w = Window.partitionBy(*group, "trace_id").orderBy("step_id")
    return rows.withColumn("next", F.lead("label").over(w)).where("next is not null").withColumnRenamed("label", "current")


def split(traces: DataFrame, seed: int = 7, share: float = 0.7) -> DataFrame:
    """(trace_id, part): a trace is in train if its draw is below the share. Each trace decides alone, so there is no global sort."""
    return traces.select("trace_id").distinct().withColumn("part", F.when(draw(seed, "trace_id") % 1000 < int(share * 1000), "train").otherwise("test"))


def entropy(trans: DataFrame) -> DataFrame:
    """Per view: transitions, H(next), H(next | current) and mutual information, in bits."""
    pairs = trans.groupBy("view", "current", "next").agg(F.count("*").alias("n"))
    v, c, x = Window.partitionBy("view"), Window.partitionBy("view", "current"), Window.partitionBy("view", "next")
    p = pairs.withColumn("total", F.sum("n").over(v)).withColumn("from", F.sum("n").over(c)).withColumn("to", F.sum("n").over(x))
    n = F.col("n")
    out = p.groupBy("view").agg(F.max("total").alias("transitions"), F.sum(-n / F.col("total") * F.log2(F.col("to") / F.col("total"))).alias("h"), F.sum(-n / F.col("total") * F.log2(n / F.col("from"))).alias("hc"))
    return out.select("view", "transitions", F.round("h", 6).alias("h_next"), F.round("hc", 6).alias("h_next_given_current"), F.round(F.col("h") - F.col("hc"), 6).alias("mutual_information"))


def matrix(trans: DataFrame, most: int = 30) -> DataFrame:
    """(view, current, next, n, p): rows sum to one; the `most` commonest current labels of each view."""
    pairs = trans.groupBy("view", "current", "next").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("view", "current"))
    place = F.dense_rank().over(Window.partitionBy("view").orderBy(F.desc("total"), "current"))
    return pairs.withColumn("total", total).withColumn("place", place).where(F.col("place") <= most).select("view", "current", "next", "n", F.round(F.col("n") / F.col("total"), 6).alias("p"))


def hits(train: DataFrame, test: DataFrame, group: list[str], by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """(group, by, n, cond_k, glob_k): test transitions whose next label is among the k commonest after the current one, or of all.

    A current label that training has not seen takes the global list. Both sides are counted before they are joined,
    so joins are between tables of labels, not of transitions.
    """
    count = lambda df, more: df.groupBy(*group, *more, "current", "next").agg(F.count("*").alias("n"))
    return hits_of(count(train, []), count(test, by), group, by, ks)


def hits_of(seen: DataFrame, asked: DataFrame, group: list[str], by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """hits() of transitions that are counted already: seen (group, current, next, n) in training, asked (also by) in the test."""
    top = max(ks)
    rank = F.row_number().over(Window.partitionBy(*group, "current").orderBy(F.desc("n"), "next"))
    cond = seen.withColumn("r", rank).where(F.col("r") <= top).select(*group, "current", "next", "r")
    every = seen.groupBy(*group, "next").agg(F.sum("n").alias("n")).withColumn("g", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "next"))).where(F.col("g") <= top).select(*group, "next", "g")
    known = seen.select(*group, "current").distinct().withColumn("known", F.lit(True))
    joined = asked.join(cond, [*group, "current", "next"], "left").join(every, [*group, "next"], "left").join(known, [*group, "current"], "left")
    place = F.when(F.col("known"), F.col("r")).otherwise(F.col("g"))
    each = [F.sum(F.when(c <= k, F.col("n")).otherwise(0)).alias(f"{name}_{k}") for name, c in (("cond", place), ("glob", F.col("g"))) for k in ks]
    return joined.groupBy(*group, *by).agg(F.sum("n").alias("n"), *each)


def parts(trans: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    rows = trans.withColumn("train", draw(seed, "trace_id") % 1000 < 700)
    return rows.where("train").drop("train"), rows.where("not train").drop("train")


def recall(trans: DataFrame, seed: int = 7) -> DataFrame:
    """(view, k, test_transitions, cond_recall, glob_recall, delta) on held-out traces."""
    return recall_of(hits(*parts(trans, seed), ["view"], []))


def recall_of(h: DataFrame) -> DataFrame:
    """recall() out of hits() by view."""
    long = h.select("view", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"cond_{k}").alias("c"), F.col(f"glob_{k}").alias("g")) for k in KS])).alias("x"))
    return long.select("view", "x.k", F.col("n").alias("test_transitions"), F.round(F.col("x.c") / F.col("n"), 6).alias("cond_recall"), F.round(F.col("x.g") / F.col("n"), 6).alias("glob_recall"), F.round((F.col("x.c") - F.col("x.g")) / F.col("n"), 6).alias("delta"))


def resampled(per_trace: DataFrame, group: list[str], sums: list[str], draws: int = 30, seed: int = 7) -> DataFrame:
    """(group, rep, drawn, sums): per-trace numbers summed over n traces drawn with replacement out of a group's n, `draws` times.

    A group's traces are numbered (see ranks.numbered). Each of them stands for one draw of a replicate, whose md5 names the number that is drawn, so every
    replicate has exactly n draws, all alike and independent: a multinomial. Draws are counted by number before they meet the traces.
    """
    n = stored(numbered(per_trace.select(*group, "trace_id", *sums), group, ["trace_id"]), "numbered-traces")
    picks = n.select(*group, "i", "total", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("rep"))
    picks = picks.select(*group, "rep", (number(digest(seed, F.lit("draw"), "rep", "i")) % F.col("total")).alias("i"))
    times = picks.groupBy(*group, "rep", "i").agg(F.count("*").alias("times"))
    met = joined(times, n.drop("total", "trace_id").hint("merge"), [*group, "i"])
    return met.groupBy(*group, "rep").agg(F.sum("times").alias("drawn"), *[F.sum(F.col("times") * F.col(c)).alias(c) for c in sums])


def interval(reps: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, low, high): percentiles 2.5 and 97.5 over replicates, which are few."""
    return reps.groupBy(*group).agg(F.round(F.percentile(value, 0.025), 6).alias("low"), F.round(F.percentile(value, 0.975), 6).alias("high"))


def bootstrap(trans: DataFrame, k: int = 3, draws: int = 30, seed: int = 7) -> DataFrame:
    """(view, low, high): percentiles of the recall delta over held-out traces drawn again (see resampled)."""
    return bootstrap_of(hits(*parts(trans, seed), ["view"], ["trace_id"]), k, draws, seed)


def bootstrap_of(per_trace: DataFrame, k: int = 3, draws: int = 30, seed: int = 7) -> DataFrame:
    """bootstrap() out of hits() by view and trace."""
    stats = per_trace.select("view", "trace_id", "n", (F.col(f"cond_{k}") - F.col(f"glob_{k}")).alias("gain"))
    reps = resampled(stats, ["view"], ["gain", "n"], draws, seed)
    return interval(reps.withColumn("delta", F.col("gain") / F.nullif("n", F.lit(0))), ["view"], "delta")


def bootstrap_by_trace(rows: DataFrame, partial: Callable[[pa.Table], dict[str, float]], sums: list[str], final: Column, draws: int = 50, seed: int = 7, chunk: int = 100_000) -> DataFrame:
    """One row (low, high): a bootstrap interval, by traces, of any statistic that follows from sums.

    partial gets the rows of a trace as an Arrow table (of a long trace, `chunk` steps at a time, so rows need trace_id and step_id) and returns its share of each of `sums`;
    final makes the statistic out of summed columns. Each row is looked at once, however many replicates there are. No rows: no interval.
    """

    def of(table: pa.Table) -> pa.Table:
        found = partial(table)
        return pa.table({"trace_id": table.column("trace_id").slice(0, 1).cast(pa.string()), **{c: pa.array([found[c]], pa.float64()) for c in sums}})

    schema = ", ".join(["trace_id string", *[f"{c} double" for c in sums]])
    pieces = rows.withColumn("chunk__", F.floor(F.col("step_id") / chunk)).groupBy("trace_id", "chunk__").applyInArrow(of, schema)
    each = pieces.groupBy("trace_id").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("all__", F.lit(1))
    return interval(resampled(each, ["all__"], sums, draws, seed).withColumn("value__", final), ["all__"], "value__").drop("all__")


#: How often a row's new number is looked for; one walk of so many steps ends outside for less than one in 10^16 tables.
WALKS = 16


def permuted(rows: DataFrame, i: str, total: str, to: str, *key: Column | str | int) -> DataFrame:
    """rows with `to`, the place of number i of 0 ... total - 1 in a permutation that a key names: every place is taken once, and no row has to know of another.

    A Feistel network of four rounds over pairs (i div b, i mod b), a * b being the least grid about a square that holds all numbers. A number that
    leaves 0 ... total - 1 goes on through the same network until it is back (cycle walking); fewer than a numbers of the grid lie outside.
    """
    n, sides, half = F.col(total), (F.col("a__"), F.col("b__")), ("l__", "r__")
    step = lambda r, own, other: (own + number(digest(*key, r, other))) % sides[r % 2]
    df = rows.withColumn("a__", F.ceil(F.sqrt(n.cast("double")))).withColumn("b__", F.ceil(n / F.col("a__")))
    df = df.withColumn("l__", F.floor(F.col(i) / F.col("b__"))).withColumn("r__", F.col(i) % F.col("b__"))
    for r in range(4):  # a column for each round, so that none is worked out twice
        df = df.withColumn(half[r % 2], step(r, F.col(half[r % 2]), F.col(half[1 - r % 2])))

    def again(x: Column) -> Column:
        pair = [F.floor(x / F.col("b__")), x % F.col("b__")]
        for r in range(4):
            pair[r % 2] = step(r, pair[r % 2], pair[1 - r % 2])
        return pair[0] * F.col("b__") + pair[1]

    x = F.col(to)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS - 1)), x, lambda y, _: F.when(y < n, y).otherwise(again(y)))
    return df.withColumn(to, F.col("l__") * F.col("b__") + F.col("r__")).withColumn(to, F.when(x < n, x).otherwise(walk)).drop("a__", "b__", "l__", "r__")


def shuffled(rows: DataFrame, control: str, replicates: int = 25, seed: int = 1007) -> DataFrame:
    """Replicates of transitions whose order is broken: (view, rep, trace_id, current, next), and what else rows have of their trace.

    within_trace deals each trace's labels out anew. global_next deals the next labels of a view out anew over all its traces: transitions are
    numbered, and each number's next label goes to the number that a permutation says (see permuted). No sort or window spans all rows.
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    more = [c for c in rows.columns if c not in ("view", "trace_id", "step_id", "label")]
    out = ["view", "rep", "trace_id", "current", "next", *more]
    if control == "within_trace":
        each = rows.select("*", rep).repartition("view", "rep", "trace_id")  # dealt before the digests are made, so that these do not travel
        order = Window.partitionBy("view", "rep", "trace_id").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep"), F.col("trace_id"), F.col("step_id"))))
        return each.withColumn("next", F.lead("label").over(order)).where("next is not null").withColumnRenamed("label", "current").select(out)
    if control != "global_next":
        raise ValueError(control)
    n = stored(numbered(transitions(rows), ["view"], ["trace_id", "step_id"]), "numbered-transitions")
    right = permuted(n.select("view", rep, "i", "total", "next"), "i", "total", "to", seed, "rep").select("view", "rep", F.col("to").alias("i"), "next")
    return n.select("view", "i", "trace_id", "current", *more).join(right.hint("merge"), ["view", "i"]).select(out)


def permutation_test(rows: DataFrame, k: int = 3, replicates: int = 25, seed: int = 1007) -> DataFrame:
    """(view, control, observed, null_mean, p): the recall delta against two controls. The least p is 1 / (replicates + 1).

    Each control is counted by labels once, all replicates in one job, and its counts are stored: what compares them sees tables of
    labels only, and no plan holds a control more than once.
    """
    rows = rows.withColumn("train", draw(7, "trace_id") % 1000 < 700)
    counts = None
    for control in ("observed", "within_trace", "global_next"):
        each = transitions(rows).withColumn("rep", F.lit(0)) if control == "observed" else shuffled(rows, control, replicates, seed)
        n = stored(each.groupBy("view", "rep", "train", "current", "next").agg(F.count("*").alias("n")), "permuted-pairs").withColumn("control", F.lit(control))
        counts = n if counts is None else counts.unionByName(n)
    counts = stored(counts, "permuted-pairs")  # one table, as it is read four times
    found = hits_of(counts.where("train"), counts.where("not train"), ["view", "control", "rep"], [])
    d = found.select("view", "control", ((F.col(f"cond_{k}") - F.col(f"glob_{k}")) / F.col("n")).alias("d"))
    real = F.max(F.when(F.col("control") == "observed", F.col("d"))).over(Window.partitionBy("view"))  # over a row for each replicate
    null = d.withColumn("observed", real).where("control <> 'observed' and observed is not null")
    return null.groupBy("view", "control").agg(F.round(F.max("observed"), 6).alias("observed"), F.round(F.avg("d"), 6).alias("null_mean"), F.round((F.count_if(F.round("d", 9) >= F.round("observed", 9)) + 1) / (F.count("*") + 1), 6).alias("p"))
