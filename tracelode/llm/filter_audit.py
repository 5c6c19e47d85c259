"""Which filter removes what: joint-failure counts of all sets of filters, inverted for every order of applying them."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

FILTERS = "ABCDE"
#: What stands between words.
WHITE = " \t\n\x0b\f\r"
SETS = 1 << len(FILTERS)


def text_failures(text: Column) -> dict[str, Column]:
    """Failure of the filters that one text decides. A: under 50 words; B: under 65 % distinct words; C: over 5 % A-Z; D: a symbol of #$%&*|."""
    ends = F.trim(text, F.lit(WHITE))
    words = F.when(ends == "", F.array().cast("array<string>")).otherwise(F.split(ends, r"[ \x09-\x0D]+"))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, and for each filter whether the row fails it. E: the text stands under a smaller doc_id too, whatever filters say of that row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flags = rows.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()])
    flags = stored(flags, "audit-flags")
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    first = stored(first, "audit-copies")  # so that the join below is between two plain shuffles, and hot texts are split
    return flags.join(first, "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("digest", "first")


def joint_failures(rows: DataFrame, weights: dict[str, str]) -> DataFrame:
    """part, and for each weight (SQL, a whole number) an array over the 32 sets of filters, by bit mask: weighted rows that fail all filters of the set, as sums of products of flags."""
    flags = rows.select("part", *[F.expr(f"cast({w} as long)").alias(k) for k, w in weights.items()], *[F.col(f).cast("long").alias(f) for f in FILTERS])
    product = lambda k, s: " * ".join([k, *[f for i, f in enumerate(FILTERS) if s >> i & 1]])
    found = flags.groupBy("part").agg(*[F.expr(f"sum({product(k, s)})").alias(f"{k}{s}") for k in weights for s in range(SETS)])
    return found.select("part", *[F.array(*[f"{k}{s}" for s in range(SETS)]).alias(k) for k in weights])


def _signed(joint: str, odd: int) -> str:
    return f"if(bit_count(s) % 2 = {odd}, {joint}[s], -{joint}[s])"


def survivors(joint: str) -> Column:
    """For each set of filters, by bit mask, the rows that fail none of them: inclusion and exclusion over its subsets."""
    return F.expr(f"transform(sequence(0, {SETS - 1}), m -> aggregate(filter(sequence(0, {SETS - 1}), s -> (s & m) = s), 0L, (acc, s) -> acc + {_signed(joint, 0)}))")


def unique_failures(joint: str) -> Column:
    """For each filter the rows that fail it and no other: Moebius inversion over the sets that hold it."""
    return F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), f -> aggregate(filter(sequence(0, {SETS - 1}), s -> (s & shiftleft(1, f)) != 0), 0L, (acc, s) -> acc + {_signed(joint, 1)}))")


def shapley(joint: str) -> Column:
    """For each filter what it removes, summed over all orders.

    The Harsanyi dividend of a set in the game "rows removed by these filters" is its joint-failure count, negative for sets
    of even size. Its members share it equally, and as many orders as there are make all shares whole numbers.
    """
    orders = factorial(len(FILTERS))
    return F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), f -> aggregate(filter(sequence(1, {SETS - 1}), s -> (s & shiftleft(1, f)) != 0), 0L, (acc, s) -> acc + {orders} div bit_count(s) * {_signed(joint, 1)}))")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source; null: empty), order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Each row of docs gives five flags. One aggregation by part sums their products for the 32 sets of filters, for all rows, those
    with quality 1 and those with toxic 1; all 600 rows of a part follow from these 96 numbers. Flags are summed before they are
    shuffled, so a hot source costs a row for each task.

    Null texts are empty (they fail A only, and E where an empty text stands under a smaller doc_id). Rows count each time they are repeated. A row
    without a doc_id fails E never, makes no other row fail it, and has no labels. Several labels of one doc_id count as one that
    has quality 1 (toxic 1) if one of them has. No rows: no rows. Other columns are ignored.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    rows = failures(docs)
    rows = rows.join(marks, rows.doc_id == marks.label_id, "left")
    joint = joint_failures(rows, {"n": "1", "g": "coalesce(good, false)", "t": "coalesce(bad, false)"})
    values = joint.select("part", F.col("n").alias("joint"), *[survivors(k).alias(k) for k in "ngt"], unique_failures("n").alias("unique"), shapley("n").alias("shapley"))
    steps = []
    for order in permutations(range(len(FILTERS))):
        mask = 0
        for step, f in enumerate(order, 1):
            steps.append({"order": "".join(FILTERS[i] for i in order), "step": step, "filter": f, "before": mask, "after": mask | 1 << f})
            mask |= 1 << f
    # a fixed list of 600 steps, as one literal: no table to join
    kind = "array<struct<order:string,step:int,filter:int,before:int,after:int>>"
    each = values.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(steps)), kind)))
    lost = lambda c: F.col(c)[F.col("s.before")] - F.col(c)[F.col("s.after")]
    single = F.element_at("joint", F.expr("shiftleft(1, s.filter) + 1"))
    return each.select(
        "part", F.col("s.order").alias("filter_order"), F.col("s.step").alias("step"), F.col("n")[F.col("s.after")].alias("kept"), lost("n").alias("removed"), (single - lost("n")).alias("redundant"),
        F.col("unique")[F.col("s.filter")].alias("unique_fails"), lost("g").alias("good_lost"), lost("t").alias("toxic_lost"), F.col("shapley")[F.col("s.filter")].alias("shapley"),
    )
