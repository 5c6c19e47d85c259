"""Ranks, order statistics and row numbers without a window over all rows of a group.

Values are cut into ranges: a number by the first bits of its place in the order of all numbers, a row by the first bits of a digest. Counts
of ranges are summed first, sums are carried from range to range, and only then are the values of a range ordered. No window
holds more than a fixed number of rows, whatever the values: ranges of ranges have at most 2**22 parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored

#: Bits that are left off to name the coarse and the fine range of a place; 22, 21 and 21 bits make 64.
COARSE, FINE = 42, 21
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_LOW = -(1 << 63)


def place(df: DataFrame, column: str) -> Column:
    """A whole number of 64 bits for each value of a column of numbers, in the order of the values: nulls first, NaN last, both zeros alike. Decimals go as doubles."""
    if isinstance(df.schema[column].dataType, _INTEGRAL):
        return F.coalesce(F.col(column).cast("long"), F.lit(_LOW))
    x = F.coalesce(F.col(column).cast("double"), F.lit(0.0)) + 0.0
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("long")
    return F.when(F.col(column).isNull(), F.lit(_LOW)).when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """a and b where these columns are the same, nulls too; they stand there once."""
    right = b.withColumnsRenamed({c: f"{c}__r" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__r"))
    return a.join(right, same, how).drop(*[f"{c}__r" for c in on])


def _before(amount: str, within: list[str], order: list[str]) -> Column:
    """Sum of an amount over the rows before."""
    return F.coalesce(F.sum(amount).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def below(counts: DataFrame, group: list[str], value: str, amount: str = "n") -> DataFrame:
    """counts (one row for each value of a group) with `below`, the amount of all smaller values of the group."""
    d = counts.withColumn("o__", place(counts, value)).withColumn("c__", F.shiftright("o__", COARSE)).withColumn("f__", F.shiftright("o__", FINE))
    fine = d.groupBy(*group, "c__", "f__").agg(F.sum(amount).alias("m__"))
    coarse = fine.groupBy(*group, "c__").agg(F.sum("m__").alias("k__"))
    coarse = coarse.withColumn("b__", _before("k__", group, ["c__"])).drop("k__")
    fine = joined(fine, coarse, [*group, "c__"]).withColumn("b__", F.col("b__") + _before("m__", [*group, "c__"], ["f__"])).drop("m__")
    out = joined(d, fine, [*group, "c__", "f__"])
    return out.withColumn("below", F.col("b__") + _before(amount, [*group, "c__", "f__"], ["o__"])).drop("o__", "c__", "f__", "b__")


def quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each share): quantiles of the values that are not null, linear between neighbours; null if there are none.

    Selection: counts of coarse ranges say which of them holds a rank, those of its fine ranges which of these does, and only values of that one
    are ordered. A value is a row with its count, so repeated values cost nothing.
    """
    one = "all__"
    rows = rows.withColumn(one, F.lit(1))
    by = [*group, one]
    n = stored(rows.groupBy(*by, value).agg(F.count(value).alias("n__")), "values")
    total = n.groupBy(*by).agg(F.sum("n__").alias("total__"))
    n = n.where(F.col(value).isNotNull())
    n = n.withColumn("o__", place(n, value)).withColumn("c__", F.shiftright("o__", COARSE)).withColumn("f__", F.shiftright("o__", FINE))
    at = {k: (F.col("total__") - 1) * F.lit(float(p)) for k, p in shares.items()}
    ends = [end(x).cast("long") for x in at.values() for end in (F.floor, F.ceil)]
    wanted = total.where("total__ > 0").select(*by, F.explode(F.array_distinct(F.array(*ends))).alias("rank__"), F.lit(0).cast("long").alias("base__"))

    def holding(known: list[str], finer: list[str]) -> DataFrame:
        """wanted, with the part of its range that holds the rank, and how much stands before that."""
        keys = [*by, *known]
        some = n if not known else joined(n, wanted.select(*keys).distinct(), keys, "left_semi")
        parts = some.groupBy(*keys, *finer).agg(F.sum("n__").alias("m__")).withColumn("b__", _before("m__", keys, finer[:1]))
        met = joined(wanted, parts, keys)
        return met.where("rank__ - base__ >= b__ and rank__ - base__ < b__ + m__").withColumn("base__", F.col("base__") + F.col("b__")).drop("b__", "m__")

    for known, finer in (([], ["c__"]), (["c__"], ["f__"]), (["c__", "f__"], ["o__", value])):
        wanted = holding(known, finer)
    found = joined(total, wanted.select(*by, "rank__", F.col(value).cast("double").alias("v__")), by, "left")
    pick = lambda c: F.max(F.when(F.col("rank__") == c.cast("long"), F.col("v__")))
    out = found.groupBy(*by, "total__").agg(*[pick(end(x)).alias(f"{end.__name__}_{k}") for k, x in at.items() for end in (F.floor, F.ceil)])
    between = [(F.col(f"floor_{k}") + (at[k] - F.floor(at[k])) * (F.col(f"ceil_{k}") - F.col(f"floor_{k}"))).alias(k) for k in shares]
    return out.select(*group, *between)


def digest(*parts: Column | str | int) -> Column:
    """md5 of parts with bars between them: the same in every engine, however rows are dealt."""
    return F.md5(F.concat_ws("|", *[(F.lit(str(p)) if isinstance(p, int) else p if isinstance(p, Column) else F.col(p)).cast("string") for p in parts]))


def number(hexes: Column, digits: int = 15) -> Column:
    """The first digits of a digest as a number."""
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("long")


def numbered(rows: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """rows with `i`, 0, 1, ... in the order of the md5 of their keys, and `total`, the rows of their group.

    The first four hex digits make 65,536 ranges of about the same size; their counts are summed, then each range numbers its own
    rows. Equal keys follow no order.
    """
    d = rows.withColumn("d__", digest(*keys)).withColumn("r__", F.substring("d__", 1, 4))
    counts = d.groupBy(*group, "r__").agg(F.count("*").alias("n__"))
    start = counts.withColumn("b__", _before("n__", group, ["r__"])).withColumn("total", F.sum("n__").over(Window.partitionBy(*group))).drop("n__")
    out = joined(d, start.hint("merge"), [*group, "r__"])
    return out.withColumn("i", F.col("b__") + F.row_number().over(Window.partitionBy(*group, "r__").orderBy("d__")) - 1).drop("d__", "r__", "b__")
