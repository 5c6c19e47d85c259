"""Rank statistics as grouped aggregations over counts of distinct values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored
from .ranks import below


def rank_sums(rows: DataFrame, group: list[str], score: str, positive: str) -> DataFrame:
    """(group, pos, neg, rank_sum, ties): mid-ranks of the positive rows. Scores are counted before they are ranked, so ties cost one row, and ranked range by range (see ranks.below)."""
    n = below(stored(rows.groupBy(*group, score).agg(F.count("*").alias("n"), F.count_if(positive).alias("p")), "scores"), group, score)
    mid = F.col("below") + (F.col("n") + 1) / 2
    t = F.col("n").cast("double")
    return n.groupBy(*group).agg(F.sum("p").alias("pos"), (F.sum("n") - F.sum("p")).alias("neg"), F.sum(F.col("p") * mid).alias("rank_sum"), F.sum(t * t * t - t).alias("ties"))


def auc(rows: DataFrame, group: list[str], score: str, positive: str) -> DataFrame:
    """(group, auc): null if one class is missing."""
    p, q = F.col("pos"), F.col("neg")
    return rank_sums(rows, group, score, positive).select(*group, F.round(F.try_divide(F.col("rank_sum") - p * (p + 1) / 2, p * q), 6).alias("auc"))


#: Coefficients of a Chebyshev fit of erfc, good to 1.2e-7 of its value everywhere.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    """Complementary error function of a number that is not negative."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


#: Samples of which the smaller has so many values at most get their exact p if no two values are equal, as long as there are so many places of U.
SMALL, MOST = 8, 1_000_000


def orders_up_to(m: int, n: int, u: int) -> int:
    """In how many orders of m and n values, none equal, U is u or less: coefficients of a Gaussian binomial, one factor after the other."""
    ways = [1] + [0] * u
    for i in range(1, min(m, n) + 1):
        for k in range(u, max(m, n) + i - 1, -1):
            ways[k] -= ways[k - max(m, n) - i]
        for k in range(i, u + 1):
            ways[k] += ways[k - i]
    return sum(ways)


@F.pandas_udf(T.DoubleType())
def exact_p(m: pd.Series, n: pd.Series, u: pd.Series) -> pd.Series:
    """Two-sided p of U from its own distribution; null where m is. One row for each group, so a small helper."""
    return pd.Series([None if x != x else min(1.0, 2 * orders_up_to(int(x), int(y), int(min(z, x * y - z))) / math.comb(int(x + y), int(x))) for x, y, z in zip(m, n, u)], dtype="float64")


def mann_whitney(rows: DataFrame, group: list[str], score: str, positive: str) -> DataFrame:
    """(group, mannwhitney_u, z, p_value): U of the positive rows, its normal deviate, corrected for ties, and the two-sided p; null if one class is missing or all scores are equal.

    p is exact if no two scores are equal and the smaller class has SMALL rows at most (and classes of up to MOST pairs); else it is the normal deviate's, with continuity correction.
    """
    p, q = F.col("pos").cast("double"), F.col("neg").cast("double")
    u = F.col("rank_sum") - p * (p + 1) / 2
    n = p + q
    var = p * q / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    sd = F.when(var > 0, F.sqrt(var))
    away = F.greatest((F.abs(u - p * q / 2) - 0.5) / sd, F.lit(0.0))
    z, normal = F.round(F.try_divide(u - p * q / 2, sd), 6), F.least(erfc(away / math.sqrt(2)), F.lit(1.0))
    small = (F.col("ties") == 0) & (F.least(p, q) <= SMALL) & (p * q > 0) & (p * q <= MOST)
    exact = exact_p(F.when(small, p), F.when(small, q), F.when(small, u))
    return rank_sums(rows, group, score, positive).select(*group, u.alias("mannwhitney_u"), z.alias("z"), F.round(F.coalesce(exact, F.when(sd.isNotNull(), normal)), 6).alias("p_value"))


def cosine_of(x: Column, y: Column) -> Column:
    """Cosine of two vectors whose parts stand in the rows of a group; 0 if one has no length."""
    return F.coalesce(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))), F.lit(0.0))
