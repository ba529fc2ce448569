"""Exact statistics that need a word of care."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """(share, value): the element at index floor(n * share) of the sorted values.

    One pass counts, one takes exact discrete percentiles at the middle of that rank;
    both combine counts of equal values before the shuffle. Nulls don't count; no rows
    give null values.
    """
    n = df.where(F.col(col).isNotNull()).count()
    if not n:
        return df.sparkSession.createDataFrame([(s, None) for s in shares], "share double, value double")
    ranks = [(min(int(n * s), n - 1) + 0.5) / n for s in shares]
    one = df.agg(*(F.expr(f"percentile_disc({r}) WITHIN GROUP (ORDER BY `{col}`)").alias(f"v{i}") for i, r in enumerate(ranks)))
    args = ", ".join(f"{s}D, v{i}" for i, s in enumerate(shares))
    return one.selectExpr(f"stack({len(shares)}, {args}) AS (share, value)")


def last_by(df: DataFrame, value: str, order: str) -> DataFrame:
    """(least, last): minimum of value, and value of the largest order."""
    return df.agg(F.min(value).alias("least"), F.max_by(value, order).alias("last"))
