"""Exact dedup of a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.functions import text as T
from loomsieve.operators.dedup import prepare


def first_in_stream(records: DataFrame, time_col: str = "created_at", late: str = "1 day") -> DataFrame:
    """Records whose hash hasn't come within the watermark; state is the hashes of that
    span alone. Which copy survives is the order of arrival; batch dedup is by id."""
    rows = prepare(records).where(~T.is_blank(F.col("text"))).where(F.col(time_col).isNotNull())
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["hash"])
