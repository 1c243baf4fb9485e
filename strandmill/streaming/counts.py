"""Read counts kept up to date from a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_counts(reads: DataFrame, *by: str, seq: str = "seq") -> DataFrame:
    """by..., seq, n of a streaming DataFrame, to be written in update or complete mode."""
    return reads.where(F.col(seq).isNotNull()).groupBy(*by, F.trim(F.col(seq)).alias("seq")).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(reads: DataFrame, *, time: str, width: str = "1 hour", late: str = "1 day", seq: str = "seq") -> DataFrame:
    """window_start, seq, n by event time; rows later than `late` behind the newest are no longer counted."""
    counted = reads.where(F.col(seq).isNotNull()).withWatermark(time, late).groupBy(F.window(time, width), F.trim(F.col(seq)).alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "seq", "n")
