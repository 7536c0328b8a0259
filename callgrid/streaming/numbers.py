"""Numbers in streams. Parsing, classification and formats hold no state and run unchanged
on a stream; what follows keeps state, bounded by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_within(df: DataFrame, e164: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """The first event of each number within the delay; later ones are dropped."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([e164])


def counts_by_window(df: DataFrame, ts: str, *keys: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events for each window and key; late events beyond the delay are left out."""
    return df.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
