"""Counts of check markers as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_window(markers: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, category, markers) of a stream (ts, category); a window is final once the watermark, ``late`` behind the newest marker, has passed it."""
    seen = markers.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "category").agg(F.count("*").alias("markers"))
    return seen.select(F.col("w.start").alias("start"), "category", "markers")
