"""Sums of counts over a stream of cells: an addition to the batch operators, with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_pseudobulk(counts: DataFrame, watermark: str | None = None, time_column: str | None = None, window: str | None = None) -> DataFrame:
    """Running sums of (cell_type, sample, gene, value); with a window, by event time, late rows dropped beyond the
    watermark."""
    keys = ["cell_type", "sample", "gene"]
    if window:
        counts = counts.withWatermark(time_column, watermark or "0 seconds")
        return counts.groupBy(F.window(time_column, window), *keys).agg(F.sum("value").alias("value"))
    return counts.groupBy(*keys).agg(F.sum("value").alias("value"))
