"""Windowed statistics on a stream of samples (rec, ch, ts, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, length: str = "1 second", slide: str = "125 milliseconds", late: str = "2 seconds") -> DataFrame:
    """rec, ch, begin, n, mean, activity per event-time window; samples later than `late` are dropped with its state."""
    rows = stream.withWatermark("ts", late).groupBy("rec", "ch", F.window("ts", length, slide).alias("w"))
    out = rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("activity"))
    return out.select("rec", "ch", F.col("w.start").alias("begin"), "n", "mean", "activity")


def decimated(stream: DataFrame, step: str, late: str = "2 seconds") -> DataFrame:
    """Block means: windows that do not overlap."""
    return windowed(stream, step, step, late).select("rec", "ch", "begin", "mean")
