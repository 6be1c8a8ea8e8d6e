"""Gating a stream: value-bucketed frames in time windows, with late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate_stream(events: DataFrame, time: str, value: str, upper: float, frames: int, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, frame, n, total) per window and frame, where frames split 5 % of `upper` .. `upper` evenly as in batch gating.

    A stream has no mean beforehand, so the upper bound is given. State is one row for each open window and frame; events
    later than the watermark are dropped by Spark. Null values, and values from the bound on, are in no frame. The same
    function serves a static table.
    """
    start = 0.05 * upper
    at = F.floor((F.col(value) - start) / ((upper - start) / frames))
    frame = F.greatest(F.lit(0), F.least(F.lit(frames - 1), at)).cast("int")
    seen = events.withWatermark(time, late) if events.isStreaming else events
    gated = seen.where(F.col(value) < upper).withColumn("frame", frame)
    sums = gated.groupBy(F.window(time, window).alias("w"), "frame").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("start"), "frame", "n", "total")
