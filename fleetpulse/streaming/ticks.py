"""Ticks put together from values that arrive one by one, in any micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.schemas import METRICS


def assemble_ticks(feed: DataFrame, metrics: Sequence[str] = METRICS, tick: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """One row per machine and tick: its type, the latest value of each metric (two decimals), ``found`` and ``whole``.

    Values wait as aggregation state in the JVM, combined before they are shuffled, until the watermark (newest time
    minus ``late``) has passed the end of their tick. Then every machine's row of that tick leaves in one micro-batch, so causes see
    the fleet together, however the values were dealt. ``whole`` tells whether all metrics came; values later than that are dropped and
    counted by ``windows.dropped_late``. Of equal times the larger value counts; NaN and null values count as missing.
    """
    known = feed.where(F.col("metric").isin(*metrics) & F.col("value").isNotNull() & ~F.isnan("value"))
    last = lambda m: F.round(F.max(F.when(F.col("metric") == m, F.struct("ts", "value")))["value"], 2).alias(m)
    grouped = known.withWatermark("ts", late).groupBy(F.window("ts", tick).alias("w"), "machine")
    wide = grouped.agg(F.max(F.struct("ts", "type"))["type"].alias("type"), *map(last, metrics))
    found = sum((F.col(m).isNotNull().cast("int") for m in metrics), F.lit(0))
    return wide.select(F.col("w.start").alias("tick"), "machine", "type", *metrics, found.alias("found"), (found == len(metrics)).alias("whole"))
