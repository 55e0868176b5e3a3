"""Step-aligned replay of per-machine series and incident grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.plans.chunks import CHUNK_ROWS, assign_chunks, lookback_on, row_index, running_sum_on, seconds_of


def align_steps(
    df: DataFrame, order: Sequence[str] = ("timestamp", "event_id"), by: str = "machine", chunk_rows: int | None = CHUNK_ROWS
) -> DataFrame:
    """Add ``step`` (from 0) per machine, cut to the length of the shortest machine."""
    # One row: the shortest series.
    shortest = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_steps"))
    return (
        row_index(df, [by], order, "_i", chunk_rows)
        .crossJoin(F.broadcast(shortest))
        .where(F.col("_i") <= F.col("_steps"))
        .withColumn("step", F.col("_i") - 1)
        .drop("_i", "_steps")
    )


def at_step(aligned: DataFrame, step: int) -> DataFrame:
    """Readings of one tick of the endless replay: ``step`` wraps at the series length."""
    length = aligned.agg((F.max("step") + 1).alias("_n"))
    return aligned.crossJoin(F.broadcast(length)).where(F.col("step") == F.lit(step) % F.col("_n")).drop("_n")


def incidents(
    df: DataFrame,
    gap_seconds: float = 30.0,
    order: Sequence[str] = ("timestamp", "event_id"),
    by: Sequence[str] = ("machine",),
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Incidents per machine: flagged rows at most ``gap_seconds`` apart belong together."""
    by, order = list(by), list(order)
    ts = order[0]
    placed = df.withColumn("_s", seconds_of(df, ts))

    def starts(d, parts):
        before = F.lag("_s", 1).over(Window.partitionBy(*parts).orderBy(*order))
        return d.withColumn("_new", F.coalesce((F.col("_s") - before > gap_seconds), F.lit(True)).cast("bigint"))

    sliced, split = assign_chunks(placed, by, ts, chunk_rows)
    flagged = lookback_on(sliced, split, by, order, 1, starts, ["_s"])
    numbered = running_sum_on(flagged, split, by, order, "_new", "incident")
    return numbered.groupBy(*by, "incident").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n")
    )
