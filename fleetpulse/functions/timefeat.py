"""Time-of-day windows and cyclic time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.plans.scalars import value_of
from fleetpulse.schemas import WINDOWS


def hour_to_window(hour: Column) -> Column:
    night, morning, afternoon, evening = (F.lit(w) for w in WINDOWS)
    return (
        F.when(hour.isNull(), F.lit(None).cast("string"))
        .when(hour < 6, night)
        .when(hour < 12, morning)
        .when(hour < 18, afternoon)
        .otherwise(evening)
    )


def add_window(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add ``hour`` and ``window``. Without a timestamp column the window is the constant ``all``."""
    if ts not in df.columns:
        return df.withColumn("window", F.lit("all"))
    return df.withColumn("hour", F.hour(ts)).withColumn("window", hour_to_window(F.col("hour")))


def add_cyclic_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add sine and cosine of hour of day and day of week (Monday is 0)."""
    hour, day = F.hour(ts), F.weekday(ts)
    turn = lambda x, period: F.lit(2.0) * F.pi() * x / F.lit(period)
    return df.withColumns(
        {
            "hour_sin": F.sin(turn(hour, 24)),
            "hour_cos": F.cos(turn(hour, 24)),
            "dow_sin": F.sin(turn(day, 7)),
            "dow_cos": F.cos(turn(day, 7)),
        }
    )


def resolve_window(df: DataFrame, hour: str = "hour", ts: str = "timestamp") -> DataFrame:
    """Window from an explicit hour, else from ISO timestamp text, else NULL; bad input fills ``error``."""
    h, text = F.col(hour), F.col(ts)
    parsed = F.try_to_timestamp(text)
    error = F.when(h.isNotNull() & ~h.between(0, 23), F.lit("no such hour of the day")).when(
        h.isNull() & text.isNotNull() & parsed.isNull(), F.lit("not a date and time")
    )
    used = F.when(h.isNotNull(), h).otherwise(F.hour(parsed))
    return df.withColumn("error", error).withColumn(
        "window", F.when(F.col("error").isNull(), hour_to_window(used))
    )


def first_days(df: DataFrame, days: int, ts: str = "timestamp") -> DataFrame:
    """Rows before ``min(ts) + days``. The bound is a literal, so the scan prunes by it."""
    return df.where(F.col(ts) < value_of(df, F.min(ts) + F.make_dt_interval(F.lit(days))))


def every_nth_hour(df: DataFrame, step: int = 4, ts: str = "timestamp") -> DataFrame:
    """Systematic sample: readings in minute 0 of every ``step``-th hour."""
    return df.where((F.hour(ts) % step == 0) & (F.minute(ts) == 0))
