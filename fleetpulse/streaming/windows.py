"""Event-time windows over readings. Event time always comes from the data, never from the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_event_time(df: DataFrame, ts: str = "timestamp", out: str = "event_time") -> DataFrame:
    """Watermarks need a time-zoned timestamp."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def tumbling(df: DataFrame, metrics: Sequence[str], width: str = "30 seconds", delay: str = "1 minute", by: Sequence[str] = (), time: str = "event_time") -> DataFrame:
    """Averages per tumbling window, emitted once the watermark passes its end."""
    return _averages(df.withWatermark(time, delay), F.window(time, width), metrics, by)


def sliding(df: DataFrame, metrics: Sequence[str], width: str = "5 minutes", slide: str = "30 seconds", delay: str = "1 minute", by: Sequence[str] = ("machine",), time: str = "event_time") -> DataFrame:
    """Averages per sliding window and key."""
    return _averages(df.withWatermark(time, delay), F.window(time, width, slide), metrics, by)


def _averages(df, window, metrics, by):
    return (
        df.groupBy(window.alias("w"), *by)
        .agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics], F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[f"avg_{m}" for m in metrics], "n")
    )


def incident_sessions(df: DataFrame, gap: str = "30 seconds", delay: str = "1 minute", by: Sequence[str] = ("machine",), time: str = "event_time") -> DataFrame:
    """One row per incident: flagged readings of a key closer than ``gap``."""
    return (
        df.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("started"), F.col("w.end").alias("closes"), *by, "n")
    )


def dedupe(df: DataFrame, keys: Sequence[str] = ("machine", "event_time"), delay: str = "1 minute", time: str = "event_time") -> DataFrame:
    """Drop repeats of a reading; state is dropped behind the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def dropped_late(query) -> int:
    """Rows a finished query dropped behind the watermark."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"]
    )


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Drain what is available into a Parquet table and return the finished query."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
