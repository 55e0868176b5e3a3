"""The detection cycle as one streaming query: collect, score, rank causes, publish, log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.functions.timefeat import add_window
from fleetpulse.operators import serving
from fleetpulse.operators.rootcause import score_or_one, tick_roles
from fleetpulse.operators.zscore import z_threshold, zscore
from fleetpulse.schemas import METRIC_FEED_SCHEMA, METRICS
from fleetpulse.sources.commits import append_once, read_committed, streaming_query
from fleetpulse.sources.store import log_predictions, to_predictions
from fleetpulse.streaming.ticks import assemble_ticks

PUBLISHED = T.StructType(
    [
        T.StructField("tick", T.TimestampType()),
        T.StructField("machine", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("likely_cause", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("root_cause_score", T.DoubleType()),
        T.StructField("n_anomalous", T.LongType()),
    ]
)


def metric_feed(spark: SparkSession, path: str, files_per_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    """Stream of long metric values."""
    return (
        spark.readStream.format(fmt)
        .schema(METRIC_FEED_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def score_ticks(ticks: DataFrame, model: DataFrame | serving.Bundle, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Score whole ticks, hour taken from the data: with a bundle by both detectors and the OR gate, with plain baselines
    by the z-threshold."""
    windowed = add_window(ticks, "tick")
    if isinstance(model, serving.Bundle):
        scored = serving.score(windowed, model)
        return scored.withColumn("score", score_or_one(F.round("iso_score", 4)))
    scored = z_threshold(zscore(windowed, model, metrics), metrics)
    return scored.withColumns({"is_anomaly": F.col("pred"), "likely_cause": F.lit(None).cast("string")})


def detection_cycle(
    model: DataFrame | serving.Bundle,
    edges: DataFrame,
    out_path: str,
    log_path: str | None = None,
    routers: DataFrame | None = None,
    metrics: Sequence[str] = METRICS,
    model_version: str = "z-threshold",
    threshold: float = 3.0,
    name: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body over assembled ticks. A tick's machines always come in one micro-batch.

    Published rows and log take each batch once, keyed by ``name`` (the streaming query's own id by default) and its number:
    retries add nothing, and several cycles may share both paths.
    """
    if isinstance(model, serving.Bundle):
        metrics, model_version, threshold = model.metrics, model.version, model.threshold

    def body(batch: DataFrame, batch_id: int) -> None:
        query = name or streaming_query(batch.sparkSession)
        scored = score_ticks(batch.where("whole"), model, metrics).persist()
        anomalies = scored.where("is_anomaly = 1").select("tick", "machine", "type", "score")
        causes = scored.select("tick", "machine", "likely_cause")
        roles = tick_roles(anomalies, edges, routers=routers).join(causes, ["tick", "machine"])
        append_once(roles.select(*PUBLISHED.fieldNames()), out_path, query, batch_id)
        if log_path:
            log_predictions(to_predictions(scored, metrics, model_version, threshold, at="tick"), log_path, query=query, batch=batch_id)
        scored.unpersist()

    return body


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Anomalous machines of every tick with their role."""
    return read_committed(spark, path, PUBLISHED)


def run_cycle(feed: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, metrics: Sequence[str] = METRICS, **ticks):
    """Start the cycle over long metric values: every 30 s against a live feed, or drain what is available.

    ``ticks`` are the options of ``assemble_ticks``.
    """
    writer = assemble_ticks(feed, metrics, **ticks).writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
