"""Versioned tables: baselines, runs, promotions and the prediction log."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.schemas import PREDICTION_SCHEMA, RUN_SCHEMA
from fleetpulse.sources.commits import append_once, read_committed

log = logging.getLogger(__name__)


def save_baselines(baselines: DataFrame, root: str, version: str) -> None:
    """Baselines of one model version; the version is shared with the model."""
    baselines.write.mode("overwrite").parquet(f"{root}/model_version={version}")


def load_baselines(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/model_version={version}")


def to_predictions(scored: DataFrame, metrics: Sequence[str], model_version: str, threshold: float, at: str | None = None) -> DataFrame:
    """Log rows of scored readings: generated id, time, features and raw metrics as JSON.

    The time is that of the column ``at`` where given, such as the tick, so that a retry logs the same one; else the clock's.
    """
    opt = lambda name, kind: (F.col(name) if name in scored.columns else F.lit(None)).cast(kind)
    pack = lambda prefix: F.to_json(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(f"{prefix}{m}"))]))
    return scored.select(
        F.uuid().alias("id"),
        (F.col(at).cast("timestamp") if at else F.current_timestamp()).alias("timestamp"),
        "machine",
        opt("type", "string").alias("machine_type"),
        opt("window", "string").alias("time_window"),
        pack("z_").alias("features_json"),
        pack("").alias("raw_metrics_json"),
        F.lit(model_version).alias("model_version"),
        F.lit(float(threshold)).alias("predict_threshold"),
        opt("p_normal", "double").alias("xgb_p_normal"),
        opt("clf_cause", "string").alias("xgb_cause"),
        F.round(opt("iso_score", "double"), 4).alias("iso_score"),
        F.col("is_anomaly").cast("int").alias("final_is_anomaly"),
        opt("likely_cause", "string").alias("final_cause"),
        F.lit(None).cast("string").alias("operator_verdict"),
        F.lit(None).cast("timestamp").alias("verdict_timestamp"),
        F.lit(None).cast("string").alias("verdict_notes"),
    )


def log_predictions(predictions: DataFrame, path: str, best_effort: bool = True, query: str | None = None, batch: int = 0) -> bool:
    """Add a batch to the log, partitioned by day. A failing log must not stop scoring.

    With ``query`` and ``batch`` the batch is logged once however often it is written; without, every call counts.
    """
    try:
        append_once(predictions.withColumn("day", F.to_date("timestamp")), path, query, batch, by=("day",))
        return True
    except Exception as error:  # noqa: BLE001 - any storage failure counts as "not logged"
        if not best_effort:
            raise
        log.warning("predictions not logged: %s", error)
        return False


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_committed(spark, path, PREDICTION_SCHEMA, by=("day",)).drop("day")


def save_run(
    spark: SparkSession,
    path: str,
    run_id: str,
    model: str,
    data: str,
    params: Mapping[str, object],
    features: Sequence[str],
    metrics: Mapping[str, float | None],
) -> None:
    """Append one run's parameters and metrics."""
    row = (
        run_id,
        model,
        data,
        {k: str(v) for k, v in params.items()},
        list(features),
        {k: None if v is None else float(v) for k, v in metrics.items()},
    )
    shape = "run_id string, model string, data string, params map<string,string>, features array<string>, metrics map<string,double>"
    spark.createDataFrame([row], shape).withColumn("run_ts", F.current_timestamp()).select(
        *RUN_SCHEMA.fieldNames()
    ).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def record_attempt(verdict: DataFrame, path: str, model_version: str, model_path: str, metrics: Mapping[str, float], feedback_rows: int) -> None:
    """Append one guardrail outcome; the current model is the latest that passed."""
    named = F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), F.lit(float(v)))])
    verdict.select(
        "passed",
        "reason",
        F.lit(model_version).alias("model_version"),
        F.lit(model_path).alias("model_path"),
        named.alias("metrics"),
        F.lit(feedback_rows).cast("bigint").alias("feedback_rows"),
        F.current_timestamp().alias("attempted_at"),
    ).write.mode("append").parquet(path)
