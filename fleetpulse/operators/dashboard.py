"""Fleet summaries and the dashboard's aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.plans.scalars import value_of


def fleet_summary(df: DataFrame) -> DataFrame:
    """Rows, machines and anomaly ratio per type and for the whole fleet (type NULL)."""
    return df.rollup("type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("machine").alias("n_machines"),
        F.avg(F.col("label").cast("double")).alias("anomaly_ratio"),
    )


def of_types(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """The dashboard's multi-select on machine type; an empty choice means all."""
    return df.where(F.col("type").isin(*types)) if types else df


def tick_averages(df: DataFrame, metrics: Sequence[str] = ("cpu", "network", "load_avg"), width: str = "30 seconds", ts: str = "timestamp") -> DataFrame:
    """Fleet averages per tumbling tick."""
    return df.groupBy(F.window(ts, width).alias("_w")).agg(
        *[F.avg(m).alias(f"avg_{m}") for m in metrics], F.count(F.lit(1)).alias("n")
    ).select(F.col("_w.start").alias("tick"), *[f"avg_{m}" for m in metrics], "n")


def anomaly_counts(flagged: DataFrame) -> DataFrame:
    """Anomalies, machines with any, and machines that were a likely root cause."""
    return flagged.agg(
        F.count(F.lit(1)).alias("n_anomalies"),
        F.count_distinct("machine").alias("n_machines"),
        F.count_distinct(F.when(F.col("role") == "likely_root_cause", F.col("machine"))).alias("n_root_causes"),
    )


def by_score(df: DataFrame, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), "machine")


def detection_vs_truth(detected: DataFrame, truth: DataFrame, tick: str = "tick") -> DataFrame:
    """Flagged and truly anomalous readings per tick, ticks of either side kept."""
    a = detected.groupBy(tick).agg(F.count(F.lit(1)).alias("detected"))
    b = truth.groupBy(tick).agg(F.count(F.lit(1)).alias("actual"))
    return a.join(b, tick, "full").select(
        tick, F.coalesce("detected", F.lit(0)).alias("detected"), F.coalesce("actual", F.lit(0)).alias("actual")
    )


def latest_tick_metrics(df: DataFrame, tick: str = "tick") -> DataFrame:
    """Anomaly count, average cpu and load, and true anomalies of the newest tick, found first and filtered as a literal."""
    return df.where(F.col(tick) == value_of(df, F.max(tick))).agg(
        F.sum(F.col("pred").cast("bigint")).alias("anomaly_count"),
        F.avg("cpu").alias("avg_cpu"),
        F.avg("load_avg").alias("avg_load"),
        F.sum(F.col("label").cast("bigint")).alias("ground_truth"),
    )


def daily_detection(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per day: true anomalies and how many were flagged."""
    return (
        df.where(F.col("label") == 1)
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.sum(F.col("pred").cast("bigint")).alias("hit"), F.count(F.lit(1)).alias("total"))
    )
