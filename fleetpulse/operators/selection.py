"""Metric inference and selection for inputs with unknown columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.plans.chunks import CHUNK_ROWS, row_index
from fleetpulse.schemas import META


def infer_features(df: DataFrame, meta: Sequence[str] = META) -> list[str]:
    """Numeric columns that are not descriptive, in schema order."""
    return [f.name for f in df.schema.fields if f.name not in meta and isinstance(f.dataType, T.NumericType)]


def unpivot(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form ``ids..., metric, value``."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(ids), list(metrics), "metric", "value"
    )


def variances(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sample variance per metric, long, from one wide aggregate."""
    wide = df.groupBy(*by).agg(*[F.var_samp(F.col(m).cast("double")).alias(m) for m in metrics])
    return wide.unpivot(list(by), list(metrics), "metric", "variance")


def drop_constant(df: DataFrame, metrics: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Drop metrics without variance over the whole pool. Returns the frame and the kept metrics."""
    # One row with one number per column.
    row = df.agg(*[F.var_samp(F.col(m).cast("double")).alias(m) for m in metrics]).first()
    keep = [m for m in metrics if (row[m] or 0.0) > 0]
    return df.select(*[c for c in df.columns if c not in metrics or c in keep]), keep


def rename_first(metrics: Sequence[str], names: Sequence[str] = ("cpu", "ram", "network")) -> dict[str, str]:
    return dict(zip(metrics, names))


def select_metrics(df: DataFrame, metrics: Sequence[str], mode: str = "all") -> DataFrame:
    """Pool-wide selection: ``first3``, ``top3`` by variance, or ``all`` non-constant; the first three
    kept become cpu, ram and network."""
    others = [c for c in df.columns if c not in metrics]
    if mode == "first3":
        keep = list(metrics[:3])
    elif mode == "top3":
        row = df.agg(*[F.var_samp(F.col(m).cast("double")).alias(m) for m in metrics]).first()
        keep = sorted(metrics, key=lambda m: -(row[m] or 0.0))[:3]
    elif mode == "all":
        keep = drop_constant(df, metrics)[1]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    names = rename_first(keep)
    return df.select(*others, *[F.col(m).alias(names.get(m, m)) for m in keep])


def top_metrics_per_machine(df: DataFrame, metrics: Sequence[str], k: int = 3, by: str = "machine") -> DataFrame:
    """The ``k`` metrics of largest variance per machine, with their rank (ties by metric name)."""
    order = Window.partitionBy(by).orderBy(F.desc("variance"), "metric")
    return (
        variances(df, metrics, [by])
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
    )


def select_top_per_machine(df: DataFrame, metrics: Sequence[str], by: str = "machine") -> DataFrame:
    """Every machine's own three strongest metrics as cpu, ram and network.

    The choice is one small row per machine, looked up per reading; readings are not reshaped.
    """
    chosen = (
        top_metrics_per_machine(df, metrics, 3, by)
        .groupBy(by)
        .pivot("rank", [1, 2, 3])
        .agg(F.first("metric"))
        .toDF(by, "_m1", "_m2", "_m3")
    )
    values = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
    joined = df.join(chosen, by).withColumn("_values", values)
    out = joined.select(
        *[c for c in df.columns if c not in metrics],
        *[F.try_element_at("_values", F.col(f"_m{i}")).alias(n) for i, n in ((1, "cpu"), (2, "ram"), (3, "network"))],
    )
    return out


def select_all_per_machine(df: DataFrame, metrics: Sequence[str], by: str = "machine") -> DataFrame:
    """Every machine's own non-constant metrics in order: the first three as cpu, ram and network, the others under their
    names, NULL where a machine's are constant or among its first three."""
    kept = variances(df, metrics, [by]).where("variance > 0").groupBy(by).agg(F.collect_set("metric").alias("_varying"))
    # One row per machine; its metrics in the order of the columns.
    names = F.array(*[F.lit(m) for m in metrics])
    kept = kept.select(by, F.filter(names, lambda m: F.array_contains("_varying", m)).alias("_kept"))
    values = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
    joined = df.join(kept, by, "left").withColumn("_values", values)
    first = [F.try_element_at("_values", F.get("_kept", F.lit(i))).alias(n) for i, n in enumerate(("cpu", "ram", "network"))]
    rest = [F.when(F.array_position("_kept", m) > 3, F.col(m)).alias(m) for m in metrics]
    return joined.select(*[c for c in df.columns if c not in metrics], *first, *rest)


def synthetic_minutes(df: DataFrame, by: Sequence[str], order: Sequence[str], start: str, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Add ``timestamp = start + i minutes`` for the i-th row (from 0) of each key."""
    indexed = row_index(df, by, order, "_i", chunk_rows)
    step = F.make_dt_interval(mins=(F.col("_i") - 1).cast("int"))
    return indexed.withColumn("timestamp", F.to_timestamp_ntz(F.lit(start)) + step).drop("_i")


def widen_feed(feed: DataFrame, metrics: Sequence[str], tick: str = "tick") -> DataFrame:
    """Long metric series to one row per machine and tick: latest value of each metric, rounded to two
    decimals, complete rows only."""
    latest = [
        F.round(F.max_by("value", F.when(F.col("metric") == m, F.col("ts"))), 2).alias(m) for m in metrics
    ]
    return feed.where(F.col("metric").isin(*metrics)).groupBy("machine", "type", tick).agg(*latest).dropna(subset=list(metrics))


def require_metrics(df: DataFrame, metrics: Sequence[str], col: str = "metrics") -> DataFrame:
    """Add ``missing``: the first required metric absent from the map, NULL when complete."""
    missing = F.filter(F.array(*[F.lit(m) for m in metrics]), lambda m: F.try_element_at(col, m).isNull())
    return df.withColumn("missing", F.try_element_at(missing, F.lit(1)))
