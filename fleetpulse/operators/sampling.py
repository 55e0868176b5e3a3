"""Deterministic splits and samples, exact in size at any scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.plans.prefix import mark_first, mark_smallest
from fleetpulse.plans.tables import broadcast_if_small, materialize


def stratified_split(
    df: DataFrame, label: str = "label", fraction: float = 0.7, key: Sequence[str] = ("event_id",), seed: int = 42
) -> DataFrame:
    """Add ``is_train``: exactly ``round(fraction * n)`` rows of every label, chosen by hash."""
    return mark_smallest(df, [label], F.round(F.lit(fraction) * F.col("n")), key, seed, "is_train")


def stratified_cap(
    df: DataFrame, max_rows: int, label: str = "label", key: Sequence[str] = ("event_id",), seed: int = 42
) -> DataFrame:
    """At most ``max_rows`` rows with label shares kept; ``max_rows <= 0`` keeps everything."""
    if max_rows <= 0:
        return df
    # One row: the total.
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    sized = df.crossJoin(F.broadcast(total))
    # The quota may read only the stratum size, so the total goes in as a stratum of its own.
    quota = F.when(F.col("_total") <= max_rows, F.col("n")).otherwise(
        F.round(F.col("n") * F.lit(float(max_rows)) / F.col("_total"))
    )
    return mark_smallest(sized, [label, "_total"], quota, key, seed).where("in_sample").drop("in_sample", "_total")


def hash_sample(df: DataFrame, n: int, key: Sequence[str] = ("event_id",), seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, those with the smallest hash."""
    return mark_smallest(df, [], F.lit(n), key, seed).where("in_sample").drop("in_sample")


def anomalies_and_normals(df: DataFrame, n_normals: int, key=("event_id",), seed: int = 42) -> DataFrame:
    """All anomalies and an exact sample of normals."""
    normals = hash_sample(df.where(F.col("label") == 0), n_normals, key, seed)
    return df.where(F.col("label") == 1).unionByName(normals)


def halves(df: DataFrame, key=("event_id",), seed: int = 42) -> DataFrame:
    """Add ``half``: ``val`` for exactly floor(n/2) rows, ``hold`` for the rest."""
    marked = mark_smallest(df, [], F.floor(F.col("n") / 2), key, seed)
    return marked.withColumn("half", F.when(F.col("in_sample"), "val").otherwise("hold")).drop("in_sample")


def temporal_split(df: DataFrame, fraction: float = 0.7, order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """Add ``is_train`` for the first ``floor(fraction * n)`` rows in time."""
    quota = F.floor(F.col("n") * F.lit(fraction))
    return mark_first(df, [], quota, order, f"date_trunc('second', `{order[0]}`)", "is_train")


def head_sample(df: DataFrame, n: int, order: Sequence[str] = ("timestamp", "machine", "event_id")) -> DataFrame:
    """First ``n`` rows in order; ``n <= 0`` keeps everything."""
    return df if n <= 0 else df.orderBy(*order).limit(n)


def weighted_feedback_sample(
    anomalies: DataFrame, n: int, weak: Sequence[str], cause: str = "anomaly_type", weak_share: float = 0.7,
    key=("event_id",), seed: int = 42,
) -> DataFrame:
    """``n`` rows, a ``weak_share`` of them from weak causes; a short group is repeated evenly.

    ``copy`` numbers the repetitions of a row.
    """
    n_weak = int(n * weak_share)
    grouped = anomalies.withColumn("_weak", F.col(cause).isin(*weak).cast("int"))
    want = F.when(F.col("_weak") == 1, F.lit(n_weak)).otherwise(F.lit(n - n_weak))
    # One row per group: two at most.
    sizes = grouped.groupBy("_weak").agg(F.count(F.lit(1)).alias("_size"))
    sized = grouped.join(F.broadcast(sizes), "_weak").withColumn("_whole", F.floor(want / F.col("_size")))
    extra = mark_smallest(sized, ["_weak"], F.when(F.col("_weak") == 1, F.lit(n_weak)).otherwise(F.lit(n - n_weak)) % F.col("n"), key, seed)
    copies = F.col("_whole") + F.col("in_sample").cast("int")
    return (
        extra.withColumn("_copies", copies)
        .where(F.col("_copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies").cast("bigint"))))
        .drop("_weak", "_size", "_whole", "in_sample", "_copies")
    )


def sample_per_type(df: DataFrame, n: int, by: str = "type", key=("event_id",), seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows (``n`` clamped to 1..100), dealt to the types in turn until none is left.

    Within a type rows come by hash. At most 100 rows of each type are ranked.
    """
    n = max(1, min(n, 100))
    first = mark_smallest(df, [by], F.lit(n), key, seed).where("in_sample").drop("in_sample")
    text = ", ".join(f"CAST(`{k}` AS STRING)" for k in key)
    hashed = first.selectExpr("*", f"md5(concat_ws('|', '{seed}', {text})) AS _hash")
    turn = F.row_number().over(Window.partitionBy(by).orderBy("_hash", *key))
    return hashed.withColumn("_turn", turn).orderBy("_turn", "_hash", *key).limit(n).drop("_turn", "_hash")


def split_known(df: DataFrame, known: DataFrame, on: str = "machine") -> tuple[DataFrame, DataFrame]:
    """Rows whose key is known, and the rest."""
    side = broadcast_if_small(materialize(known.select(on).distinct(), "known"))
    return df.join(side, on, "left_semi"), df.join(side, on, "left_anti")
