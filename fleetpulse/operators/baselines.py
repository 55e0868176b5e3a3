"""Mean and deviation baselines per machine and window, machine, type and fleet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.plans.prefix import exact_percentiles
from fleetpulse.plans.tables import broadcast_if_small, few_or_none, materialize
from fleetpulse.schemas import GLOBAL_STD_FLOOR, STD_FLOOR

LEVELS = ("machine+window", "machine", "type", "global")
LEVEL_KEYS = {"machine+window": ["machine", "window"], "machine": ["machine"], "type": ["type"], "global": []}


def with_keys(df: DataFrame) -> DataFrame:
    """Supply the key columns an adaptive input may lack."""
    for name, default in (("machine", "__all__"), ("window", "all")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    return df if "type" in df.columns else df.withColumn("type", F.lit(None).cast("string"))


def moment_cells(train: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One pass over the readings: count, mean and variance per machine, type and window."""
    aggs = [F.expr("count(1) AS n")]
    for m in metrics:
        aggs += [F.expr(f"count(`{m}`) AS `{m}_n`"), F.expr(f"avg(`{m}`) AS `{m}_m`"), F.expr(f"var_pop(`{m}`) AS `{m}_v`")]
    return with_keys(train).groupBy("machine", "type", "window").agg(*aggs)


def merge_cells(cells: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Pool moment rows to a coarser key: counts add, spread is taken around the pooled mean.

    A machine has few cells, so its pooled mean is a window over them. Types and the fleet have many:
    there the pooled means are an aggregate of a few rows, joined back.
    """
    keys = list(keys)
    mean = lambda m: f"try_divide(sum(`{m}_n` * `{m}_m`){{over}}, sum(`{m}_n`){{over}}) AS `{m}_c`"
    if "machine" in keys:
        over = f" OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)})"
        centred = cells.selectExpr("*", *[mean(m).format(over=over) for m in metrics])
    else:
        means = cells.groupBy(*keys).agg(*[F.expr(mean(m).format(over="")) for m in metrics])
        centred = cells.join(means, keys) if keys else cells.crossJoin(F.broadcast(means))  # one row
    aggs = [F.expr("sum(n) AS n")]
    for m in metrics:
        n, gap = f"`{m}_n`", f"(`{m}_m` - `{m}_c`)"
        aggs += [
            F.expr(f"sum({n}) AS {n}"),
            F.expr(f"max(`{m}_c`) AS `{m}_m`"),
            F.expr(f"try_divide(sum({n} * (`{m}_v` + {gap} * {gap})), sum({n})) AS `{m}_v`"),
        ]
    return centred.groupBy(*keys).agg(*aggs)


def _stats(metrics: Sequence[str], ddof: int, floor: float) -> list[str]:
    """Mean and floored deviation of moment rows; both NULL for a metric without values."""
    out = []
    for m in metrics:
        n = f"`{m}_n`"
        std = f"sqrt(`{m}_v` * {n} / nullif({n} - {ddof}, 0))" if ddof else f"sqrt(`{m}_v`)"
        out += [
            f"`{m}_m` AS `{m}_mean`",
            f"CASE WHEN {n} > 0 THEN greatest(coalesce({std}, {floor!r}D), {floor!r}D) END AS `{m}_std`",
        ]
    return out


def build_baselines(
    train: DataFrame,
    metrics: Sequence[str],
    *,
    ddof: int = 0,
    trim: tuple[float, float] | None = None,
    floors: tuple[float, float] = (STD_FLOOR, GLOBAL_STD_FLOOR),
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """Baselines of a training split, one row per key: ``level, machine, type, window, n, <m>_mean, <m>_std``.

    The readings are aggregated once with map-side combination; coarser levels are merged from those
    cells. With ``trim`` the machine-and-window level uses only values between the two quantiles. The
    result is a written table.
    """
    cells = materialize(moment_cells(train, metrics), "cells")
    stats = [f"`{m}_{s}`" for m in metrics for s in ("mean", "std")]
    out = None
    for level in levels:
        keys = LEVEL_KEYS[level]
        floor = floors[1] if level == "global" else floors[0]
        source = cells.where("type IS NOT NULL") if level == "type" else cells
        rows = merge_cells(source, keys, metrics).selectExpr(*keys, "n", *_stats(metrics, ddof, floor))
        if level == "machine+window" and trim:
            rows = _trimmed(train, metrics, rows, trim, floors[0])
        if not keys:
            rows = rows.where("n > 0")
        named = [f"`{k}`" if k in keys else f"CAST(NULL AS STRING) AS `{k}`" for k in ("machine", "type", "window")]
        rows = rows.selectExpr(f"'{level}' AS level", *named, "n", *stats)
        out = rows if out is None else out.unionByName(rows)
    return materialize(out, "baselines")


def trim_bounds(
    train: DataFrame, metrics: Sequence[str], trim: tuple[float, float], hot_rows: int = 5_000_000
) -> DataFrame:
    """Quantile bounds ``<m>_lo``/``<m>_hi`` per machine and window.

    Spark's exact percentile keeps a group's distinct values in one task, so groups above ``hot_rows``
    take the distributed path.
    """
    keys = ["machine", "window"]
    data = with_keys(train).select(*keys, *metrics)
    direct = lambda d: d.groupBy(*keys).agg(
        *[F.expr(f"percentile(`{m}`, {q}) AS `{m}_{s}`") for m in metrics for s, q in zip(("lo", "hi"), trim)]
    )
    hot = few_or_none(
        data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)
    )
    if hot is None:
        return direct(data)
    small = direct(data.join(hot, keys, "left_anti"))
    long = data.join(hot, keys, "left_semi").select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("e"),
    ).select(*keys, "e.*")
    wide = (
        exact_percentiles(long, [*keys, "metric"], "value", {"lo": trim[0], "hi": trim[1]})
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}")
                for m in metrics
                for s in ("lo", "hi")
            ]
        )
    )
    return small.unionByName(wide)


def _trimmed(train, metrics, plain, trim, floor, min_kept: int = 10) -> DataFrame:
    keys = ["machine", "window"]
    bounds = broadcast_if_small(materialize(trim_bounds(train, metrics, trim), "bounds"))
    kept = with_keys(train).select(*keys, *metrics).join(bounds, keys)
    aggs, out = [], []
    for m in metrics:
        inside = f"CASE WHEN `{m}` BETWEEN `{m}_lo` AND `{m}_hi` THEN `{m}` END"
        aggs += [F.expr(f"{f}({inside}) AS `{m}_{a}`") for f, a in (("count", "k"), ("avg", "tm"), ("stddev_pop", "ts"))]
        enough = f"`{m}_k` >= {min_kept}"
        out += [
            f"CASE WHEN {enough} THEN `{m}_tm` ELSE `{m}_mean` END AS `{m}_mean`",
            f"CASE WHEN {enough} THEN greatest(`{m}_ts`, {floor!r}D) ELSE `{m}_std` END AS `{m}_std`",
        ]
    return plain.join(kept.groupBy(*keys).agg(*aggs), keys).selectExpr("machine", "window", "n", *out)


def to_long(baselines: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long form: one row per key and metric."""
    cells = ", ".join(f"named_struct('metric', '{m}', 'mean', `{m}_mean`, 'std', `{m}_std`)" for m in metrics)
    return baselines.selectExpr("level", "machine", "type", "window", "n", f"inline(array({cells}))")


def known_machines(train: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Machines of a training split with the type each was first seen with."""
    return train.groupBy("machine").agg(F.min_by("type", ts).alias("type"))


def inventory(baselines: DataFrame) -> DataFrame:
    """Number of baseline keys per level."""
    return baselines.groupBy("level").agg(F.count(F.lit(1)).alias("n_keys"))


def metric_order(baselines: DataFrame) -> list[str]:
    """Metrics in contract order, read from the table's columns."""
    return [c[: -len("_mean")] for c in baselines.columns if c.endswith("_mean")]
