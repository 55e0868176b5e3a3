"""Z-scores of readings against baselines, with the four-level fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.baselines import LEVELS, with_keys
from fleetpulse.plans.tables import fits_broadcast
from fleetpulse.schemas import Z_THRESHOLD


def machine_lookup(baselines: DataFrame, stats: Sequence[str]) -> DataFrame:
    """One row per machine: its all-day stats and a map from window to stats.

    Both machine levels then cost a single join on the machine. A machine has at most one entry per
    window, so the map is small.
    """
    row = f"struct({', '.join(f'`{s}`' for s in stats)})"
    return (
        baselines.where("level IN ('machine', 'machine+window')")
        .groupBy("machine")
        .agg(
            F.expr(f"max(CASE WHEN level = 'machine' THEN {row} END) AS _day"),
            F.expr(
                f"map_from_entries(collect_list(CASE WHEN level = 'machine+window' THEN struct(`window`, {row}) END)) "
                "AS _by_window"
            ),
        )
    )


def attach_baselines(
    df: DataFrame, baselines: DataFrame, metrics: Sequence[str], levels: Sequence[str] = LEVELS
) -> DataFrame:
    """Add ``<m>_mean``, ``<m>_std`` and ``baseline_used``: the first level that knows the reading.

    ``baselines`` is a written table. Facts are never shuffled while its machine part is within the
    broadcast bound; beyond it there is one shuffle join on the machine, whose hot keys adaptive
    execution splits.
    """
    stats = [f"{m}_{s}" for m in metrics for s in ("mean", "std")]
    row = f"struct({', '.join(f'`{s}`' for s in stats)})"
    # One small row per level.
    sizes = {r["level"]: r["count"] for r in baselines.groupBy("level").count().collect()}
    side = lambda table, *names: F.broadcast(table) if fits_broadcast(max(sizes.get(n, 0) for n in names), table.schema) else table
    df = with_keys(df)
    steps = []
    if "machine+window" in levels or "machine" in levels:
        df = df.join(side(machine_lookup(baselines, stats), "machine", "machine+window"), "machine", "left")
        if "machine+window" in levels:
            # A NULL window has no entry; '' never names one.
            steps.append(("machine+window", "try_element_at(_by_window, coalesce(`window`, ''))"))
        if "machine" in levels:
            steps.append(("machine", "_day"))
    if "type" in levels:
        types = baselines.where("level = 'type' AND type <> ''").selectExpr("type", f"{row} AS _type")
        df = df.join(side(types, "type"), "type", "left")
        steps.append(("type", "_type"))
    df = df.crossJoin(F.broadcast(baselines.where("level = 'global'").selectExpr(f"{row} AS _fleet")))  # one row
    steps.append(("global", "_fleet"))

    whens = " ".join(f"WHEN {s} IS NOT NULL THEN '{name}'" for name, s in steps)
    keep = [f"`{c}`" for c in df.columns if c not in ("_day", "_by_window", "_type")]
    chosen = df.selectExpr(*keep, f"CASE {whens} END AS baseline_used", f"coalesce({', '.join(s for _, s in steps)}) AS _chosen")
    return chosen.selectExpr(
        *[c for c in keep if c != "`_fleet`"],
        "baseline_used",
        *[f"coalesce(_chosen.`{s}`, _fleet.`{s}`) AS `{s}`" for s in stats],
    )


def zscore(
    df: DataFrame,
    baselines: DataFrame,
    metrics: Sequence[str],
    levels: Sequence[str] = LEVELS,
    keep_stats: bool = False,
) -> DataFrame:
    """Add ``z_<m> = (m - mean) / std`` and ``baseline_used``."""
    out = attach_baselines(df, baselines, metrics, levels)
    stats = {f"{m}_{s}" for m in metrics for s in ("mean", "std")}
    kept = [f"`{c}`" for c in out.columns if keep_stats or c not in stats]
    return out.selectExpr(*kept, *[f"(`{m}` - `{m}_mean`) / `{m}_std` AS `z_{m}`" for m in metrics])


def z_threshold(df: DataFrame, metrics: Sequence[str], limit: float = Z_THRESHOLD) -> DataFrame:
    """Add ``score`` (largest absolute z) and ``pred`` (1 when any exceeds ``limit``)."""
    sizes = [f"abs(`z_{m}`)" for m in metrics]
    score = f"greatest({', '.join(sizes)})" if len(sizes) > 1 else sizes[0]
    return df.selectExpr("*", f"{score} AS score").selectExpr("*", f"CASE WHEN score > {limit}D THEN 1 ELSE 0 END AS pred")
