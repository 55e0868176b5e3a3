"""Baselines, fallback joins and z-scores."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import LEVEL_SQL, baseline_ctes, cols, fallback_join, query, r6, z_sql
from fleetpulse.functions import decisions as dec
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.operators import baselines as bl
from fleetpulse.operators import sampling
from fleetpulse.operators.zscore import attach_baselines, z_threshold, zscore
from fleetpulse.schemas import METRICS

STATS = [f"{m}_{s}" for m in METRICS for s in ("mean", "std")]
SQL_STATS = ", ".join(f"{r6(s)} AS {s}" for s in STATS)


def rounded_stats():
    return [R(s).alias(s) for s in STATS]


def split(spark, sf):
    return sampling.stratified_split(fx.windowed(spark, sf))


def train_base(spark, sf, **kw):
    return bl.build_baselines(split(spark, sf).where("is_train"), METRICS, **kw)


@query("baseline_machine_window", f'WITH {baseline_ctes("train", METRICS)} SELECT machine, "window", n, {SQL_STATS} FROM b_mw', ["train"])
def baseline_machine_window(spark, sf):
    return train_base(spark, sf, levels=("machine+window",)).select("machine", "window", "n", *rounded_stats())


@query("baseline_machine", f"WITH {baseline_ctes('train', METRICS)} SELECT machine, n, {SQL_STATS} FROM b_m", ["train"])
def baseline_machine(spark, sf):
    return train_base(spark, sf, levels=("machine",)).select("machine", "n", *rounded_stats())


@query("baseline_type", f"WITH {baseline_ctes('train', METRICS)} SELECT type, n, {SQL_STATS} FROM b_t", ["train"])
def baseline_type(spark, sf):
    return train_base(spark, sf, levels=("type",)).select("type", "n", *rounded_stats())


@query("baseline_global", f"WITH {baseline_ctes('train', METRICS)} SELECT n, {SQL_STATS} FROM b_g", ["train"])
def baseline_global(spark, sf):
    return train_base(spark, sf, levels=("global",)).select("n", *rounded_stats())


_LONG = " UNION ALL ".join(
    f"SELECT '{level}' AS level, {mach} AS machine, {typ} AS type, {win} AS \"window\", '{m}' AS metric, "
    f"{r6(f'{m}_mean')} AS mean, {r6(f'{m}_std')} AS std, n FROM {rel}"
    for level, rel, mach, typ, win in (
        ("machine+window", "b_mw", "machine", "NULL", '"window"'),
        ("machine", "b_m", "machine", "NULL", "NULL"),
        ("type", "b_t", "NULL", "type", "NULL"),
        ("global", "b_g", "NULL", "NULL", "NULL"),
    )
    for m in METRICS
)


@query("baseline_all_levels", f"WITH {baseline_ctes('train', METRICS)} {_LONG}", ["train"])
def baseline_all_levels(spark, sf):
    """All levels from one pass over the readings, in long form."""
    long = bl.to_long(train_base(spark, sf), METRICS)
    return long.select("level", "machine", "type", "window", "metric", R("mean").alias("mean"), R("std").alias("std"), "n")


_BOUNDS = f"""q AS (SELECT machine, "window", {cols('quantile_cont({m}, 0.05) AS {m}_lo, quantile_cont({m}, 0.95) AS {m}_hi', METRICS)}
 FROM train GROUP BY machine, "window")"""
_IN = "CASE WHEN t.{m} >= q.{m}_lo AND t.{m} <= q.{m}_hi THEN t.{m} END"
_ROBUST = ", ".join(
    f"{r6(f'(CASE WHEN count({i}) >= 10 THEN avg({i}) ELSE avg(t.{m}) END)')} AS {m}_mean, "
    f"{r6(f'greatest(CASE WHEN count({i}) >= 10 THEN stddev_pop({i}) ELSE stddev_pop(t.{m}) END, 1e-8)')} AS {m}_std"
    for m in METRICS
    for i in [_IN.format(m=m)]
)


@query(
    "baseline_robust",
    f'WITH {_BOUNDS} SELECT t.machine, t."window", count(*) AS n, {_ROBUST} FROM train t '
    'JOIN q ON q.machine = t.machine AND q."window" = t."window" GROUP BY t.machine, t."window"',
    ["train"],
)
def baseline_robust(spark, sf):
    base = bl.build_baselines(split(spark, sf).where("is_train"), METRICS, trim=(0.05, 0.95), levels=("machine+window",))
    return base.select("machine", "window", "n", *rounded_stats())


@query(
    "baseline_sample_std",
    f"""WITH {baseline_ctes('train', METRICS, 'stddev_samp')} SELECT 'machine+window' AS level, machine, "window", n, {SQL_STATS} FROM b_mw
UNION ALL SELECT 'global', NULL, NULL, n, {SQL_STATS} FROM b_g""",
    ["train"],
)
def baseline_sample_std(spark, sf):
    base = train_base(spark, sf, ddof=1, levels=("machine+window", "global"))
    return base.select("level", "machine", "window", "n", *rounded_stats())


@query(
    "baseline_inventory",
    f"WITH {baseline_ctes('train', METRICS)} " + " UNION ALL ".join(
        f"SELECT '{level}' AS level, count(*) AS n_keys FROM {rel}"
        for level, rel in (("machine+window", "b_mw"), ("machine", "b_m"), ("type", "b_t"), ("global", "b_g"))
    ),
    ["train"],
)
def baseline_inventory(spark, sf):
    return bl.inventory(train_base(spark, sf))


@query("known_machines", "SELECT machine, arg_min(type, timestamp) AS type FROM train GROUP BY machine", ["train"])
def known_machines(spark, sf):
    return bl.known_machines(split(spark, sf).where("is_train"))


@query(
    "baseline_saved_and_loaded",
    f'WITH {baseline_ctes("train", METRICS)} SELECT machine, "window", n, {SQL_STATS} FROM b_mw',
    ["train"],
)
def baseline_saved_and_loaded(spark, sf):
    """The machine-and-window level after a round trip through a versioned table."""
    from fleetpulse.plans.tables import new_path
    from fleetpulse.sources.store import load_baselines, save_baselines

    root = new_path(spark, "baselines")
    save_baselines(train_base(spark, sf), root, "v1")
    return load_baselines(spark, root, "v1").where("level = 'machine+window'").select("machine", "window", "n", *rounded_stats())


# Held out of training, so that every level of the fallback is used.
HOLD = (
    "machine NOT LIKE '%3' AND type <> 'firewall' AND NOT (machine LIKE '%5' AND \"window\" = 'evening')"
)
_HELD = f"held AS (SELECT * FROM train WHERE {HOLD})"
_Z = ", ".join(f"{r6(z_sql(m))} AS z_{m}" for m in METRICS)


def held_base(spark, sf, **kw):
    train = split(spark, sf).where("is_train").where(HOLD.replace('"', "`"))
    return bl.build_baselines(train, METRICS, **kw)


@query(
    "zscore_fallback",
    f"WITH {_HELD}, {baseline_ctes('held', METRICS)} SELECT r.event_id, r.machine, r.\"window\", {LEVEL_SQL} AS baseline_used, {_Z} FROM {fallback_join('windowed')}",
    ["windowed", "train"],
)
def zscore_fallback(spark, sf):
    scored = zscore(fx.windowed(spark, sf), held_base(spark, sf), METRICS)
    return scored.select("event_id", "machine", "window", "baseline_used", *[R(f"z_{m}").alias(f"z_{m}") for m in METRICS])


@query(
    "fallback_level_counts",
    f"WITH {_HELD}, {baseline_ctes('held', METRICS)} SELECT {LEVEL_SQL} AS baseline_used, count(*) AS n FROM {fallback_join('windowed')} GROUP BY 1",
    ["windowed", "train"],
)
def fallback_level_counts(spark, sf):
    used = attach_baselines(fx.windowed(spark, sf), held_base(spark, sf), METRICS)
    return used.groupBy("baseline_used").agg(F.count(F.lit(1)).alias("n"))


_ZM = ", ".join(
    f"{r6(f'((r.{m} - coalesce(m.{m}_mean, g.{m}_mean)) / coalesce(m.{m}_std, g.{m}_std))')} AS z_{m}" for m in METRICS
)


@query(
    "zscore_machine_only",
    f"""WITH {_HELD}, {baseline_ctes('held', METRICS)} SELECT r.event_id, CASE WHEN m.machine IS NOT NULL THEN 'machine' ELSE 'global' END AS baseline_used, {_ZM}
FROM windowed r LEFT JOIN b_m m ON m.machine = r.machine CROSS JOIN b_g g""",
    ["windowed", "train"],
)
def zscore_machine_only(spark, sf):
    base = held_base(spark, sf, levels=("machine", "global"))
    scored = zscore(fx.windowed(spark, sf), base, METRICS, levels=("machine", "global"))
    return scored.select("event_id", "baseline_used", *[R(f"z_{m}").alias(f"z_{m}") for m in METRICS])


_SCORE = f"greatest({', '.join(f'abs({z_sql(m)})' for m in METRICS)})"


@query(
    "z_threshold",
    f"""WITH {baseline_ctes('train', METRICS)} SELECT r.event_id, r.machine, r."window", {r6(_SCORE)} AS score, {LEVEL_SQL} AS baseline_used,
CASE WHEN {_SCORE} > 3 THEN 1 ELSE 0 END AS is_anomaly FROM {fallback_join('test')}""",
    ["train", "test"],
)
def z_threshold_query(spark, sf):
    """Baselines from the training split, z-threshold on the rest: the flagship."""
    parts = split(spark, sf)
    base = bl.build_baselines(parts.where("is_train"), METRICS)
    scored = z_threshold(zscore(parts.where("NOT is_train"), base, METRICS), METRICS)
    return scored.select("event_id", "machine", "window", R("score").alias("score"), "baseline_used", F.col("pred").alias("is_anomaly"))


@query(
    "severity_bands",
    f"WITH {baseline_ctes('windowed', METRICS)}, z AS (SELECT r.event_id, {', '.join(f'{z_sql(m)} AS {m}' for m in METRICS)} FROM {fallback_join('windowed')}), "
    + "l AS ("
    + " UNION ALL ".join(f"SELECT event_id, '{m}' AS metric, {m} AS z FROM z" for m in METRICS)
    + ") SELECT metric, CASE WHEN abs(z) >= 3 THEN 'red' WHEN abs(z) >= 2 THEN 'yellow' ELSE 'green' END AS band, count(*) AS n FROM l GROUP BY 1, 2",
    ["windowed"],
)
def severity_bands(spark, sf):
    df = fx.windowed(spark, sf)
    scored = zscore(df, bl.build_baselines(df, METRICS), METRICS)
    bands = F.array(*[F.struct(F.lit(m).alias("metric"), dec.severity(F.col(f"z_{m}")).alias("band")) for m in METRICS])
    return scored.select(F.explode(bands).alias("e")).groupBy("e.metric", "e.band").agg(F.count(F.lit(1)).alias("n"))
