"""The core jobs over line items: more rows, other metrics, no time of day."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import LEVEL_SQL, baseline_ctes, fallback_join, query, r6, z_sql
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.operators import baselines as bl
from fleetpulse.operators import evaluate, rolling
from fleetpulse.operators.zscore import z_threshold, zscore

V = fx.VOLUME_METRICS
VIEW = ["volume"]
STATS = [f"{m}_{s}" for m in V for s in ("mean", "std")]
# A sum of prices keeps some 15 digits, whatever its order: 3 decimals of a mean over many rows are safe. Means of at
# most ten prices end within 5 decimals or never, so that rounding there meets no tie.


def rounded_sql(name: str, expr: str, digits: int) -> str:
    return f"(round({expr}, {digits}) + 0.0)" if name.startswith("price") else r6(expr)


def rounded(name: str, digits: int):
    return (F.round(name, digits) + 0.0 if name.startswith("price") else R(name)).alias(name)


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "machine"]


@query(
    "bulk_baselines",
    f"WITH {baseline_ctes('volume', V)} SELECT 'machine' AS level, machine AS name, n, {', '.join(f'{rounded_sql(s, s, 3)} AS {s}' for s in STATS)} FROM b_m "
    f"UNION ALL SELECT 'type', type, n, {', '.join(f'{rounded_sql(s, s, 3)} AS {s}' for s in STATS)} FROM b_t "
    f"UNION ALL SELECT 'global', NULL, n, {', '.join(f'{rounded_sql(s, s, 3)} AS {s}' for s in STATS)} FROM b_g",
    VIEW,
)
def bulk_baselines(spark, sf):
    base = bl.build_baselines(fx.volume(spark, sf), V, levels=("machine", "type", "global"))
    return base.select("level", F.coalesce("machine", "type").alias("name"), "n", *[rounded(s, 3) for s in STATS])


_BIG = f"greatest({', '.join(f'abs({z_sql(m)})' for m in V)})"


@query(
    "bulk_zscore",
    f"WITH {baseline_ctes('volume', V)} SELECT {', '.join('r.' + k for k in KEYS)}, {LEVEL_SQL} AS baseline_used, {r6(_BIG)} AS score, CASE WHEN {_BIG} > 3 THEN 1 ELSE 0 END AS pred FROM {fallback_join('volume')}",
    VIEW,
)
def bulk_zscore(spark, sf):
    df = fx.volume(spark, sf)
    out = z_threshold(zscore(df, bl.build_baselines(df, V), V), V)
    return out.select(*KEYS, "baseline_used", R("score").alias("score"), "pred")


_O = "PARTITION BY machine ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey, price"
_ROLL = ", ".join(
    f"{rounded_sql(m, f'avg({m}) OVER ({_O} ROWS 9 PRECEDING)', 5)} AS {m}_rolling_mean, "
    f"{rounded_sql(m, f'coalesce(stddev_samp({m}) OVER ({_O} ROWS 9 PRECEDING), 0)', 5)} AS {m}_rolling_std, "
    f"{rounded_sql(m, f'coalesce({m} - lag({m}, 9) OVER ({_O}), 0)', 5)} AS {m}_delta"
    for m in V
)


@query("bulk_rolling", f"SELECT {', '.join(KEYS)}, {_ROLL} FROM volume", VIEW)
def bulk_rolling(spark, sf):
    out = rolling.add_rolling(fx.volume(spark, sf), V, order=fx.VOLUME_ORDER)
    return out.select(*KEYS, *[rounded(n, 5) for n in rolling.rolling_names(V)])


@query(
    "bulk_point_adjust",
    f"""WITH p AS (SELECT *, CASE WHEN discount > 0.08 THEN 1 ELSE 0 END AS pred FROM volume),
s AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER ({_O}), 0) <> 1 THEN 1 ELSE 0 END AS st FROM p),
b AS (SELECT *, sum(st) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS blk FROM s),
a AS (SELECT *, CASE WHEN label = 1 THEN max(pred) OVER (PARTITION BY machine, blk, label) ELSE pred END AS pred_adj FROM b)
SELECT type, count(*) AS n, CAST(sum(pred) AS BIGINT) AS flagged, CAST(sum(pred_adj) AS BIGINT) AS flagged_adj FROM a GROUP BY type""",
    VIEW,
)
def bulk_point_adjust(spark, sf):
    df = fx.volume(spark, sf).selectExpr("*", "CASE WHEN discount > 0.08D THEN 1 ELSE 0 END AS pred")
    out = evaluate.point_adjust(df, order=fx.VOLUME_ORDER, score=None)
    return out.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("pred").cast("bigint")).alias("flagged"), F.sum(F.col("pred_adj").cast("bigint")).alias("flagged_adj")
    )
