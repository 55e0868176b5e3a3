"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ("readings",)):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return keep


def r6(expr: str) -> str:
    """SQL text of the 6-decimal rounding used on both sides."""
    return f"(CASE WHEN abs({expr}) < 5e-7 THEN 0.0 ELSE round({expr}, 6) END)"


def cols(template: str, names: Sequence[str], sep: str = ", ") -> str:
    return sep.join(template.format(m=m) for m in names)


def safe(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / ({den}) END)"


def baseline_ctes(train: str, metrics: Sequence[str], std: str = "stddev_pop", floor: str = "1e-8") -> str:
    """CTEs b_mw, b_m, b_t, b_g of a training relation."""
    stat = lambda f: ", ".join(
        f"avg({m}) AS {m}_mean, greatest(coalesce({std}({m}), {f}), {f}) AS {m}_std" for m in metrics
    )
    return f"""b_mw AS (SELECT machine, "window", count(*) AS n, {stat(floor)} FROM {train} GROUP BY machine, "window"),
b_m AS (SELECT machine, count(*) AS n, {stat(floor)} FROM {train} GROUP BY machine),
b_t AS (SELECT type, count(*) AS n, {stat(floor)} FROM {train} GROUP BY type),
b_g AS (SELECT count(*) AS n, {stat('CAST(1 AS DOUBLE)')} FROM {train})"""


def fallback_join(source: str) -> str:
    return f"""{source} r
LEFT JOIN b_mw mw ON mw.machine = r.machine AND mw."window" = r."window"
LEFT JOIN b_m m ON m.machine = r.machine LEFT JOIN b_t t ON t.type = r.type CROSS JOIN b_g g"""


LEVEL_SQL = (
    "CASE WHEN mw.machine IS NOT NULL THEN 'machine+window' WHEN m.machine IS NOT NULL THEN 'machine' "
    "WHEN t.type IS NOT NULL THEN 'type' ELSE 'global' END"
)


def z_sql(m: str) -> str:
    pick = lambda s: f"coalesce(mw.{m}_{s}, m.{m}_{s}, t.{m}_{s}, g.{m}_{s})"
    return f"((r.{m} - {pick('mean')}) / {pick('std')})"
