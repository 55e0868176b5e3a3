"""Root-cause ranking over the router-to-machine dependency graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import r6
from fleetpulse.plans.chunks import CHUNK_ROWS, rank_within
from fleetpulse.plans.prefix import global_index
from fleetpulse.schemas import DOWNSTREAM_WEIGHT, NETWORK_GEAR


def assign_routers(fleet: DataFrame, exclude: Sequence[str] = NETWORK_GEAR, order: Sequence[str] = ("machine",)) -> DataFrame:
    """Edges ``machine, router``: the i-th machine depends on router ``i mod n_routers``."""
    placed = global_index(fleet, order, "_i").withColumn("_i", F.col("_i") - 1)
    routers = global_index(fleet.where(F.col("type") == "router"), order, "_r").select(
        F.col("machine").alias("router"), (F.col("_r") - 1).alias("_r")
    )
    total = routers.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return (
        placed.where(~F.col("type").isin(*exclude))
        .crossJoin(F.broadcast(total.where(F.col("_total") > 0)))
        .withColumn("_r", F.pmod(F.col("_i"), F.col("_total")))
        .join(routers, "_r")
        .select("machine", "router")
    )


def fan_out(edges: DataFrame) -> DataFrame:
    """Number of dependents per router."""
    return edges.groupBy("router").agg(F.count(F.lit(1)).alias("downstream"))


def anomaly_links(anomalies: DataFrame, edges: DataFrame, by: str = "tick") -> DataFrame:
    """``tick, router, machine`` where a router and one of its dependents are anomalous together."""
    dependents = anomalies.select(by, "machine").join(edges, "machine")
    routers = anomalies.select(by, F.col("machine").alias("router"))
    return dependents.join(routers, [by, "router"], "left_semi")


def score_root_causes(
    anomalies: DataFrame,
    edges: DataFrame,
    weight: float = DOWNSTREAM_WEIGHT,
    by: str = "tick",
    routers: DataFrame | None = None,
    with_list: bool = False,
) -> DataFrame:
    """Score and role of every anomalous machine of a tick.

    Score is the machine's own plus ``weight`` per anomalous dependent. ``routers`` defaults to the
    routers that occur in ``edges``. ``with_list`` adds the dependents' names; the count alone needs no
    per-router list.
    """
    links = anomaly_links(anomalies, edges, by)
    aggs = [F.count(F.lit(1)).alias("_down")]
    if with_list:
        aggs.append(F.array_sort(F.collect_list("machine")).alias("downstream_anomalous"))
    down = links.groupBy(by, F.col("router").alias("machine")).agg(*aggs)
    hit = links.select(by, "machine", F.lit(1).alias("_router_hit"))
    names = (edges.select("router") if routers is None else routers.select(F.col("machine").alias("router"))).distinct()
    out = (
        anomalies.join(edges.withColumnRenamed("router", "upstream_router"), "machine", "left")
        .join(names.select(F.col("router").alias("machine"), F.lit(True).alias("_is_router")), "machine", "left")
        .join(down, [by, "machine"], "left")
        .join(hit, [by, "machine"], "left")
    )
    count = F.coalesce("_down", F.lit(0))
    out = (
        out.withColumn("is_router", F.coalesce("_is_router", F.lit(False)))
        .withColumn("downstream_anomalous_count", count)
        .withColumn("root_cause_score", F.col("score") + F.lit(weight) * count)
        .withColumn("role", role_of(count, F.col("is_router"), F.col("_router_hit").isNotNull()))
    )
    if with_list:
        out = out.withColumn("downstream_anomalous", F.coalesce("downstream_anomalous", F.array().cast("array<string>")))
    return out.drop("_is_router", "_down", "_router_hit")


def role_of(downstream: Column, is_router: Column, router_hit: Column) -> Column:
    return (
        F.when(downstream > 0, F.lit("likely_root_cause"))
        .when(is_router, F.lit("isolated"))
        .when(router_hit, F.lit("downstream_effect"))
        .otherwise(F.lit("isolated"))
    )


def rank_root_causes(scored: DataFrame, by: str = "tick", chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Add ``rank`` per tick, highest score first, ties by machine name."""
    return rank_within(scored, [by], [F.desc("root_cause_score"), F.asc("machine")], "rank", chunk_rows)


def top_root_causes(scored: DataFrame, k: int, by: str = "tick") -> DataFrame:
    """The first ``k`` rows of ``rank_root_causes`` per tick. Every task keeps ``k`` rows of a tick before they travel,
    so a tick of any size costs ``k`` rows per task."""
    order = f"row_number() OVER (PARTITION BY `{by}` ORDER BY root_cause_score DESC, machine)"
    return scored.withColumn("rank", F.expr(order)).where(F.col("rank") <= k)


def likely_root_causes(scored: DataFrame, by: str = "tick", k: int | None = None) -> DataFrame:
    """Per tick: number of anomalies and the machines that are likely root causes, best first; with ``k`` at most so many."""
    if k is not None:
        best = top_root_causes(scored.where("role = 'likely_root_cause'"), k, by)
        named = best.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "machine"))), lambda e: e["machine"]).alias("_named"))
        counts = scored.groupBy(by).agg(F.count(F.lit(1)).alias("input_count")).join(named, by, "left")
        return counts.select(by, "input_count", F.coalesce("_named", F.array().cast("array<string>")).alias("likely_root_causes"))
    likely = F.when(F.col("role") == "likely_root_cause", F.struct((-F.col("root_cause_score")).alias("s"), "machine"))
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("input_count"),
        F.transform(F.sort_array(F.collect_list(likely)), lambda e: e["machine"]).alias("likely_root_causes"),
    )


def tick_roles(anomalies: DataFrame, edges: DataFrame, by: str = "tick", weight: float = DOWNSTREAM_WEIGHT, routers=None) -> DataFrame:
    """Per-tick rule: a lone anomaly is isolated without asking the graph, several are ranked by it."""
    sizes = anomalies.groupBy(by).agg(F.count(F.lit(1)).alias("n_anomalous"))
    scored = score_root_causes(anomalies, edges, weight, by, routers).join(sizes, by)
    lone = F.col("n_anomalous") == 1
    return scored.withColumn("role", F.when(lone, F.lit("isolated")).otherwise(F.col("role"))).withColumn(
        "root_cause_score", F.when(lone, F.col("score")).otherwise(F.col("root_cause_score"))
    )


def score_or_one(score: Column) -> Column:
    """Severity of a flagged machine; 1.0 when the isolation score is absent."""
    return F.coalesce(score, F.lit(1.0))


def propagate(flagged: DataFrame, edges: DataFrame, by: str = "tick") -> DataFrame:
    """Graph rule: a flagged router also flags every dependent. Returns distinct ``tick, machine, source``."""
    rule = flagged.select(by, F.col("machine").alias("router")).join(edges, "router").select(by, "machine")
    own = flagged.select(by, "machine", F.lit(1).alias("_own"))
    return (
        own.unionByName(rule.withColumn("_own", F.lit(0)))
        .groupBy(by, "machine")
        .agg(F.when(F.max("_own") == 1, F.lit("detector")).otherwise(F.lit("graph_rule")).alias("source"))
    )


def result_rows(ranked: DataFrame, by: str = "tick") -> DataFrame:
    return ranked.withColumns({"score": r6("score"), "root_cause_score": r6("root_cause_score")})
