"""Root causes, the dependency graph and the dashboard."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import query, r6
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.operators import dashboard
from fleetpulse.operators import rootcause as rc
from fleetpulse.plans.tables import materialize

DAY = ("day_anomalies", "topology")


def day(spark, sf):
    return fx.anomalies(spark, sf, "day")


_FLEET = """fleet AS (SELECT DISTINCT machine, type FROM readings),
pos AS (SELECT machine, type, row_number() OVER (ORDER BY machine) - 1 AS i FROM fleet),
rt AS (SELECT machine AS router, row_number() OVER (ORDER BY machine) - 1 AS r FROM fleet WHERE type = 'router')"""


@query(
    "assign_routers",
    f"""WITH {_FLEET} SELECT machine, router FROM pos JOIN rt ON r = i % (SELECT count(*) FROM rt)
WHERE type NOT IN ('router', 'firewall', 'dns')""",
)
def assign_routers(spark, sf):
    return rc.assign_routers(fx.readings(spark, sf).select("machine", "type").distinct())


@query("router_fan_out", "SELECT router, count(*) AS downstream FROM topology GROUP BY router", ["topology"])
def router_fan_out(spark, sf):
    return rc.fan_out(fx.topology(spark, sf))


_DOWN = """down AS (SELECT a.tick, t.router AS machine, count(*) AS n, string_agg(a.machine, ',' ORDER BY a.machine) AS names
FROM {a} a JOIN topology t ON t.machine = a.machine JOIN {a} b ON b.tick = a.tick AND b.machine = t.router GROUP BY 1, 2)"""


@query(
    "downstream_anomalous",
    f"WITH {_DOWN.format(a='day_anomalies')} SELECT tick, machine, n AS downstream_anomalous_count, names AS downstream_anomalous FROM down",
    DAY,
)
def downstream_anomalous(spark, sf):
    out = rc.score_root_causes(day(spark, sf), fx.topology(spark, sf), with_list=True)
    return out.where("downstream_anomalous_count > 0").select(
        "tick",
        "machine",
        F.col("downstream_anomalous_count").cast("bigint").alias("downstream_anomalous_count"),
        F.array_join("downstream_anomalous", ",").alias("downstream_anomalous"),
    )


@query(
    "router_also_anomalous",
    """SELECT a.tick, a.machine, t.router FROM day_anomalies a JOIN topology t ON t.machine = a.machine
JOIN day_anomalies b ON b.tick = a.tick AND b.machine = t.router""",
    DAY,
)
def router_also_anomalous(spark, sf):
    return rc.anomaly_links(day(spark, sf), fx.topology(spark, sf)).select("tick", "machine", "router")


_SCORED = """{down}, rts AS (SELECT DISTINCT router FROM topology), sc AS (SELECT a.tick, a.machine, a.score, rts.router IS NOT NULL AS is_router, t.router AS upstream_router,
coalesce(d.n, 0) AS downstream_anomalous_count, a.score + CAST(0.15 AS DOUBLE) * coalesce(d.n, 0) AS root_cause_score,
CASE WHEN d.n > 0 THEN 'likely_root_cause' WHEN rts.router IS NOT NULL THEN 'isolated' WHEN u.machine IS NOT NULL THEN 'downstream_effect' ELSE 'isolated' END AS role
FROM {a} a LEFT JOIN topology t ON t.machine = a.machine LEFT JOIN rts ON rts.router = a.machine LEFT JOIN down d ON d.tick = a.tick AND d.machine = a.machine
LEFT JOIN {a} u ON u.tick = a.tick AND u.machine = t.router)"""


def _scored(a):
    return _SCORED.format(a=a, down=_DOWN.format(a=a))


@query(
    "root_cause_ranking",
    f"""WITH {_scored('day_anomalies')} SELECT tick, machine, {r6('score')} AS score, is_router, upstream_router, downstream_anomalous_count,
{r6('root_cause_score')} AS root_cause_score, role, row_number() OVER (PARTITION BY tick ORDER BY root_cause_score DESC, machine) AS rank FROM sc""",
    DAY,
)
def root_cause_ranking(spark, sf):
    ranked = rc.rank_root_causes(rc.score_root_causes(day(spark, sf), fx.topology(spark, sf)))
    return rc.result_rows(ranked).select(
        "tick", "machine", "score", "is_router", "upstream_router",
        F.col("downstream_anomalous_count").cast("bigint").alias("downstream_anomalous_count"), "root_cause_score", "role", "rank",
    )


@query("root_cause_roles", f"WITH {_scored('day_anomalies')} SELECT role, count(*) AS n FROM sc GROUP BY role", DAY)
def root_cause_roles(spark, sf):
    return rc.score_root_causes(day(spark, sf), fx.topology(spark, sf)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "likely_root_causes",
    f"""WITH {_scored('day_anomalies')} SELECT tick, count(*) AS input_count, coalesce(string_agg(CASE WHEN role = 'likely_root_cause' THEN machine END, ','
ORDER BY root_cause_score DESC, machine), '') AS likely_root_causes FROM sc GROUP BY tick""",
    DAY,
)
def likely_root_causes(spark, sf):
    out = rc.likely_root_causes(rc.score_root_causes(day(spark, sf), fx.topology(spark, sf)))
    return out.withColumn("likely_root_causes", F.array_join("likely_root_causes", ","))


@query(
    "top_root_causes",
    f"""WITH {_scored('day_anomalies')}, k AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY root_cause_score DESC, machine) AS rank,
CASE WHEN role = 'likely_root_cause' THEN row_number() OVER (PARTITION BY tick, role ORDER BY root_cause_score DESC, machine) END AS likely FROM sc),
l AS (SELECT tick, coalesce(string_agg(CASE WHEN likely <= 2 THEN machine END, ',' ORDER BY likely), '') AS first_two FROM k GROUP BY tick)
SELECT k.tick, machine, rank, {r6('root_cause_score')} AS root_cause_score, first_two FROM k JOIN l ON l.tick = k.tick WHERE rank <= 3""",
    DAY,
)
def top_root_causes(spark, sf):
    """The three strongest anomalies of each tick beside its first two likely root causes."""
    scored = materialize(rc.score_root_causes(day(spark, sf), fx.topology(spark, sf)), "scored")
    likely = rc.likely_root_causes(scored, k=2).select("tick", F.array_join("likely_root_causes", ",").alias("first_two"))
    top = rc.top_root_causes(scored, 3).select("tick", "machine", F.col("rank").cast("bigint").alias("rank"), R("root_cause_score").alias("root_cause_score"))
    return top.join(likely, "tick")


@query(
    "tick_rule",
    f"""WITH {_scored('hour_anomalies')}, c AS (SELECT tick, count(*) AS n FROM hour_anomalies GROUP BY tick)
SELECT sc.tick, machine, n AS n_anomalous, CASE WHEN n = 1 THEN 'isolated' ELSE role END AS role, {r6('(CASE WHEN n = 1 THEN score ELSE root_cause_score END)')} AS root_cause_score
FROM sc JOIN c ON c.tick = sc.tick""",
    ("hour_anomalies", "topology"),
)
def tick_rule(spark, sf):
    out = rc.tick_roles(fx.anomalies(spark, sf, "hour"), fx.topology(spark, sf))
    return out.select("tick", "machine", "n_anomalous", "role", R("root_cause_score").alias("root_cause_score"))


@query(
    "missing_score_is_one",
    "SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN least(cpu / 500, CAST(1 AS DOUBLE)) END, CAST(1 AS DOUBLE)) AS score FROM readings WHERE label = 1",
)
def missing_score_is_one(spark, sf):
    df = fx.readings(spark, sf).where("label = 1").selectExpr("event_id", "CASE WHEN event_id % 3 <> 0 THEN least(cpu / 500, 1D) END AS iso")
    return df.select("event_id", rc.score_or_one(F.col("iso")).alias("score"))


@query(
    "graph_rule_propagation",
    """SELECT tick, machine, CASE WHEN max(own) = 1 THEN 'detector' ELSE 'graph_rule' END AS source FROM (SELECT tick, machine, 1 AS own FROM day_anomalies
UNION ALL SELECT a.tick, t.machine, 0 FROM day_anomalies a JOIN topology t ON t.router = a.machine) GROUP BY 1, 2""",
    DAY,
)
def graph_rule_propagation(spark, sf):
    return rc.propagate(day(spark, sf).select("tick", "machine"), fx.topology(spark, sf))


@query(
    "dashboard_tick_averages",
    f"""SELECT time_bucket(INTERVAL 30 SECOND, timestamp) AS tick, {r6('avg(cpu)')} AS avg_cpu, {r6('avg(network)')} AS avg_network, {r6('avg(load_avg)')} AS avg_load_avg,
count(*) AS n FROM readings WHERE type IN ('web', 'db') GROUP BY 1""",
)
def dashboard_tick_averages(spark, sf):
    df = dashboard.of_types(fx.readings(spark, sf), ["web", "db"])
    out = dashboard.tick_averages(df)
    return out.select("tick", *[R(c).alias(c) for c in ("avg_cpu", "avg_network", "avg_load_avg")], "n")


@query(
    "dashboard_counts",
    f"""WITH {_scored('day_anomalies')} SELECT count(*) AS n_anomalies, count(DISTINCT machine) AS n_machines,
count(DISTINCT CASE WHEN role = 'likely_root_cause' THEN machine END) AS n_root_causes FROM sc""",
    DAY,
)
def dashboard_counts(spark, sf):
    return dashboard.anomaly_counts(rc.score_root_causes(day(spark, sf), fx.topology(spark, sf)))


@query(
    "machines_by_score",
    f"SELECT machine, {r6('max(score)')} AS score FROM day_anomalies GROUP BY machine ORDER BY 2 DESC, 1",
    ["day_anomalies"],
)
def machines_by_score(spark, sf):
    top = day(spark, sf).groupBy("machine").agg(R(F.max("score")).alias("score"))
    return dashboard.by_score(top)


@query(
    "detection_vs_truth",
    """WITH d AS (SELECT date_trunc('hour', timestamp) AS tick, count(*) AS detected FROM readings WHERE cpu > 120 AND ram > 20 GROUP BY 1),
t AS (SELECT date_trunc('hour', timestamp) AS tick, count(*) AS actual FROM readings WHERE label = 1 GROUP BY 1)
SELECT coalesce(d.tick, t.tick) AS tick, coalesce(detected, 0) AS detected, coalesce(actual, 0) AS actual FROM d FULL JOIN t ON d.tick = t.tick""",
)
def detection_vs_truth(spark, sf):
    df = fx.readings(spark, sf).withColumn("tick", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    return dashboard.detection_vs_truth(df.where("cpu > 120 AND ram > 20"), df.where("label = 1"))


@query(
    "latest_tick_metrics",
    f"""WITH t AS (SELECT *, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS tick, CASE WHEN cpu > 100 THEN 1 ELSE 0 END AS pred FROM readings)
SELECT CAST(sum(pred) AS BIGINT) AS anomaly_count, {r6('avg(cpu)')} AS avg_cpu, {r6('avg(load_avg)')} AS avg_load, CAST(sum(label) AS BIGINT) AS ground_truth
FROM t WHERE tick = (SELECT max(tick) FROM t)""",
)
def latest_tick_metrics(spark, sf):
    df = fx.readings(spark, sf).selectExpr("*", "date_trunc('day', timestamp) AS tick", "CASE WHEN cpu > 100 THEN 1 ELSE 0 END AS pred")
    out = dashboard.latest_tick_metrics(df)
    return out.select("anomaly_count", R("avg_cpu").alias("avg_cpu"), R("avg_load").alias("avg_load"), "ground_truth")
