"""Scans, projections and metric selection."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import cols, query, r6
from fleetpulse.functions import decisions as dec
from fleetpulse.functions import timefeat as tf
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.operators import dashboard, sampling, selection
from fleetpulse.operators.baselines import build_baselines
from fleetpulse.operators.zscore import zscore
from fleetpulse.schemas import METRICS
from fleetpulse.sources.readings import adaptive


@query("scan_pruned", "SELECT event_id, machine, cpu FROM readings WHERE cpu > 100")
def scan_pruned(spark, sf):
    return fx.readings(spark, sf).where("cpu > 100").select("event_id", "machine", "cpu")


ADAPTIVE = ["o_orderkey", "o_custkey", "o_totalprice"]


@query(
    "scan_adaptive_features",
    " UNION ALL ".join(
        f"SELECT '__all__' AS machine, 'all' AS \"window\", '{m}' AS metric, count(*) AS n, {r6(f'avg({m})')} AS mean, "
        f"{r6(f'greatest(stddev_pop({m}), 1e-8)')} AS std FROM orders"
        for m in ADAPTIVE
    ),
    (),
)
def scan_adaptive_features(spark, sf):
    """Baselines of a table that has neither machine nor window nor known metrics."""
    from fleetpulse.operators.baselines import to_long

    df, features = adaptive(fx.table(spark, sf, "orders"))
    base = build_baselines(df, features, levels=("machine+window",))
    return to_long(base, features).select("machine", "window", "metric", "n", R("mean").alias("mean"), R("std").alias("std"))


@query(
    "scan_adaptive_zscore",
    f"""WITH b AS (SELECT avg(c_acctbal) AS m, greatest(stddev_pop(c_acctbal), 1e-8) AS s FROM customer)
SELECT c_custkey, {r6('((c_acctbal - m) / s)')} AS z FROM customer CROSS JOIN b""",
    (),
)
def scan_adaptive_zscore(spark, sf):
    df, _ = adaptive(fx.table(spark, sf, "customer"))
    base = build_baselines(df, ["c_acctbal"])
    return zscore(df, base, ["c_acctbal"]).select("c_custkey", R("z_c_acctbal").alias("z"))


@query(
    "head_sample",
    "SELECT event_id, timestamp, machine, cpu FROM readings ORDER BY timestamp, machine, event_id LIMIT 500",
)
def head_sample(spark, sf):
    return sampling.head_sample(fx.readings(spark, sf), 500).select("event_id", "timestamp", "machine", "cpu")


@query("time_window", 'SELECT event_id, hour, "window" FROM windowed', ["windowed"])
def time_window(spark, sf):
    return fx.windowed(spark, sf).select("event_id", "hour", "window")


_DOW = "(isodow(timestamp) - 1)"


@query(
    "cyclic_time",
    f"""SELECT event_id, {r6('sin(2 * pi() * hour(timestamp) / 24)')} AS hour_sin,
{r6('cos(2 * pi() * hour(timestamp) / 24)')} AS hour_cos, {r6(f'sin(2 * pi() * {_DOW} / 7)')} AS dow_sin,
{r6(f'cos(2 * pi() * {_DOW} / 7)')} AS dow_cos FROM readings""",
)
def cyclic_time(spark, sf):
    names = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]
    return tf.add_cyclic_time(fx.readings(spark, sf)).select("event_id", *[R(c).alias(c) for c in names])


_REQUEST = [
    "event_id",
    "CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 27 - 1 AS INT) END AS hour",
    "CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 9 = 0 THEN 'not a time' ELSE "
    "concat(CAST(CAST(ts AS DATE) AS STRING), 'T', lpad(CAST(hour(ts) AS STRING), 2, '0'), ':30:00') END AS timestamp",
]


@query(
    "resolve_window",
    f"""WITH q AS (SELECT {', '.join(_REQUEST)} FROM events),
p AS (SELECT *, CASE WHEN hour IS NOT NULL AND (hour < 0 OR hour > 23) THEN 'no such hour of the day'
 WHEN hour IS NULL AND timestamp IS NOT NULL AND TRY_CAST(timestamp AS TIMESTAMP) IS NULL
 THEN 'not a date and time' END AS error,
 CASE WHEN hour IS NOT NULL THEN hour ELSE hour(TRY_CAST(timestamp AS TIMESTAMP)) END AS h FROM q)
SELECT event_id, error, CASE WHEN error IS NOT NULL OR h IS NULL THEN NULL WHEN h < 6 THEN 'night'
 WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS "window" FROM p""",
    (),
)
def resolve_window(spark, sf):
    requests = fx.table(spark, sf, "events").selectExpr(*_REQUEST)
    return tf.resolve_window(requests).select("event_id", "error", "window")


@query(
    "require_metrics",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'cpu' WHEN event_id % 11 = 0 THEN 'disk_io' END AS missing FROM readings""",
)
def require_metrics(spark, sf):
    given = lambda m: F.when(~((F.col("event_id") % {"cpu": 7, "disk_io": 11}[m] == 0)), F.lit(m)) if m in ("cpu", "disk_io") else F.lit(m)
    entries = F.filter(
        F.array(*[F.struct(given(m).alias("k"), F.col(m).alias("v")) for m in METRICS]), lambda e: e["k"].isNotNull()
    )
    requests = fx.readings(spark, sf).withColumn("metrics", F.map_from_entries(entries))
    return selection.require_metrics(requests, METRICS).select("event_id", "missing")


@query(
    "normalise_cause",
    """SELECT event_id, coalesce(nullif(anomaly_type, ''), 'normal') AS cause,
CASE WHEN coalesce(nullif(anomaly_type, ''), 'normal') = 'cascade' THEN 'normal'
ELSE coalesce(nullif(anomaly_type, ''), 'normal') END AS training_cause FROM readings""",
)
def normalise_cause(spark, sf):
    raw = F.col("anomaly_type")
    return fx.readings(spark, sf).select(
        "event_id", dec.normalise_cause(raw).alias("cause"), dec.normalise_cause(raw, True).alias("training_cause")
    )


@query(
    "first_two_weeks",
    "SELECT event_id, timestamp, machine FROM readings WHERE timestamp < (SELECT min(timestamp) FROM readings) + INTERVAL 14 DAY",
)
def first_two_weeks(spark, sf):
    return tf.first_days(fx.readings(spark, sf), 14).select("event_id", "timestamp", "machine")


@query(
    "systematic_sample",
    "SELECT event_id, machine, label FROM readings WHERE hour(timestamp) % 4 = 0 AND minute(timestamp) = 0",
)
def systematic_sample(spark, sf):
    return tf.every_nth_hour(fx.readings(spark, sf)).select("event_id", "machine", "label")


@query("normal_only_training", "SELECT event_id, machine, cpu FROM train WHERE label = 0", ["train"])
def normal_only_training(spark, sf):
    split = sampling.stratified_split(fx.windowed(spark, sf))
    return split.where("is_train AND label = 0").select("event_id", "machine", "cpu")


@query(
    "type_filter",
    "SELECT event_id, machine, type FROM readings WHERE type IN ('web', 'router')",
)
def type_filter(spark, sf):
    return dashboard.of_types(fx.readings(spark, sf), ["web", "router"]).select("event_id", "machine", "type")


_CONST = ["cpu", "ram", "network", "disk_io", "flat"]


@query(
    "drop_constant_metrics",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r6(f'var_samp({m})')} AS variance FROM (SELECT *, CAST(7 AS DOUBLE) AS flat FROM readings) "
        "HAVING " + f"var_samp({m}) > 0"
        for m in _CONST
    ),
)
def drop_constant_metrics(spark, sf):
    df = fx.readings(spark, sf).withColumn("flat", F.lit(7.0))
    kept, names = selection.drop_constant(df.select("event_id", *_CONST), _CONST)
    return selection.variances(kept, names).select("metric", R("variance").alias("variance"))


@query(
    "metric_variance",
    " UNION ALL ".join(
        f"SELECT machine, '{m}' AS metric, {r6(f'var_samp({m})')} AS variance FROM readings GROUP BY machine" for m in METRICS
    ),
)
def metric_variance(spark, sf):
    return selection.variances(fx.readings(spark, sf), METRICS, ["machine"]).select(
        "machine", "metric", R("variance").alias("variance")
    )


_TOP = f"""WITH v AS ({" UNION ALL ".join(f"SELECT machine, '{m}' AS metric, var_samp({m}) AS variance FROM readings GROUP BY machine" for m in METRICS)}),
k AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY variance DESC, metric) AS rank FROM v)"""
_PICK = "CASE {a}.metric " + " ".join(f"WHEN '{m}' THEN r.{m}" for m in METRICS) + " END AS {n}"


@query(
    "top_metrics_per_machine",
    f"{_TOP} SELECT r.event_id, r.machine, "
    + ", ".join(_PICK.format(a=a, n=n) for a, n in (("a", "cpu"), ("b", "ram"), ("c", "network")))
    + """ FROM readings r JOIN k a ON a.machine = r.machine AND a.rank = 1
JOIN k b ON b.machine = r.machine AND b.rank = 2 JOIN k c ON c.machine = r.machine AND c.rank = 3""",
)
def top_metrics_per_machine(spark, sf):
    df = fx.readings(spark, sf).select("event_id", "machine", *METRICS)
    return selection.select_top_per_machine(df, METRICS)


@query(
    "matrix_first_three",
    "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS cpu, CAST(embedding[2] AS DOUBLE) AS ram, CAST(embedding[3] AS DOUBLE) AS network FROM embeddings",
    (),
)
def matrix_first_three(spark, sf):
    df, names = fx.matrix(spark, sf)
    return selection.select_metrics(df, names, "first3").select("vec_id", "cpu", "ram", "network")


@query(
    "synthetic_timestamps",
    """SELECT vec_id, CAST(label AS STRING) AS machine, TIMESTAMP '2026-01-01 00:00:00'
+ to_minutes(CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER)) AS timestamp FROM embeddings""",
    (),
)
def synthetic_timestamps(spark, sf):
    df = fx.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("machine"))
    return selection.synthetic_minutes(df, ["machine"], ["vec_id"], "2026-01-01 00:00:00")


_FEED_METRICS = ("click", "view", "error", "purchase", "signup")


@query(
    "feed_to_wide",
    """WITH f AS (SELECT machine, type, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS tick, timestamp, event_id,
CASE event_id % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'ram' ELSE 'network' END AS metric,
CASE event_id % 3 WHEN 0 THEN disk_io WHEN 1 THEN ram ELSE network END AS value FROM readings),
l AS (SELECT *, row_number() OVER (PARTITION BY machine, type, tick, metric ORDER BY timestamp DESC) AS rn FROM f)
SELECT machine, type, tick, max(CASE WHEN metric = 'cpu' THEN value END) AS cpu, max(CASE WHEN metric = 'ram' THEN value END) AS ram,
max(CASE WHEN metric = 'network' THEN value END) AS network FROM l WHERE rn = 1 GROUP BY 1, 2, 3 HAVING count(*) = 3""",
)
def feed_to_wide(spark, sf):
    """Latest value of each metric per machine and day from a long feed; incomplete rows go."""
    turn = F.col("event_id") % 3
    feed = fx.readings(spark, sf).select(
        "machine",
        "type",
        F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("tick"),
        F.col("timestamp").alias("ts"),
        F.when(turn == 0, "cpu").when(turn == 1, "ram").otherwise("network").alias("metric"),
        F.when(turn == 0, F.col("disk_io")).when(turn == 1, F.col("ram")).otherwise(F.col("network")).alias("value"),
    )
    return selection.widen_feed(feed, ("cpu", "ram", "network"))


@query(
    "graph_document",
    """SELECT machine, router FROM topology UNION ALL SELECT router AS machine, NULL AS router FROM topology GROUP BY router""",
    ["topology"],
)
def graph_document(spark, sf):
    """Edges and routers as ``read_graph`` returns them, from the topology of the events."""
    edges = fx.topology(spark, sf)
    names = edges.select(F.col("router").alias("machine")).distinct().withColumn("router", F.lit(None).cast("string"))
    return edges.unionByName(names)


@query(
    "union_of_machines",
    """SELECT machine, CAST(event_id AS STRING) AS id, cpu, CAST(NULL AS DOUBLE) AS network FROM readings WHERE type = 'web'
UNION ALL SELECT machine, CAST(event_id AS STRING) AS id, CAST(NULL AS DOUBLE) AS cpu, network FROM readings WHERE type <> 'web'""",
)
def union_of_machines(spark, sf):
    """Union of inputs that kept different metrics."""
    df = fx.readings(spark, sf).withColumn("id", F.col("event_id").cast("string"))
    web = df.where("type = 'web'").select("machine", "id", "cpu")
    rest = df.where("type <> 'web'").select("machine", "id", "network")
    return web.unionByName(rest, allowMissingColumns=True)
