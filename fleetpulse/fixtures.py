"""Views of the given tables in the engine's schemas, each as a DataFrame and as SQL text.

The expressions are valid in both Spark and ANSI SQL, so queries and oracles share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.timefeat import add_window

MACHINE = "concat('m-', lpad(CAST(user_id AS STRING), 5, '0'))"
K = "CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE)"
BUCKET = """CASE CAST(floor({k} / 17) AS INT) WHEN 0 THEN 'cpu_spike' WHEN 1 THEN 'memory_leak'
 WHEN 2 THEN 'network_flood' WHEN 3 THEN 'disk_saturation' WHEN 4 THEN 'silent_failure' ELSE 'cascade' END"""

READING_EXPRS = [
    "event_id",
    "ts AS timestamp",
    f"{MACHINE} AS machine",
    "CASE WHEN user_id < 4 THEN 'router' WHEN user_id < 6 THEN 'firewall' WHEN user_id % 4 = 0 THEN 'web' "
    "WHEN user_id % 4 = 1 THEN 'app' WHEN user_id % 4 = 2 THEN 'db' ELSE 'cache' END AS type",
    "value AS cpu",
    f"{K} AS ram",
    "CAST((event_id * 7919) % 500 AS DOUBLE) AS network",
    "CAST((event_id * 104729) % 100 AS DOUBLE) AS disk_io",
    "CAST((event_id * 1299709) % 100 AS DOUBLE) AS disk_usage",
    "value / 25 AS load_avg",
    "CASE WHEN value > 150 THEN 1 ELSE 0 END AS label",
    f"CASE WHEN value > 150 THEN {BUCKET.format(k=K)} WHEN event_id % 2 = 0 THEN '' ELSE NULL END AS anomaly_type",
]
WINDOW_SQL = (
    "CASE WHEN hour(timestamp) < 6 THEN 'night' WHEN hour(timestamp) < 12 THEN 'morning' "
    "WHEN hour(timestamp) < 18 THEN 'afternoon' ELSE 'evening' END"
)

# The classes of the probability fixture, in a fixed order.
CLASSES = ["normal", "cpu_spike", "memory_leak", "network_flood", "disk_saturation", "silent_failure", "cascade"]

PREDICTION_EXPRS = [
    "CAST(event_id AS STRING) AS id",
    "timestamp",
    "machine",
    "type AS machine_type",
    "{w} AS time_window",
    "concat('{{\"cpu\":', CAST(CAST(floor(cpu) AS INT) AS STRING), ',\"ram\":', CAST(CAST(floor(ram) AS INT) AS STRING), "
    "',\"network\":', CAST(CAST(floor(network) AS INT) AS STRING), ',\"disk_io\":', CAST(CAST(floor(disk_io) AS INT) AS STRING), "
    "',\"disk_usage\":', CAST(CAST(floor(disk_usage) AS INT) AS STRING), "
    "CASE WHEN event_id % 70 = 0 THEN '' ELSE concat(',\"load_avg\":', CAST(CAST(floor(load_avg) AS INT) AS STRING)) END, '}}') "
    "AS raw_metrics_json",
    "1 / (1 + cpu / 100) AS xgb_p_normal",
    "least(cpu / 500, CAST(1 AS DOUBLE)) AS iso_score",
    "CASE WHEN cpu > 100 THEN 1 ELSE 0 END AS final_is_anomaly",
    "CASE WHEN cpu > 100 THEN {bucket} END AS final_cause",
    "label",
    "CASE WHEN event_id % 10 <> 0 THEN NULL WHEN event_id % 130 = 0 THEN 'maybe' "
    "WHEN cpu > 100 AND label = 1 THEN 'true_positive' WHEN cpu > 100 THEN 'false_positive' "
    "WHEN label = 1 THEN 'false_negative' ELSE 'true_negative' END AS operator_verdict",
]
_PREDICTION = [e.format(w=WINDOW_SQL, bucket=BUCKET.format(k="ram")) for e in PREDICTION_EXPRS]

VERDICT_EXPRS = [
    "CAST(event_id * 3 % 20011 AS STRING) AS id",
    "CASE event_id % 5 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'true_negative' "
    "WHEN 3 THEN 'false_negative' ELSE 'unsure' END AS verdict",
    "ts AS verdict_timestamp",
    "concat('note ', CAST(event_id AS STRING)) AS notes",
    "event_id AS seq",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*READING_EXPRS)


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_window(readings(spark, sf_dir))


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where("user_id >= 6")
        .selectExpr(f"{MACHINE} AS machine", "concat('m-', lpad(CAST(user_id % 4 AS STRING), 5, '0')) AS router")
        .distinct()
    )


def routers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).where("type = 'router'").select("machine").distinct()


def anomalies(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    return (
        readings(spark, sf_dir)
        .where("label = 1")
        .groupBy(F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("tick"), "machine")
        .agg((F.max("cpu") / 500).alias("score"))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).selectExpr(*_PREDICTION)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 6 = 0").selectExpr(*VERDICT_EXPRS)


def class_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, label, probs``: one probability per class, made from the event number."""
    weights = [f"(1 + (event_id * {17 + i}) % 97)" for i in range(len(CLASSES))]
    total = "(" + " + ".join(weights) + ")"
    pairs = ", ".join(
        f"named_struct('cause', '{c}', 'p', CAST({w} AS DOUBLE) / {total})" for c, w in zip(CLASSES, weights)
    )
    return readings(spark, sf_dir).selectExpr("event_id", "label", "anomaly_type", f"array({pairs}) AS probs")


VOLUME_METRICS = ("quantity", "price", "discount", "tax")


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings of suppliers, typed by nation."""
    items = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        items.join(suppliers, items.l_suppkey == suppliers.s_suppkey)
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate AS timestamp", "CAST(l_suppkey AS STRING) AS machine",
            "n_name AS type", "'all' AS window", "l_quantity AS quantity", "l_extendedprice AS price",
            "l_discount AS discount", "l_tax AS tax", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label",
        )
    )


VOLUME_ORDER = ("timestamp", "l_orderkey", "l_linenumber", "l_partkey", "price")


def matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Embeddings as a wide anonymous metric matrix; label 9 is the anomaly."""
    names = [f"col_{i}" for i in range(64)]
    wide = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
        F.when(F.col("label") == 9, 1).otherwise(0).alias("label"),
    )
    return wide, names


def _select(exprs, source, where=""):
    return f"SELECT {', '.join(exprs)} FROM {source} {where}".strip()


VIEWS = {
    "readings": _select(READING_EXPRS, "events"),
    "windowed": f'SELECT *, CAST(hour(timestamp) AS INT) AS hour, {WINDOW_SQL} AS "window" FROM readings',
    "topology": (
        f"SELECT DISTINCT {MACHINE} AS machine, concat('m-', lpad(CAST(user_id % 4 AS STRING), 5, '0')) AS router "
        "FROM events WHERE user_id >= 6"
    ),
    "hour_anomalies": (
        "SELECT date_trunc('hour', timestamp) AS tick, machine, max(cpu) / 500 AS score "
        "FROM readings WHERE label = 1 GROUP BY 1, 2"
    ),
    "day_anomalies": (
        "SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS tick, machine, max(cpu) / 500 AS score "
        "FROM readings WHERE label = 1 GROUP BY 1, 2"
    ),
    "predictions": _select(_PREDICTION, "readings"),
    "verdicts": _select(VERDICT_EXPRS, "events", "WHERE event_id % 6 = 0"),
    "class_weights": (
        "SELECT event_id, label, anomaly_type, "
        + ", ".join(f"1 + (event_id * {17 + i}) % 97 AS w{i}" for i in range(len(CLASSES)))
        + " FROM readings"
    ),
    "class_probs": " UNION ALL ".join(
        f"SELECT event_id, label, anomaly_type, '{c}' AS cause, CAST(w{i} AS DOUBLE) / ("
        + " + ".join(f"w{j}" for j in range(len(CLASSES)))
        + ") AS p FROM class_weights"
        for i, c in enumerate(CLASSES)
    ),
    "volume": (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS timestamp, CAST(l_suppkey AS STRING) AS machine, "
        "n_name AS type, 'all' AS \"window\", l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, "
        "l_tax AS tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label "
        "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
    ),
    "split": (
        "SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', CAST(event_id AS STRING))), event_id) "
        "<= round(0.7 * count(*) OVER (PARTITION BY label)) AS is_train FROM windowed"
    ),
    "train": "SELECT * FROM split WHERE is_train",
    "test": "SELECT * FROM split WHERE NOT is_train",
}
NEEDS = {
    "windowed": ["readings"],
    "hour_anomalies": ["readings"],
    "day_anomalies": ["readings"],
    "predictions": ["readings"],
    "class_weights": ["readings"],
    "class_probs": ["class_weights"],
    "split": ["windowed"],
    "train": ["split"],
    "test": ["split"],
}


def with_views(sql: str, views: list[str] | tuple[str, ...]) -> str:
    """Prefix ``sql`` with the named views and what they need as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
