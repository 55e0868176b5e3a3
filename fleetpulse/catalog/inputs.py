"""Sources and sinks: data of the given tables is written in a source's format and read back through it."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import baseline_ctes, query, r6
from fleetpulse.catalog.streams import drained
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.operators import baselines as bl
from fleetpulse.operators import evaluate
from fleetpulse.plans.tables import materialize, new_path
from fleetpulse.schemas import METRICS, READING_SCHEMA
from fleetpulse.sources import documents, metrictext, store
from fleetpulse.sources import readings as src

_STATS = [f"{m}_{s}" for m in METRICS for s in ("mean", "std")]
_COLUMNS = ", ".join(f.name for f in READING_SCHEMA.fields if f.name != "anomaly_type")


@query("read_fleet_csv", f"SELECT {_COLUMNS}, nullif(anomaly_type, '') AS anomaly_type FROM readings")
def read_fleet_csv(spark, sf):
    """Readings as CSV files with a header, read with the fixed schema."""
    path = new_path(spark, "csv")
    fx.readings(spark, sf).select(*READING_SCHEMA.fieldNames()).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)
    return src.read_readings(spark, path).withColumn("anomaly_type", F.nullif("anomaly_type", F.lit("")))


@query("read_fleet_columns", "SELECT machine, cpu FROM readings")
def read_fleet_columns(spark, sf):
    """Two columns of the CSV files."""
    path = new_path(spark, "csv")
    fx.readings(spark, sf).select(*READING_SCHEMA.fieldNames()).write.option("header", True).csv(path)
    return src.read_readings(spark, path, ["machine", "cpu"])


_SHOWN = {0: "cpu", 1: "ram", 2: "network", **{i: f"col_{i}" for i in range(9, 64, 9)}}


def matrix_files(spark, sf):
    """Embeddings as headerless text, a file per label value and a label file beside it."""
    df, names = fx.matrix(spark, sf)
    df = df.join(fx.table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("machine-"), F.col("label").cast("string")).alias("name")), "vec_id")
    rows = materialize(df.withColumn("line", F.concat_ws(",", *[F.col(n).cast("string") for n in names])).select("vec_id", "name", "label", "line"), "matrix")
    data, labels = new_path(spark, "data"), new_path(spark, "labels")
    for r in rows.select("name").distinct().collect():  # ten files
        part = rows.where(F.col("name") == r["name"]).coalesce(1).sortWithinPartitions("vec_id")
        part.select("line").write.text(f"{data}/{r['name']}")
        part.select(F.col("label").cast("string").alias("value")).write.text(f"{labels}/{r['name']}")
    return data, labels, len(names)


@query(
    "read_matrix_files",
    f"""WITH m AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS line_no FROM embeddings)
SELECT CAST(label AS VARCHAR) AS machine, CASE WHEN label = 9 THEN 1 ELSE 0 END AS label, line_no, {', '.join(f'{r6(f"e[{i + 1}]")} AS {n}' for i, n in _SHOWN.items())} FROM m""",
    (),
)
def read_matrix_files(spark, sf):
    """Values and labels joined by line number, over many headerless files."""
    data, labels, width = matrix_files(spark, sf)
    df = src.read_matrix(spark, f"{data}/*", f"{labels}/*", width)
    return df.select("machine", "label", F.col("line_no").cast("bigint").alias("line_no"), *[R(n).alias(n) for n in _SHOWN.values()])


_OWN = """v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT label, i, var_samp(e[i]) AS s FROM v, range(1, 65) r(i) GROUP BY 1, 2),
k AS (SELECT label, i, row_number() OVER (PARTITION BY label ORDER BY s DESC, 'col_' || (i - 1)) AS rk FROM x)"""


@query(
    "read_matrix_top3",
    f"""WITH {_OWN}, c AS (SELECT label, list(i ORDER BY rk) AS top FROM k WHERE rk <= 3 GROUP BY label)
SELECT CAST(label AS VARCHAR) AS machine, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS line_no, {', '.join(f'{r6(f"e[top[{i + 1}]]")} AS {n}' for i, n in enumerate(('cpu', 'ram', 'network')))}
FROM v JOIN c USING (label)""",
    (),
)
def read_matrix_top3(spark, sf):
    """Each machine's own three metrics of largest variance."""
    data, labels, width = matrix_files(spark, sf)
    df = src.read_matrix(spark, f"{data}/*", f"{labels}/*", width, "top3", per_machine=True)
    return df.select("machine", F.col("line_no").cast("bigint").alias("line_no"), *[R(n).alias(n) for n in ("cpu", "ram", "network")])


@query(
    "read_graph_file",
    "SELECT machine, router, (SELECT count(DISTINCT router) FROM topology) AS n_routers FROM topology",
    ["topology"],
)
def read_graph_file(spark, sf):
    """The dependency graph as a JSON document of edges and routers, read back."""
    edges = fx.topology(spark, sf)
    document = edges.agg(
        F.map_from_entries(F.collect_list(F.struct("machine", "router"))).alias("depends_on"), F.array_sort(F.collect_set("router")).alias("routers")
    )
    path = new_path(spark, "graph")
    document.select(F.to_json(F.struct("depends_on", "routers"))).coalesce(1).write.text(path)
    found, routers = src.read_graph(spark, path)
    return found.withColumn("n_routers", F.lit(routers.count()).cast("bigint"))


_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, machine, type, timestamp AS ts, {m} AS value FROM readings" for m in METRICS)


@query("stream_metric_text", f"SELECT metric, machine, type, date_trunc('millisecond', ts) AS ts, {r6('value')} AS value FROM ({_LONG})")
def stream_metric_text(spark, sf):
    """Text snapshots of all metrics, a few files a trigger, with a restart from the checkpoint in between."""
    values = ", ".join(f"struct('{m}' AS metric, {m} AS value)" for m in METRICS)
    feed = fx.readings(spark, sf).selectExpr("machine", "type", "CAST(timestamp AS TIMESTAMP) AS ts", f"inline(array({values}))")
    lines = materialize(metrictext.as_lines(feed).withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2))), "lines")
    path, out, offsets = new_path(spark, "snapshots"), new_path(spark, "stream"), new_path(spark, "offsets")
    for half in range(2):
        lines.where(F.col("half") == half).select("value").repartition(3).write.mode("append").text(path)
        drained(spark, metrictext.metric_text_feed(spark, path, 2), out=out, offsets=offsets)
    return spark.read.parquet(out).withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "value": R("value")})


@query(
    "saved_runs",
    f"""WITH c AS (SELECT type, CAST(cpu > 100 AS INT) AS pred, label FROM readings), m AS (SELECT type, sum(pred * label) AS tp, sum(pred) AS flagged, sum(label) AS positives FROM c GROUP BY type)
SELECT type AS run_id, {r6('(CASE WHEN flagged = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / flagged END)')} AS "precision",
{r6('(CASE WHEN positives = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / positives END)')} AS recall, 'cpu' AS feature, '100' AS "limit" FROM m""",
)
def saved_runs(spark, sf):
    """One run per machine type, appended to the table of runs and read back."""
    flagged = fx.readings(spark, sf).withColumn("pred", (F.col("cpu") > 100).cast("int"))
    quality = evaluate.with_prf(evaluate.confusion(flagged, ["type"])).collect()  # one row per type
    path = new_path(spark, "runs")
    for r in quality:
        store.save_run(spark, path, r["type"], "cpu_limit", "events", {"limit": 100}, ["cpu"], {"precision": r["precision"], "recall": r["recall"]})
    runs = store.read_runs(spark, path)
    measure = lambda m: R(F.col("metrics")[m]).alias(m)
    return runs.select("run_id", measure("precision"), measure("recall"), F.col("features")[0].alias("feature"), F.col("params")["limit"].alias("limit"))


_LEVELS = " UNION ALL ".join(
    f"SELECT '{level}' AS level, {machine} AS machine, {kind} AS type, {window} AS \"window\", {', '.join(f'{r6(c)} AS {c}' for c in _STATS)} FROM {source}"
    for level, machine, kind, window, source in (
        ("machine+window", "machine", "NULL", '"window"', "b_mw"),
        ("machine", "machine", "NULL", "NULL", "b_m"),
        ("type", "NULL", "type", "NULL", "b_t"),
        ("global", "NULL", "NULL", "NULL", "b_g"),
    )
)


@query("read_baseline_document", f"WITH {baseline_ctes('windowed', METRICS)} {_LEVELS}", ["windowed"])
def read_baseline_document(spark, sf):
    """Baselines written as one keyed document and read back."""
    readings = fx.windowed(spark, sf)
    path = new_path(spark, "document")
    text = documents.baseline_document(bl.build_baselines(readings, METRICS), bl.known_machines(readings), METRICS)
    text.coalesce(1).write.text(path)
    rows, _, order = documents.read_baseline_document(spark, path)
    return rows.select("level", "machine", "type", "window", *[R(f"{m}_{s}").alias(f"{m}_{s}") for m in order for s in ("mean", "std")])
