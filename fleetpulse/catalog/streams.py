"""Streaming queries: each drains the events through a stream into a table and returns the table."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import baseline_ctes, fallback_join, query, r6, z_sql
from fleetpulse.catalog.serving import ANOMALY_SQL, LIKELY_SQL, saved_bundle, served_sql
from fleetpulse.catalog.trends import _ROLL
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.operators import baselines as bl
from fleetpulse.operators import rolling
from fleetpulse.plans.tables import materialize, new_path
from fleetpulse.schemas import METRIC_FEED_SCHEMA, METRICS
from fleetpulse.sources.store import read_predictions
from fleetpulse.streaming import cycle, history, online, ticks, windows


def stream(spark, sf):
    """Readings as a stream with an event time."""
    events = fx.table(spark, sf, "events")
    source = windows.stream_parquet(spark, f"{sf}/events.parque[t]", events.schema)
    return windows.with_event_time(source.selectExpr(*fx.READING_EXPRS))


def drained(spark, df, mode="append", out=None, offsets=None):
    out = out or new_path(spark, "stream")
    windows.run_available(df, out, offsets or new_path(spark, "offsets"), mode)
    return spark.read.schema(df.schema).parquet(out)


def naive(*names):
    """Back to zone-free timestamps."""
    return {n: F.col(n).cast("timestamp_ntz") for n in names}


# A window is out once the watermark (newest event minus the delay) has passed its end.
_DONE = "window_end <= (SELECT max(timestamp) FROM readings) - INTERVAL 1 MINUTE"


@query(
    "stream_tumbling",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 30 SECOND, timestamp) AS window_start, avg(cpu) AS c, avg(network) AS nw, avg(load_avg) AS l, count(*) AS n FROM readings GROUP BY 1),
e AS (SELECT *, window_start + INTERVAL 30 SECOND AS window_end FROM w)
SELECT window_start, window_end, {r6('c')} AS avg_cpu, {r6('nw')} AS avg_network, {r6('l')} AS avg_load_avg, n FROM e WHERE {_DONE}""",
)
def stream_tumbling(spark, sf):
    out = drained(spark, windows.tumbling(stream(spark, sf), ("cpu", "network", "load_avg")))
    rounded = {c: R(c) for c in ("avg_cpu", "avg_network", "avg_load_avg")}
    return out.withColumns({**naive("window_start", "window_end"), **rounded})


@query(
    "stream_sliding",
    f"""WITH s AS (SELECT *, time_bucket(INTERVAL 30 SECOND, timestamp) AS b FROM readings),
x AS (SELECT b - to_seconds(CAST(30 * k AS BIGINT)) AS window_start, type, cpu FROM s, range(10) r(k)),
w AS (SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, type, avg(cpu) AS c, count(*) AS n FROM x GROUP BY 1, 2, 3)
SELECT window_start, window_end, type, {r6('c')} AS avg_cpu, n FROM w WHERE {_DONE}""",
)
def stream_sliding(spark, sf):
    out = drained(spark, windows.sliding(stream(spark, sf), ("cpu",), by=("type",)))
    return out.withColumns({**naive("window_start", "window_end"), "avg_cpu": R("avg_cpu")})


@query(
    "stream_incidents",
    """WITH a AS (SELECT machine, timestamp FROM readings WHERE cpu > 60),
g AS (SELECT *, CASE WHEN timestamp < lag(timestamp) OVER (PARTITION BY machine ORDER BY timestamp) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM a),
n AS (SELECT *, sum(new) OVER (PARTITION BY machine ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS i FROM g),
s AS (SELECT machine, i, min(timestamp) AS started, max(timestamp) + INTERVAL 12 HOUR AS closes, count(*) AS n FROM n GROUP BY 1, 2)
SELECT machine, started, closes, n FROM s WHERE closes <= (SELECT max(timestamp) FROM a) - INTERVAL 1 MINUTE""",
)
def stream_incidents(spark, sf):
    """Session windows per machine; a session is out once the watermark has passed its close."""
    out = drained(spark, windows.incident_sessions(stream(spark, sf).where("cpu > 60"), "12 hours"))
    return out.withColumns(naive("started", "closes")).select("machine", "started", "closes", "n")


@query("stream_deduplicated", "SELECT event_id, machine, cpu FROM readings")
def stream_deduplicated(spark, sf):
    """Every reading is delivered twice; the repeats are dropped."""
    twice = stream(spark, sf).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    once = windows.dedupe(twice, ("machine", "event_time"), "1 hour")
    return drained(spark, once.select("event_id", "machine", "cpu"))


@query("stream_rolling", f"SELECT event_id, machine, {_ROLL} FROM readings")
def stream_rolling(spark, sf):
    """Stateful history; equals the batch rolling features."""
    with history.rocksdb_state(spark):
        out = drained(spark, history.rolling_stream(stream(spark, sf)))
    return out.select("event_id", "machine", *[R(n).alias(n) for n in rolling.rolling_names()])


_CUT = "(SELECT min(timestamp) + (max(timestamp) - min(timestamp)) / 2 FROM readings)"


@query("stream_rolling_seeded", f"SELECT * FROM (SELECT event_id, machine, timestamp, {_ROLL} FROM readings) WHERE timestamp >= {_CUT}".replace("SELECT *", "SELECT * EXCLUDE (timestamp)"))
def stream_rolling_seeded(spark, sf):
    """The later half of the readings as a stream whose state starts from the stored earlier half."""
    events = fx.readings(spark, sf)
    first, last = events.agg(F.min("timestamp").cast("timestamp").cast("double"), F.max("timestamp").cast("timestamp").cast("double")).first()
    later = F.col("event_time").cast("double") >= F.lit(first + (last - first) / 2)
    stored = materialize(windows.with_event_time(events).where(~later), "stored")
    with history.rocksdb_state(spark):
        out = drained(spark, history.rolling_stream(stream(spark, sf).where(later), stored=stored))
    return out.select("event_id", "machine", *[R(n).alias(n) for n in rolling.rolling_names()])


PARTS = 7  # micro-batches of the online baselines, enough for two merged files
_STATS = ", ".join(f"{r6(f'{m}_{s}')} AS {m}_{s}" for m in METRICS for s in ("mean", "std"))


@query("stream_online_baselines", f'WITH {baseline_ctes("windowed", METRICS)} SELECT machine, "window", n, {_STATS} FROM b_mw', ["windowed"])
def stream_online_baselines(spark, sf):
    """Moments of every micro-batch, merged into current baselines."""
    root, path = new_path(spark, "moments"), new_path(spark, "parts")
    parts = materialize(fx.readings(spark, sf).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(PARTS))), "dealt")
    for i in range(PARTS):
        parts.where(F.col("part") == i).coalesce(1).write.mode("append").parquet(path)
    query_ = (
        windows.stream_parquet(spark, path, parts.schema, 1)
        .writeStream.foreachBatch(online.update_body(root, METRICS, fan=3))
        .option("checkpointLocation", new_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    out = online.current_baselines(spark, root, METRICS)
    return out.select("machine", "window", "n", *[R(f"{m}_{s}").alias(f"{m}_{s}") for m in METRICS for s in ("mean", "std")])


FEED = METRICS
# The feed rounds to two decimals; load_avg has four, whose ties round alike as decimal numbers.
_ROUNDED = "CAST(round(CAST(load_avg AS DECIMAL(18, 6)), 2) AS DOUBLE) AS load_avg"
SLICES = 4
FILE_ROWS = 1_000_000
SURE_ROWS = 10_000  # a file's share of a slice that no dealing in turns leaves empty
DELAYED = 40  # seconds by which some values come in the slice after their own


def sliced_feed(spark, sf):
    """Long metric values as a stream of four micro-batches whose borders cut ticks in two.

    Values of ``load_avg`` that fall into the last seconds of a slice come with the next one.
    """
    values = ", ".join(f"struct('{m}' AS metric, {m} AS value)" for m in FEED)
    feed = fx.readings(spark, sf).selectExpr("machine", "type", "CAST(timestamp AS TIMESTAMP) AS ts", f"inline(array({values}))")
    first, last = feed.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    width = (last - first) / SLICES
    seconds = F.col("ts").cast("double") - F.lit(first) + F.when(F.col("metric") == "load_avg", F.lit(float(DELAYED))).otherwise(F.lit(0.0))
    number = F.least(F.floor(seconds / F.lit(width)).cast("int"), F.lit(SLICES - 1))
    written = materialize(feed.withColumn("slice", number), "feed")
    path, files = new_path(spark, "slices"), slice_files(written)
    for i in range(SLICES):
        part = written.where(F.col("slice") == i).select(METRIC_FEED_SCHEMA.fieldNames())
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return cycle.metric_feed(spark, path, files)


def slice_files(written):
    """Files of every slice, all of which make one micro-batch: one per ``FILE_ROWS`` values, each sure to hold some."""
    rows = {r["slice"]: r["count"] for r in written.groupBy("slice").count().collect()}  # one row per slice
    least = min(rows.get(i, 0) for i in range(SLICES))
    return max(1, min(-(-max(rows.values(), default=0) // FILE_ROWS), least // SURE_ROWS))


def run_cycle(spark, sf, model, with_log=False, twice=False):
    """Published rows and log of a cycle; ``twice`` runs a second cycle on the same paths from the start."""
    edges = materialize(fx.topology(spark, sf), "edges")
    out, log = new_path(spark, "published"), new_path(spark, "log")
    feed = sliced_feed(spark, sf)
    for _ in range(1 + twice):
        body = cycle.detection_cycle(model, edges, out, log if with_log else None, metrics=FEED)
        with history.rocksdb_state(spark):  # a slice's ticks wait on disk, not in the executors' memory
            cycle.run_cycle(feed, body, new_path(spark, "offsets"), metrics=FEED).awaitTermination()
    return out, log


_WHOLE = f"""k AS (SELECT * REPLACE ({_ROUNDED}), time_bucket(INTERVAL 30 SECOND, timestamp) AS tick FROM windowed),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine, tick ORDER BY timestamp DESC) AS rn FROM k)
WHERE rn = 1 AND tick + INTERVAL 30 SECOND <= (SELECT max(timestamp) FROM k) - INTERVAL 1 MINUTE)"""
_TICKS = f"""{baseline_ctes('windowed', FEED)}, {_WHOLE},
z AS (SELECT r.tick, r.machine, r.type, r."window", greatest({', '.join(f'abs({z_sql(m)})' for m in FEED)}) AS score FROM {fallback_join('l')})"""
_ROLES = f"""c AS (SELECT tick, count(*) AS n FROM a GROUP BY tick),
d AS (SELECT x.tick, t.router AS machine, count(*) AS down FROM a x JOIN topology t ON t.machine = x.machine JOIN a y ON y.tick = x.tick AND y.machine = t.router GROUP BY 1, 2)
SELECT a.tick, a.machine, a.type, {r6('a.score')} AS score, a.likely_cause, CASE WHEN c.n = 1 THEN 'isolated' WHEN d.down > 0 THEN 'likely_root_cause' WHEN a.machine IN (SELECT router FROM topology) THEN 'isolated'
WHEN u.machine IS NOT NULL THEN 'downstream_effect' ELSE 'isolated' END AS role, c.n AS n_anomalous
FROM a JOIN c ON c.tick = a.tick LEFT JOIN d ON d.tick = a.tick AND d.machine = a.machine LEFT JOIN topology t ON t.machine = a.machine LEFT JOIN a u ON u.tick = a.tick AND u.machine = t.router"""


def published(spark, out):
    rows = cycle.read_published(spark, out).withColumns({**naive("tick"), "score": R("score")})
    return rows.select("tick", "machine", "type", "score", "likely_cause", "role", "n_anomalous")


@query(
    "stream_ticks",
    f"""WITH {_WHOLE} SELECT tick, machine, type, {', '.join(FEED)} FROM l""",
    ["windowed"],
)
def stream_ticks(spark, sf):
    """Ticks split over four micro-batches, put together again."""
    with history.rocksdb_state(spark):  # a slice's ticks wait on disk, not in the executors' memory
        out = drained(spark, ticks.assemble_ticks(sliced_feed(spark, sf), FEED))
    return out.where("whole").withColumns(naive("tick")).select("tick", "machine", "type", *FEED)


@query(
    "stream_detection_cycle",
    f"WITH {_TICKS}, a AS (SELECT *, CAST(NULL AS VARCHAR) AS likely_cause FROM z WHERE score > 3), {_ROLES}",
    ("windowed", "topology"),
)
def stream_detection_cycle(spark, sf):
    """Long metric feed to scored ticks with root-cause roles."""
    return published(spark, run_cycle(spark, sf, bl.build_baselines(fx.windowed(spark, sf), FEED))[0])


@query(
    "stream_served_cycle",
    f"""{served_sql(_WHOLE + ', q AS (SELECT *, false AS rolled, CAST([] AS DOUBLE[]) AS roll, machine || tick AS event_id FROM (SELECT * EXCLUDE (event_id) FROM l))')},
a AS (SELECT q.tick, q.machine, q.type, round(iso_score, 4) AS score, {LIKELY_SQL} AS likely_cause FROM v JOIN q USING (event_id) WHERE {ANOMALY_SQL}), {_ROLES}""",
    ("windowed", "topology"),
)
def stream_served_cycle(spark, sf):
    """The cycle with a saved bundle: classifier, isolation forest and OR gate."""
    return published(spark, run_cycle(spark, sf, saved_bundle(spark, sf))[0])


@query(
    "stream_prediction_log",
    f"""WITH {_TICKS} SELECT machine, "window" AS time_window, CAST(tick AS DATE) AS day, 2 * count(*) AS n, CAST(2 * sum(CASE WHEN score > 3 THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM z GROUP BY 1, 2, 3""",
    ["windowed"],
)
def stream_prediction_log(spark, sf):
    """The prediction log of two cycles on one path, summed up by machine, window and day of the tick."""
    _, log = run_cycle(spark, sf, bl.build_baselines(fx.windowed(spark, sf), FEED), with_log=True, twice=True)
    rows = read_predictions(spark, log)
    return rows.groupBy("machine", "time_window", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("final_is_anomaly").cast("bigint")).alias("flagged")
    )
