"""Splits and samples."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import query
from fleetpulse.operators import evaluate, sampling
from fleetpulse.plans import chunks
from fleetpulse.schemas import WEAK_CAUSES

_H = "md5(concat('42|', CAST(event_id AS STRING)))"


@query("stratified_split", "SELECT event_id, label, is_train FROM split", ["split"])
def stratified_split(spark, sf):
    return sampling.stratified_split(fx.readings(spark, sf)).select("event_id", "label", "is_train")


@query(
    "stratified_cap",
    f"""SELECT event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_H}, event_id) AS k,
count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM readings)
WHERE k <= CASE WHEN total <= 800 THEN n ELSE round(n * CAST(800 AS DOUBLE) / total) END""",
)
def stratified_cap(spark, sf):
    return sampling.stratified_cap(fx.readings(spark, sf), 800).select("event_id", "label")


@query("hash_sample", f"SELECT event_id, machine FROM readings ORDER BY {_H}, event_id LIMIT 700")
def hash_sample(spark, sf):
    return sampling.hash_sample(fx.readings(spark, sf), 700).select("event_id", "machine")


@query(
    "anomalies_and_normals",
    f"""SELECT event_id, label FROM readings WHERE label = 1
UNION ALL SELECT event_id, label FROM (SELECT * FROM readings WHERE label = 0 ORDER BY {_H}, event_id LIMIT 600)""",
)
def anomalies_and_normals(spark, sf):
    return sampling.anomalies_and_normals(fx.readings(spark, sf), 600).select("event_id", "label")


@query(
    "validation_halves",
    f"""SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {_H}, event_id) <= count(*) OVER () // 2 THEN 'val' ELSE 'hold' END AS half FROM readings""",
)
def validation_halves(spark, sf):
    return sampling.halves(fx.readings(spark, sf)).select("event_id", "half")


@query(
    "temporal_split",
    "SELECT event_id, row_number() OVER (ORDER BY timestamp, event_id) <= floor(0.7 * count(*) OVER ()) AS is_train FROM readings",
)
def temporal_split(spark, sf):
    return sampling.temporal_split(fx.readings(spark, sf)).select("event_id", "is_train")


_WEAK = "anomaly_type IN ('memory_leak', 'cascade')"


@query(
    "weighted_feedback_sample",
    f"""WITH a AS (SELECT event_id, anomaly_type, {_WEAK} AS weak FROM readings WHERE label = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY weak ORDER BY {_H}, event_id) AS k, count(*) OVER (PARTITION BY weak) AS n, CASE WHEN weak THEN 350 ELSE 150 END AS want FROM a),
c AS (SELECT *, want // n + CASE WHEN k <= want % n THEN 1 ELSE 0 END AS copies FROM k)
SELECT event_id, anomaly_type, CAST(g AS BIGINT) AS copy FROM c, range(1, 100001) r(g) WHERE g <= copies""",
)
def weighted_feedback_sample(spark, sf):
    """500 feedback rows, 70 % from weak causes, repeated evenly where a group is short."""
    anomalies = fx.readings(spark, sf).where("label = 1")
    out = sampling.weighted_feedback_sample(anomalies, 500, WEAK_CAUSES)
    return out.select("event_id", "anomaly_type", "copy")


@query(
    "demo_sample_per_type",
    f"""SELECT event_id, type FROM (SELECT event_id, type, {_H} AS h, row_number() OVER (PARTITION BY type ORDER BY {_H}, event_id) AS k FROM readings)
ORDER BY k, h, event_id LIMIT 40""",
)
def demo_sample_per_type(spark, sf):
    """Readings for a demonstration, every machine type among them."""
    return sampling.sample_per_type(fx.readings(spark, sf), 40).select("event_id", "type")


@query(
    "demo_sample_with_history",
    f"""WITH h AS (SELECT event_id, type, count(*) OVER (PARTITION BY machine ORDER BY timestamp, event_id ROWS 9 PRECEDING) AS n,
array_to_string(list(CAST(CAST(round(cpu * 100) AS BIGINT) AS VARCHAR)) OVER (PARTITION BY machine ORDER BY timestamp, event_id ROWS 9 PRECEDING), ',') AS cpu_history FROM readings),
f AS (SELECT * FROM h WHERE n = 10), s AS (SELECT *, {_H} AS h, row_number() OVER (PARTITION BY type ORDER BY {_H}, event_id) AS k FROM f)
SELECT event_id, type, cpu_history FROM s ORDER BY k, h, event_id LIMIT 20""",
)
def demo_sample_with_history(spark, sf):
    from fleetpulse.catalog.trends import _joined
    from fleetpulse.operators import rolling

    full = rolling.add_history(fx.readings(spark, sf), ("cpu",), full_only=True).where("history IS NOT NULL")
    out = sampling.sample_per_type(full, 20)
    return out.select("event_id", "type", _joined(F.col("history")["cpu"]).alias("cpu_history"))


@query(
    "known_and_unknown_machines",
    "SELECT event_id, machine IN (SELECT machine FROM readings WHERE label = 1) AS machine_known FROM readings",
)
def known_and_unknown_machines(spark, sf):
    df = fx.readings(spark, sf)
    known, unknown = sampling.split_known(df, df.where("label = 1"))
    mark = lambda d, v: d.select("event_id", F.lit(v).alias("machine_known"))
    return mark(known, True).unionByName(mark(unknown, False))


# Rows without a machine, type or label are groups of their own, whatever plan their number selects.
_HOLES = """holes AS (SELECT event_id, timestamp, cpu, CASE WHEN event_id % 4 = 0 THEN NULL ELSE machine END AS machine,
CASE WHEN event_id % 5 = 0 THEN NULL ELSE type END AS type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE label END AS label, label AS truth FROM readings)"""


def holes(spark, sf):
    return fx.readings(spark, sf).selectExpr(
        "event_id", "timestamp", "cpu", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE machine END AS machine",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE type END AS type", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE label END AS label", "label AS truth",
    )


_RANKS = f"WITH {_HOLES} SELECT event_id, machine, row_number() OVER (PARTITION BY machine ORDER BY cpu, event_id) AS k FROM holes"
_INDEX = f"WITH {_HOLES} SELECT event_id, machine, row_number() OVER (PARTITION BY machine ORDER BY timestamp, event_id) AS k FROM holes"


@query("rank_null_groups", _RANKS)
def rank_null_groups(spark, sf):
    return chunks.rank_within(holes(spark, sf), ["machine"], [F.col("cpu"), F.col("event_id")], "k").select("event_id", "machine", "k")


@query("rank_null_groups_sliced", _RANKS)
def rank_null_groups_sliced(spark, sf):
    """As above, with groups above 20 rows range-sorted."""
    ranked = chunks.rank_within(holes(spark, sf), ["machine"], [F.col("cpu"), F.col("event_id")], "k", chunk_rows=20)
    return ranked.select("event_id", "machine", "k")


@query("row_index_null_keys", _INDEX)
def row_index_null_keys(spark, sf):
    return chunks.row_index(holes(spark, sf), ["machine"], ["timestamp", "event_id"], "k").select("event_id", "machine", "k")


@query("row_index_null_keys_sliced", _INDEX)
def row_index_null_keys_sliced(spark, sf):
    """As above, with machines above 20 rows cut into slices."""
    indexed = chunks.row_index(holes(spark, sf), ["machine"], ["timestamp", "event_id"], "k", chunk_rows=20)
    return indexed.select("event_id", "machine", "k")


@query(
    "split_null_label",
    f"""WITH {_HOLES} SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY {_H}, event_id) <= round(0.7 * count(*) OVER (PARTITION BY label)) AS is_train FROM holes""",
)
def split_null_label(spark, sf):
    return sampling.stratified_split(holes(spark, sf)).select("event_id", "label", "is_train")


@query(
    "auc_null_groups",
    f"""WITH {_HOLES}, r AS (SELECT type, truth, rank() OVER (PARTITION BY type ORDER BY ram) + (count(*) OVER (PARTITION BY type, ram) - 1) / 2.0 AS r
FROM (SELECT h.*, ram FROM holes h JOIN readings USING (event_id)))
SELECT type, CAST(round((sum(r) FILTER (WHERE truth = 1) - count(*) FILTER (WHERE truth = 1) * (count(*) FILTER (WHERE truth = 1) + 1) / 2.0)
  / nullif(count(*) FILTER (WHERE truth = 1) * count(*) FILTER (WHERE truth = 0), 0), 6) AS DOUBLE) AS roc_auc FROM r GROUP BY type""",
)
def auc_null_groups(spark, sf):
    """Ranking quality per type, rows without a type among them."""
    scored = holes(spark, sf).join(fx.readings(spark, sf).select("event_id", "ram"), "event_id")
    return evaluate.roc_auc(scored, ["type"], "ram", "truth").select("type", F.round("roc_auc", 6).alias("roc_auc"))
