"""Decisions from class probabilities and detector votes."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import query, r6
from fleetpulse.functions import decisions as dec
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.schemas import SAFETY_NET_CAUSE

PER_CLASS = {"cpu_spike": 0.3, "memory_leak": 0.25, "network_flood": 0.2, "disk_saturation": 0.35, "silent_failure": 0.4}

_ORDER = sorted(range(1, len(fx.CLASSES)), key=lambda i: fx.CLASSES[i])
_TOP = f"greatest({', '.join(f'w{i}' for i in _ORDER)})"
_LIKELIEST = "CASE " + " ".join(f"WHEN w{i} = {_TOP} THEN '{fx.CLASSES[i]}'" for i in _ORDER) + " END"
_TOTAL = " + ".join(f"w{i}" for i in range(len(fx.CLASSES)))
_SINGLE = f"""one AS (SELECT event_id, label, CASE WHEN CAST(w0 AS DOUBLE) / ({_TOTAL}) < {{t}} THEN 1 ELSE 0 END AS clf_is_anomaly,
CASE WHEN CAST(w0 AS DOUBLE) / ({_TOTAL}) < {{t}} THEN {_LIKELIEST} ELSE 'normal' END AS clf_cause FROM class_weights)"""


@query(
    "decide_single_threshold",
    f"WITH {_SINGLE.format(t='CAST(0.15 AS DOUBLE)')} SELECT event_id, clf_is_anomaly, clf_cause FROM one",
    ["class_weights"],
)
def decide_single_threshold(spark, sf):
    return dec.decide(fx.class_probs(spark, sf), threshold=0.15).select("event_id", "clf_is_anomaly", "clf_cause")


_BARS = "thr AS (" + " UNION ALL ".join(f"SELECT '{c}' AS cause, CAST({t} AS DOUBLE) AS t" for c, t in PER_CLASS.items()) + ")"
_PER = f"""{_BARS}, ov AS (SELECT event_id, c.cause, row_number() OVER (PARTITION BY event_id ORDER BY p - coalesce(t, CAST(1.01 AS DOUBLE)) DESC, c.cause) AS k
FROM class_probs c LEFT JOIN thr ON thr.cause = c.cause WHERE c.cause <> 'normal' AND p >= coalesce(t, CAST(1.01 AS DOUBLE)))"""


@query(
    "decide_per_class",
    f"""WITH {_PER} SELECT r.event_id, CASE WHEN ov.cause IS NULL THEN 0 ELSE 1 END AS clf_is_anomaly, coalesce(ov.cause, 'normal') AS clf_cause
FROM readings r LEFT JOIN ov ON ov.event_id = r.event_id AND k = 1""",
    ["readings", "class_probs"],
)
def decide_per_class(spark, sf):
    """A class without a threshold never fires."""
    return dec.decide(fx.class_probs(spark, sf), per_class=PER_CLASS).select("event_id", "clf_is_anomaly", "clf_cause")


@query(
    "probability_margins",
    f"""WITH {_BARS} SELECT c.event_id, c.cause, {r6('(p - coalesce(t, CAST(1.01 AS DOUBLE)))')} AS margin FROM class_probs c LEFT JOIN thr ON thr.cause = c.cause
WHERE c.cause <> 'normal' AND p >= coalesce(t, CAST(1.01 AS DOUBLE))""",
    ["class_probs"],
)
def probability_margins(spark, sf):
    """Class probabilities joined to per-class thresholds."""
    long = fx.class_probs(spark, sf).select("event_id", F.inline("probs")).where("cause <> 'normal'")
    bars = F.broadcast(spark.createDataFrame(list(PER_CLASS.items()), "cause string, t double"))  # one row per class
    margin = F.col("p") - F.coalesce("t", F.lit(dec.NEVER))
    return long.join(bars, "cause", "left").where(margin >= 0).select("event_id", "cause", R(margin).alias("margin"))


_GATE = f"""WITH {_SINGLE.format(t='CAST(0.1 AS DOUBLE)')}, v AS (SELECT *, label AS iso FROM one)"""


@query(
    "or_gate",
    f"""{_GATE} SELECT event_id, greatest(clf_is_anomaly, iso) AS is_anomaly, CASE WHEN clf_is_anomaly = 1 THEN clf_cause WHEN iso = 1 THEN '{SAFETY_NET_CAUSE}' END AS likely_cause FROM v""",
    ["class_weights"],
)
def or_gate(spark, sf):
    df = dec.decide(fx.class_probs(spark, sf), threshold=0.1)
    votes = df.withColumn("iso_is_anomaly", (F.col("label") == 1).cast("int"))
    return dec.or_gate(votes).select("event_id", "is_anomaly", "likely_cause")


@query(
    "blind_ensemble",
    "SELECT event_id, greatest(CASE WHEN cpu > 100 THEN 1 ELSE 0 END, CASE WHEN ram > 90 THEN 1 ELSE 0 END) AS pred FROM readings",
)
def blind_ensemble(spark, sf):
    a, b = (F.col("cpu") > 100).cast("int"), (F.col("ram") > 90).cast("int")
    return fx.readings(spark, sf).select("event_id", dec.either(a, b).alias("pred"))


@query(
    "hybrid_routing",
    """WITH h AS (SELECT event_id, count(*) OVER (PARTITION BY machine ORDER BY timestamp, event_id ROWS 9 PRECEDING) AS n FROM readings)
SELECT CASE WHEN n = 10 AND event_id % 5 <> 0 THEN 'with_trends' ELSE 'plain' END AS route, count(*) AS n FROM h GROUP BY 1""",
)
def hybrid_routing(spark, sf):
    """Readings with a full valid history take the 15-feature model, the rest the 6-feature one."""
    from fleetpulse.operators import rolling
    from fleetpulse.schemas import ROLLING_METRICS

    df = rolling.add_history(fx.readings(spark, sf), full_only=True)
    df = df.withColumn("history", F.when(F.col("event_id") % 5 != 0, F.col("history")))
    routed = dec.rolling_from_history(df, ROLLING_METRICS).select(
        F.when(F.col("history_ok"), "with_trends").otherwise("plain").alias("route")
    )
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
