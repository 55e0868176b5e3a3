"""Scoring with saved models whose trees follow from their numbers, so that SQL can walk them too."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import LEVEL_SQL, baseline_ctes, fallback_join, query, r6, z_sql
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.operators import baselines as bl
from fleetpulse.operators import rolling, serving
from fleetpulse.operators.boosting import SoftmaxBoosting
from fleetpulse.operators.iforest import NODE_SCHEMA, IsolationForest, expected_path
from fleetpulse.plans.tables import materialize, new_path
from fleetpulse.schemas import METRICS, ROLLING_METRICS, SAFETY_NET_CAUSE

CAUSES = sorted(c for c in fx.CLASSES if c != "cascade")
TREES, ROUNDS, SAMPLES = 12, 3, 256
THRESHOLD, ISO_THRESHOLD = 0.12, 0.74
PER_CLASS = {"cpu_spike": 0.24, "memory_leak": 0.26, "network_flood": 0.3, "disk_saturation": 0.28}
SPLITS = range(7)  # a tree has 7 inner nodes and 8 leaves, numbered like a heap

# One rule per quantity, valid in Python and in SQL: t is the tree, j the node.
ISO_FEATURE, ISO_CUT, ISO_PATH = "(t + j) % 6", "((t * 7 + j * 13) % 11 - 5) / 4.0", "(t * 5 + j * 3) % 7 + 1.0"
CUT, LEAF = "((t * 3 + j * 5) % 9 - 4) / 3.0 + 0.05", "((t * 11 + j * 7) % 13 - 6) / 8.0"


def value(rule: str, t: int, j: int) -> float:
    return eval(rule, {}, {"t": t, "j": j})  # noqa: S307 - the rules above


def heap_rows(t: int, feature: str, cut, leaf: str) -> list[tuple]:
    inner = [(j, int(value(feature, t, j)), float(cut(t, j)), 2 * j + 1, 2 * j + 2, 0.0) for j in SPLITS]
    return inner + [(j, -1, 0.0, j, j, float(value(leaf, t, j))) for j in range(7, 15)]


def ruled_forest(spark) -> IsolationForest:
    rows = [(t, *r) for t in range(TREES) for r in heap_rows(t, ISO_FEATURE, lambda t, j: value(ISO_CUT, t, j), ISO_PATH)]
    return IsolationForest(spark.createDataFrame(rows, NODE_SCHEMA), [f"z_{m}" for m in METRICS], TREES, SAMPLES)


def ruled_boosting(features: list[str]) -> SoftmaxBoosting:
    """Cuts of rolling features are 25 times as far out as those of z-scores."""
    feature = f"(t * 5 + j) % {len(features)}"
    cut = lambda t, j: value(CUT, t, j) * (25.0 if value(feature, t, j) >= 6 else 1.0)
    rows = [(k, r, *n) for k in range(len(CAUSES)) for r in range(ROUNDS) for n in heap_rows(r * len(CAUSES) + k, feature, cut, LEAF)]
    return SoftmaxBoosting(rows, CAUSES, features)


def saved_bundle(spark, sf, version="v4"):
    """A bundle written and loaded again: baselines of all readings, trees by rule."""
    readings = fx.windowed(spark, sf)
    z = [f"z_{m}" for m in METRICS]
    made = serving.Bundle(
        version, list(METRICS), bl.build_baselines(readings, METRICS), bl.known_machines(readings), ruled_forest(spark), ISO_THRESHOLD,
        ruled_boosting(z), ruled_boosting(z + rolling.rolling_names(ROLLING_METRICS)), THRESHOLD, PER_CLASS,
    )
    root = new_path(spark, "bundles")
    made.save(root)
    return serving.Bundle.load(spark, root, version)


def asked(spark, sf):
    """Readings as requests: some without type, window or a full history."""
    rows = rolling.add_history(fx.windowed(spark, sf), full_only=True)
    odd = {"history": F.when(F.col("event_id") % 5 != 0, F.col("history")), "window": F.when(F.col("event_id") % 11 != 0, F.col("window"))}
    return rows.withColumns({**odd, "type": F.when(F.col("event_id") % 7 != 0, F.col("type"))})


def at_sql(rule: str, j: str) -> str:
    return f"({rule.replace('j', j).replace('t', 'tree')})"


def walk_sql(source: str, x: str, trees: int, feature: str, cut, leaf: str) -> str:
    """Three steps down every tree for every row of ``source``: (event_id, tree, leaf)."""
    step = lambda j: f"2 * {j} + CASE WHEN {x}[CAST({at_sql(feature, j)} AS INT) + 1] <= {cut(j)} THEN 1 ELSE 2 END"
    first = f"SELECT event_id, {x}, tree, {step('0')} AS a1 FROM {source}, range({trees}) r(tree)"
    third = f"SELECT *, {step('a2')} AS a3 FROM (SELECT *, {step('a1')} AS a2 FROM ({first}))"
    return f"(SELECT event_id, tree, {at_sql(leaf, 'a3')} AS leaf FROM ({third}))"


def boosted_sql(x: str, features: int) -> str:
    feature = f"(t * 5 + j) % {features}"
    cut = lambda j: f"{at_sql(CUT, j)} * CASE WHEN {at_sql(feature, j)} >= 6 THEN 25.0 ELSE 1.0 END"
    return walk_sql("s", x, len(CAUSES) * ROUNDS, feature, cut, LEAF)


_Z = [z_sql(m) for m in METRICS]
_CAUSE = "CASE tree % " + str(len(CAUSES)) + " " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CAUSES)) + " END"
_TREND = ", ".join(
    f"avg({m}) OVER h, coalesce(stddev_samp({m}) OVER h, 0.0), coalesce({m} - lag({m}, 9) OVER (PARTITION BY machine ORDER BY timestamp, event_id), 0.0)" for m in ROLLING_METRICS
)
_BARS = "CASE cause " + " ".join(f"WHEN '{c}' THEN CAST({t} AS DOUBLE)" for c, t in PER_CLASS.items()) + " ELSE CAST(1.01 AS DOUBLE) END"


FOREST_SQL = walk_sql("s", "z", TREES, ISO_FEATURE, lambda j: at_sql(ISO_CUT, j), ISO_PATH)


def probs_sql(name: str, x: str, features: int) -> str:
    return f"""{name}_m AS (SELECT event_id, {_CAUSE} AS cause, sum(leaf) AS m FROM {boosted_sql(x, features)} GROUP BY 1, 2),
{name}_e AS (SELECT event_id, cause, exp(m - max(m) OVER (PARTITION BY event_id)) AS e FROM {name}_m),
{name} AS (SELECT event_id, cause, e / sum(e) OVER (PARTITION BY event_id) AS p FROM {name}_e),
{name}_n AS (SELECT event_id, p AS p_normal FROM {name} WHERE cause = 'normal'),
{name}_o AS (SELECT event_id, cause AS best FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, cause) AS k FROM {name} WHERE cause <> 'normal') WHERE k = 1)"""


LIKELY_SQL = f"CASE WHEN clf_cause <> 'normal' THEN clf_cause WHEN iso_score > {ISO_THRESHOLD} THEN '{SAFETY_NET_CAUSE}' END"
ANOMALY_SQL = f"(clf_cause <> 'normal' OR iso_score > {ISO_THRESHOLD})"


def served_sql(source: str) -> str:
    """CTEs up to ``v``, the decision on each row of ``q`` (readings with ``roll``, its rolling features, and ``rolled``), which ``source`` defines."""
    return f"""WITH {baseline_ctes('windowed', METRICS)}, {source},
s AS (SELECT r.event_id, r.rolled, {LEVEL_SQL} AS baseline_used, [{', '.join(_Z)}] AS z, list_concat([{', '.join(_Z)}], r.roll) AS x FROM {fallback_join('q')}),
i AS (SELECT event_id, pow(2, -avg(leaf) / {float(expected_path(SAMPLES))!r}) AS iso_score FROM {FOREST_SQL} GROUP BY event_id),
{probs_sql('plain', 'z', 6)},
{probs_sql('rich', 'x', 6 + 3 * len(ROLLING_METRICS))},
over_bar AS (SELECT event_id, cause AS best FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p - {_BARS} DESC, cause) AS k FROM rich WHERE cause <> 'normal' AND p >= {_BARS}) WHERE k = 1),
v AS (SELECT s.event_id, s.baseline_used, s.rolled, i.iso_score, CASE WHEN s.rolled THEN rn.p_normal ELSE pn.p_normal END AS p_normal,
CASE WHEN s.rolled THEN coalesce(b.best, 'normal') WHEN pn.p_normal < {THRESHOLD} THEN po.best ELSE 'normal' END AS clf_cause
FROM s JOIN i USING (event_id) JOIN plain_n pn USING (event_id) JOIN plain_o po USING (event_id) JOIN rich_n rn USING (event_id) LEFT JOIN over_bar b USING (event_id))"""


_ASKED = f"""q AS (SELECT * REPLACE (CASE WHEN event_id % 11 <> 0 THEN "window" END AS "window"), [{_TREND}] AS roll, count(*) OVER h = 10 AND event_id % 5 <> 0 AS rolled
FROM windowed WINDOW h AS (PARTITION BY machine ORDER BY timestamp, event_id ROWS 9 PRECEDING))"""
_SCORED = f"""{served_sql(_ASKED)}
SELECT event_id, baseline_used, rolled AS rolling_features_used, {r6('p_normal')} AS p_normal, clf_cause, {r6('iso_score')} AS iso_score, CASE WHEN iso_score > {ISO_THRESHOLD} THEN 1 ELSE 0 END AS iso_is_anomaly,
CASE WHEN {ANOMALY_SQL} THEN 1 ELSE 0 END AS is_anomaly, {LIKELY_SQL} AS likely_cause FROM v"""


@query("score_saved_models", _SCORED, ["windowed"])
def score_saved_models(spark, sf):
    """Every reading against a saved bundle: fallback baselines, both classifiers, isolation forest, OR gate."""
    out = serving.score(asked(spark, sf), saved_bundle(spark, sf))
    kept = ["event_id", "baseline_used", "rolling_features_used", "clf_cause", "iso_is_anomaly", "is_anomaly", "likely_cause"]
    return out.select(*kept, R("p_normal").alias("p_normal"), R("iso_score").alias("iso_score"))


@query(
    "forest_walk",
    f"""WITH {baseline_ctes('windowed', METRICS)}, s AS (SELECT r.event_id, [{', '.join(_Z)}] AS z FROM {fallback_join('windowed')})
SELECT event_id, {r6(f'pow(2, -avg(leaf) / {float(expected_path(SAMPLES))!r})')} AS iso_score FROM {FOREST_SQL} GROUP BY event_id""",
    ["windowed"],
)
def forest_walk(spark, sf):
    """Isolation scores of a fixed forest over all z-scored readings."""
    from fleetpulse.operators.zscore import zscore

    readings = fx.windowed(spark, sf)
    scored = zscore(readings, bl.build_baselines(readings, METRICS), METRICS)
    return ruled_forest(spark).score(scored).select("event_id", R("iso_score").alias("iso_score"))


@query("boosted_causes")
def boosted_causes(spark, sf):
    """Softmax boosting fitted on all z-scored readings: mean probability of every cause by true cause."""
    from fleetpulse.functions.decisions import normalise_cause
    from fleetpulse.operators.zscore import zscore

    readings = fx.windowed(spark, sf)
    z = [f"z_{m}" for m in METRICS]
    scored = zscore(readings, bl.build_baselines(readings, METRICS), METRICS).withColumn("cause", normalise_cause(F.col("anomaly_type"), True))
    scored = materialize(scored.select("event_id", "cause", *z), "zscores")
    model = SoftmaxBoosting.fit(scored, z, rounds=4, depth=4, bins=32)
    long = model.probabilities(scored).select(F.col("cause").alias("true_cause"), F.inline("probs"))
    return long.groupBy("true_cause", "cause").agg(R(F.avg("p")).alias("mean_p"), F.count(F.lit(1)).alias("n"))
