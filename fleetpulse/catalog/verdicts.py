"""Prediction log, verdicts, guardrail and runs."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.quality import SCORED, scored
from fleetpulse.catalog.registry import query, r6, safe
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.operators import evaluate
from fleetpulse.operators import feedback as fb
from fleetpulse.schemas import METRICS

P = ("predictions",)


@query(
    "verdict_stats",
    "SELECT coalesce(operator_verdict, '_pending') AS verdict, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM predictions GROUP BY 1",
    P,
)
def verdict_stats(spark, sf):
    return fb.verdict_stats(fx.predictions(spark, sf))


@query(
    "recent_predictions",
    "SELECT id, timestamp, machine, final_is_anomaly FROM predictions ORDER BY timestamp DESC, id DESC LIMIT 1000",
    P,
)
def recent_predictions(spark, sf):
    """The limit is clamped to 1000."""
    return fb.recent(fx.predictions(spark, sf), 5000).select("id", "timestamp", "machine", "final_is_anomaly")


@query("labelled_predictions", "SELECT id, machine, operator_verdict FROM predictions WHERE operator_verdict IS NOT NULL", P)
def labelled_predictions(spark, sf):
    return fb.labelled(fx.predictions(spark, sf)).select("id", "machine", "operator_verdict")


_VALID = "('true_positive', 'false_positive', 'true_negative', 'false_negative')"
_LAST = f"""valid AS (SELECT * FROM verdicts WHERE verdict IN {_VALID}),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY verdict_timestamp DESC, seq DESC) AS k FROM valid)"""


@query("latest_verdict", f"WITH {_LAST} SELECT id, verdict, verdict_timestamp, notes FROM last WHERE k = 1", ["verdicts"])
def latest_verdict(spark, sf):
    ok, _ = fb.split_verdicts(fx.verdicts(spark, sf))
    return fb.latest_verdicts(ok).select("id", "verdict", "verdict_timestamp", "notes")


@query("rejected_verdicts", f"SELECT id, verdict, seq FROM verdicts WHERE verdict NOT IN {_VALID}", ["verdicts"])
def rejected_verdicts(spark, sf):
    return fb.split_verdicts(fx.verdicts(spark, sf))[1].select("id", "verdict", "seq")


@query(
    "apply_verdicts",
    f"""WITH {_LAST} SELECT p.id, p.machine, coalesce(l.verdict, p.operator_verdict) AS operator_verdict, l.verdict_timestamp, l.notes AS verdict_notes
FROM predictions p LEFT JOIN last l ON l.id = p.id AND l.k = 1""",
    ("predictions", "verdicts"),
)
def apply_verdicts(spark, sf):
    """Last write wins."""
    log, _ = fb.apply_verdicts(fx.predictions(spark, sf), fx.verdicts(spark, sf))
    return log.select("id", "machine", "operator_verdict", F.col("verdict_timestamp").cast("timestamp_ntz").alias("verdict_timestamp"), "verdict_notes")


@query(
    "verdicts_for_unknown_ids",
    f"WITH {_LAST} SELECT id, verdict, seq FROM valid WHERE id NOT IN (SELECT id FROM predictions)",
    ("predictions", "verdicts"),
)
def verdicts_for_unknown_ids(spark, sf):
    return fb.apply_verdicts(fx.predictions(spark, sf), fx.verdicts(spark, sf))[1].select("id", "verdict", "seq")


_CAUSE = """CASE operator_verdict WHEN 'true_positive' THEN coalesce(nullif(final_cause, ''), 'unknown_feedback')
WHEN 'false_positive' THEN 'normal' WHEN 'true_negative' THEN 'normal' WHEN 'false_negative' THEN 'unknown_feedback' END"""
_FB = (
    f"fb AS (SELECT id, machine, operator_verdict, {_CAUSE} AS cause, "
    + ", ".join(f"TRY_CAST(json_extract_string(raw_metrics_json, '$.{m}') AS DOUBLE) AS {m}" for m in METRICS)
    + " FROM predictions WHERE operator_verdict IS NOT NULL)"
)
_OK = "cause IS NOT NULL AND " + " AND ".join(f"{m} IS NOT NULL" for m in METRICS)


@query("feedback_training_rows", f"WITH {_FB} SELECT id, machine, {', '.join(METRICS)}, cause, CAST(5 AS DOUBLE) AS weight FROM fb WHERE {_OK}", P)
def feedback_training_rows(spark, sf):
    ok, _ = fb.feedback_to_training(fx.predictions(spark, sf))
    return ok.select("id", "machine", *METRICS, "cause", "weight")


@query(
    "feedback_rejects",
    f"WITH {_FB} SELECT id, machine, operator_verdict, CASE WHEN cause IS NULL THEN 'unknown verdict' ELSE 'missing metric' END AS reason FROM fb WHERE NOT ({_OK})",
    P,
)
def feedback_rejects(spark, sf):
    return fb.feedback_to_training(fx.predictions(spark, sf))[1]


@query(
    "weighted_training_set",
    f"""WITH {_FB}, u AS (SELECT coalesce(nullif(anomaly_type, ''), 'normal') AS cause, CAST(1 AS DOUBLE) AS weight FROM readings
UNION ALL SELECT cause, CAST(5 AS DOUBLE) FROM fb WHERE {_OK}) SELECT cause, weight, count(*) AS n, sum(weight) AS total_weight FROM u GROUP BY 1, 2""",
    P,
)
def weighted_training_set(spark, sf):
    original = fx.readings(spark, sf).selectExpr("machine", *METRICS, "coalesce(nullif(anomaly_type, ''), 'normal') AS cause")
    ok, _ = fb.feedback_to_training(fx.predictions(spark, sf))
    both = fb.combine_training(original, ok)
    return both.groupBy("cause", "weight").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total_weight"))


# Two detectors over the same rows stand for the current and the new model.
_MODELS = f"""{SCORED}, cur AS (SELECT label, cause, CASE WHEN cpu > 160 THEN 1 ELSE 0 END AS pred FROM scored),
new AS (SELECT label, cause, CASE WHEN cpu > {{cut}} AND ram > {{ram}} THEN 1 ELSE 0 END AS pred FROM scored WHERE cause <> 'cascade'),
rc AS (SELECT cause, avg(pred) AS current_recall FROM cur WHERE label = 1 GROUP BY cause),
rn AS (SELECT cause, avg(pred) AS new_recall FROM new WHERE label = 1 GROUP BY cause),
cmp AS (SELECT rc.cause, current_recall, coalesce(new_recall, 0) AS new_recall, current_recall - coalesce(new_recall, 0) AS dropped FROM rc LEFT JOIN rn ON rn.cause = rc.cause)"""


def two_models(spark, sf, cut, ram):
    df = scored(spark, sf)
    current = df.selectExpr("label", "cause", "CASE WHEN cpu > 160 THEN 1 ELSE 0 END AS pred")
    new = df.where("cause <> 'cascade'").selectExpr("label", "cause", f"CASE WHEN cpu > {cut} AND ram > {ram} THEN 1 ELSE 0 END AS pred")
    return current, new


def recalls(df):
    return evaluate.cause_recall(df.where("label = 1"))


@query(
    "compare_cause_recall",
    f"WITH {_MODELS.format(cut=155, ram=20)} SELECT cause, {r6('current_recall')} AS current_recall, {r6('new_recall')} AS new_recall, {r6('dropped')} AS drop FROM cmp",
)
def compare_cause_recall(spark, sf):
    current, new = two_models(spark, sf, 155, 20)
    out = fb.compare_recall(recalls(current), recalls(new))
    return out.select("cause", *[R(c).alias(c) for c in ("current_recall", "new_recall", "drop")])


def _guard_sql(cut, ram):
    f1 = lambda rel, name: (
        f"{name} AS (SELECT CASE WHEN tp = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1 FROM (SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, "
        f"count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM {rel}))"
    )
    return f"""WITH {_MODELS.format(cut=cut, ram=ram)}, {f1('cur', 'fc')}, {f1('new', 'fn')},
w AS (SELECT * FROM cmp WHERE dropped > CAST(0.05 AS DOUBLE) ORDER BY cause LIMIT 1)
SELECT fn.f1 >= fc.f1 AND w.cause IS NULL AS passed, CASE WHEN fn.f1 < fc.f1 THEN printf('lower F1: %.3f after %.3f', fn.f1, fc.f1)
WHEN w.cause IS NOT NULL THEN printf('lower recall of %s: %.3f after %.3f', w.cause, w.new_recall, w.current_recall)
ELSE 'no measure fell' END AS reason FROM fc CROSS JOIN fn LEFT JOIN w ON true"""


def _guard(spark, sf, cut, ram):
    current, new = two_models(spark, sf, cut, ram)
    f1 = lambda d: evaluate.with_prf(evaluate.confusion(d)).select("f1")
    return fb.guardrail(f1(current), f1(new), recalls(current), recalls(new))


@query("guardrail_f1_drop", _guard_sql(155, 60))
def guardrail_f1_drop(spark, sf):
    return _guard(spark, sf, 155, 60)


@query("guardrail_cause_drop", _guard_sql(150, -1))
def guardrail_cause_drop(spark, sf):
    return _guard(spark, sf, 150, -1)


@query(
    "model_evaluation",
    f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM scored), p AS (SELECT {safe('tp', 'tp + fp')} AS precision, {safe('tp', 'tp + fn')} AS recall FROM c)
SELECT 'f1' AS metric, {r6(safe('2 * precision * recall', 'precision + recall'))} AS value FROM p UNION ALL SELECT 'precision', {r6('precision')} FROM p
UNION ALL SELECT 'recall', {r6('recall')} FROM p UNION ALL SELECT concat('recall_', cause), {r6('avg(pred)')} FROM scored WHERE cause <> 'normal' GROUP BY cause""",
)
def model_evaluation(spark, sf):
    """Binary metrics and recall of every cause, long."""
    df = scored(spark, sf)
    overall = evaluate.with_prf(evaluate.confusion(df)).select("precision", "recall", "f1").unpivot([], ["precision", "recall", "f1"], "metric", "value")
    causes = evaluate.cause_recall(df.where("cause <> 'normal'")).select(F.concat(F.lit("recall_"), "cause").alias("metric"), F.col("recall").alias("value"))
    return overall.unionByName(causes).select("metric", R("value").alias("value"))


# Every machine type stands for one training run.
_RUNS = f"""{SCORED}, c AS (SELECT type AS run_id, max(timestamp) AS run_ts, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM scored GROUP BY type),
p AS (SELECT *, {safe('tp', 'tp + fp')} AS precision, {safe('tp', 'tp + fn')} AS recall FROM c),
runs AS (SELECT run_id, run_ts, round({safe('2 * precision * recall', 'precision + recall')}, 4) AS f1 FROM p)"""


def runs(spark, sf):
    df = scored(spark, sf)
    f1 = evaluate.with_prf(evaluate.confusion(df, ["type"])).select(F.col("type").alias("run_id"), F.round("f1", 4).alias("f1"))
    when = df.groupBy(F.col("type").alias("run_id")).agg(F.max("timestamp").alias("run_ts"))
    return f1.join(when, "run_id")


@query(
    "verify_runs",
    f"""WITH {_RUNS} SELECT run_id, f1, CAST(0.5 AS DOUBLE) AS production_f1, f1 >= 0.5 AS passed, CASE WHEN f1 >= 0.5
THEN printf('accepted: F1 %.3f against %.3f', f1, CAST(0.5 AS DOUBLE)) ELSE printf('refused: F1 %.3f against %.3f', f1, CAST(0.5 AS DOUBLE)) END AS reason FROM runs""",
)
def verify_runs(spark, sf):
    return fb.verify(runs(spark, sf), 0.5).select("run_id", "f1", "production_f1", "passed", "reason")


@query(
    "runs_report",
    f"""WITH {_RUNS} SELECT 'production' AS run_id, CAST(NULL AS TIMESTAMP) AS run_ts, CAST(0.816 AS DOUBLE) AS f1, true AS is_production
UNION ALL SELECT run_id, run_ts, f1, false FROM runs""",
)
def runs_report(spark, sf):
    production = spark.sql("SELECT 'production' AS run_id, 0.816D AS f1")
    return fb.runs_report(runs(spark, sf), production).select("run_id", "run_ts", "f1", "is_production")


@query(
    "current_promoted_model",
    f"WITH {_RUNS} SELECT run_id, f1 FROM runs WHERE f1 >= 0.05 ORDER BY run_ts DESC LIMIT 1",
)
def current_promoted_model(spark, sf):
    attempts = fb.verify(runs(spark, sf), 0.05).withColumnRenamed("run_ts", "attempted_at")
    return fb.current_model(attempts).select("run_id", "f1")
