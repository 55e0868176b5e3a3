"""Evaluation metrics and reports."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import query, r6, safe
from fleetpulse.functions import decisions as dec
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.operators import dashboard, evaluate, sweep
from fleetpulse.plans.prefix import exact_percentiles, order_statistics

# A simple detector with hits and misses; its score is coarse so that ties occur.
SCORED = """scored AS (SELECT *, CASE WHEN cpu * 0.5 + ram > 110 THEN 1 ELSE 0 END AS pred, round((cpu * 0.5 + ram) / 4) / 50 AS score,
coalesce(nullif(anomaly_type, ''), 'normal') AS cause FROM readings)"""


def scored(spark, sf):
    return fx.readings(spark, sf).selectExpr(
        "*",
        "CASE WHEN cpu * 0.5D + ram > 110 THEN 1 ELSE 0 END AS pred",
        "round((cpu * 0.5D + ram) / 4) / 50 AS score",
        "coalesce(nullif(anomaly_type, ''), 'normal') AS cause",
    )


_COUNTS = """count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp"""


@query("confusion_tags", f"WITH {SCORED} SELECT event_id, CASE WHEN label = 1 AND pred = 1 THEN 'TP' WHEN label = 0 AND pred = 0 THEN 'TN' WHEN label = 0 THEN 'FP' ELSE 'FN' END AS outcome FROM scored")
def confusion_tags(spark, sf):
    return scored(spark, sf).select("event_id", dec.outcome(F.col("label"), F.col("pred")).alias("outcome"))


@query("confusion_matrix", f"WITH {SCORED} SELECT type, {_COUNTS}, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_anomalies FROM scored GROUP BY type")
def confusion_matrix(spark, sf):
    return evaluate.confusion(scored(spark, sf), ["type"])


_P, _R = safe("tp", "tp + fp"), safe("tp", "tp + fn")
_PRF = f"{_P} AS precision, {_R} AS recall"
_F1 = safe("2 * precision * recall", "precision + recall")


@query(
    "precision_recall_f1",
    f"WITH {SCORED}, c AS (SELECT type, {_COUNTS} FROM scored GROUP BY type), p AS (SELECT type, {_PRF} FROM c) "
    f"SELECT type, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6(_F1)} AS f1 FROM p",
)
def precision_recall_f1(spark, sf):
    out = evaluate.with_prf(evaluate.confusion(scored(spark, sf), ["type"]))
    return out.select("type", *[R(c).alias(c) for c in ("precision", "recall", "f1")])


_BLOCKS = f"""{SCORED},
s AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY machine ORDER BY timestamp, event_id), 0) <> 1 THEN 1 ELSE 0 END AS st FROM scored),
b AS (SELECT *, sum(st) OVER (PARTITION BY machine ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS blk FROM s),
adj AS (SELECT *, CASE WHEN label = 1 THEN max(pred) OVER (PARTITION BY machine, blk, label) ELSE pred END AS pred_adj,
CASE WHEN label = 1 THEN max(score) OVER (PARTITION BY machine, blk, label) ELSE score END AS score_adj FROM b)"""
_ADJ = f"WITH {_BLOCKS} SELECT event_id, pred_adj, {r6('score_adj')} AS score_adj FROM adj"


@query("point_adjust", _ADJ)
def point_adjust(spark, sf):
    return evaluate.point_adjust(scored(spark, sf)).select("event_id", "pred_adj", R("score_adj").alias("score_adj"))


@query("point_adjust_sliced", _ADJ)
def point_adjust_sliced(spark, sf):
    """Blocks that cross time slices of hot machines are stitched."""
    out = evaluate.point_adjust(scored(spark, sf), chunk_rows=15)
    return out.select("event_id", "pred_adj", R("score_adj").alias("score_adj"))


@query(
    "point_adjust_by_type",
    """WITH t AS (SELECT event_id, type, timestamp, CASE WHEN ram > 45 THEN 1 ELSE 0 END AS label, CASE WHEN cpu > 100 THEN 1 ELSE 0 END AS pred FROM readings),
s AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY type ORDER BY timestamp, event_id), 0) <> 1 THEN 1 ELSE 0 END AS st FROM t),
b AS (SELECT *, sum(st) OVER (PARTITION BY type ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS blk FROM s)
SELECT event_id, CASE WHEN label = 1 THEN max(pred) OVER (PARTITION BY type, blk, label) ELSE pred END AS pred_adj FROM b""",
)
def point_adjust_by_type(spark, sf):
    """Long blocks over few, large groups."""
    df = fx.readings(spark, sf).selectExpr(
        "event_id", "type", "timestamp", "CASE WHEN ram > 45 THEN 1 ELSE 0 END AS label", "CASE WHEN cpu > 100 THEN 1 ELSE 0 END AS pred"
    )
    return evaluate.point_adjust(df, by=("type",), score=None, chunk_rows=300).select("event_id", "pred_adj")


def _auc_sql(rel, by, score="score"):
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {keys}{r6('auc')} AS roc_auc FROM (SELECT {keys}sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (
SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
SELECT {keys}{score}, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM {rel} GROUP BY {keys}{score})) {f'GROUP BY {by}' if by else ''})"""


@query("roc_auc", f"WITH {SCORED} {_auc_sql('scored', 'type')}")
def roc_auc(spark, sf):
    return evaluate.roc_auc(scored(spark, sf), ["type"]).select("type", R("roc_auc").alias("roc_auc"))


@query("roc_auc_fine_scores", f"WITH s AS (SELECT label, cpu * 0.3 + ram + event_id / 1e7 AS score FROM readings) {_auc_sql('s', '')}")
def roc_auc_fine_scores(spark, sf):
    """Every score distinct: the running totals span many value buckets."""
    df = fx.readings(spark, sf).selectExpr("label", "cpu * 0.3D + ram + event_id / 1e7D AS score")
    return evaluate.roc_auc(df).select(R("roc_auc").alias("roc_auc"))


def _curve_sql(rel, by, score="score"):
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    over = f"OVER ({part}ORDER BY {score} DESC ROWS UNBOUNDED PRECEDING)"
    return f"""curve AS (SELECT {keys}{score} AS threshold, pos, sum(pos) {over} AS tp, sum(pos + neg) {over} AS flagged,
sum(pos) OVER ({part}) AS positives, sum(neg) OVER ({part}) AS negatives FROM (SELECT {keys}{score}, CAST(sum(label) AS DOUBLE) AS pos,
CAST(sum(1 - label) AS DOUBLE) AS neg FROM {rel} GROUP BY {keys}{score}))"""


@query(
    "average_precision",
    f"WITH {SCORED}, {_curve_sql('scored', 'type')} SELECT type, {r6('sum(pos / positives * tp / flagged)')} AS pr_auc FROM curve GROUP BY type",
)
def average_precision(spark, sf):
    return evaluate.average_precision(scored(spark, sf), ["type"]).select("type", R("pr_auc").alias("pr_auc"))


@query(
    "best_curve_f1",
    f"""WITH {SCORED}, {_curve_sql('scored', 'type')} SELECT type,
{r6('max(2 * (tp / flagged) * (tp / positives) / ((tp / flagged) + (tp / positives) + 1e-12))')} AS best_f1 FROM curve GROUP BY type""",
)
def best_curve_f1(spark, sf):
    return evaluate.best_curve_f1(scored(spark, sf), ["type"]).select("type", R("best_f1").alias("best_f1"))


_EVAL = ("precision", "recall", "f1", "f1_adj", "roc_auc", "pr_auc", "pr_auc_adj")
_ADJ_COUNTS = _COUNTS.replace("pred", "pred_adj")


@query(
    "evaluate_all_metrics",
    f"""WITH {_BLOCKS}, m AS (SELECT 'rule' AS method, * FROM adj),
c AS (SELECT method, {_COUNTS} FROM m GROUP BY method), p AS (SELECT method, {_PRF} FROM c),
ca AS (SELECT method, {_ADJ_COUNTS} FROM m GROUP BY method), pa AS (SELECT method, {_PRF} FROM ca),
auc AS ({_auc_sql('m', 'method')}), {_curve_sql('m', 'method')},
ap AS (SELECT method, sum(pos / positives * tp / flagged) AS pr_auc FROM curve GROUP BY method),
{_curve_sql('m', 'method', 'score_adj').replace('curve AS', 'curve2 AS')},
ap2 AS (SELECT method, sum(pos / positives * tp / flagged) AS pr_auc_adj FROM curve2 GROUP BY method)
SELECT p.method, {r6('p.precision')} AS precision, {r6('p.recall')} AS recall,
{r6(safe('2 * p.precision * p.recall', 'p.precision + p.recall'))} AS f1,
{r6(safe('2 * pa.precision * pa.recall', 'pa.precision + pa.recall'))} AS f1_adj, auc.roc_auc, {r6('ap.pr_auc')} AS pr_auc, {r6('ap2.pr_auc_adj')} AS pr_auc_adj
FROM p JOIN pa USING (method) JOIN auc USING (method) JOIN ap USING (method) JOIN ap2 USING (method)""",
)
def evaluate_all_metrics(spark, sf):
    """The seven-metric row of the method comparison."""
    df = evaluate.point_adjust(scored(spark, sf)).withColumn("method", F.lit("rule"))
    return evaluate.evaluate(df).select("method", *[R(c).alias(c) for c in _EVAL])


_CLASS = f"""WITH {SCORED}, x AS (SELECT cause AS truth, CASE WHEN pred = 0 THEN 'normal' WHEN ram > 60 THEN 'disk_saturation' ELSE cause END AS guess FROM scored),
k AS (SELECT truth AS class, 1 AS t, 0 AS p, CASE WHEN truth = guess THEN 1 ELSE 0 END AS hit FROM x UNION ALL SELECT guess, 0, 1, 0 FROM x),
g AS (SELECT class, sum(t) AS support, sum(p) AS pc, sum(hit) AS tp FROM k GROUP BY class),
q AS (SELECT class, {safe('tp', 'pc')} AS precision, {safe('tp', 'support')} AS recall, CAST(support AS BIGINT) AS support FROM g),
f AS (SELECT *, {_F1} AS f1 FROM q),
u AS (SELECT class, precision, recall, f1, support FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f)
SELECT class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support FROM u"""


@query("class_report", _CLASS)
def class_report(spark, sf):
    guess = "CASE WHEN pred = 0 THEN 'normal' WHEN ram > 60 THEN 'disk_saturation' ELSE cause END AS guess"
    df = scored(spark, sf).selectExpr("cause", guess)
    out = evaluate.class_report(df, "cause", "guess")
    return out.select("class", *[R(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("cause_recall", f"WITH {SCORED} SELECT cause, {r6('avg(pred)')} AS recall, count(*) AS n FROM scored GROUP BY cause")
def cause_recall(spark, sf):
    return evaluate.cause_recall(scored(spark, sf)).select("cause", R("recall").alias("recall"), "n")


@query("positive_f1_by_type", f"WITH {SCORED} SELECT anomaly_type, {r6('(2 * avg(pred) / (1 + avg(pred)))')} AS f1 FROM scored WHERE label = 1 GROUP BY anomaly_type")
def positive_f1_by_type(spark, sf):
    return evaluate.positive_f1(scored(spark, sf)).select("anomaly_type", R("f1").alias("f1"))


_LIKELY = "CASE WHEN ram > 50 THEN 'disk_saturation' WHEN ram > 34 THEN 'network_flood' END"


@query(
    "cause_accuracy",
    f"""WITH {SCORED}, x AS (SELECT *, {_LIKELY} AS likely_cause FROM scored), y AS (SELECT CASE WHEN likely_cause = anomaly_type THEN 1 ELSE 0 END AS ok FROM x WHERE label = 1 AND pred = 1)
SELECT CAST(sum(ok) AS BIGINT) AS correct, count(*) AS total, {r6('avg(ok)')} AS accuracy FROM y""",
)
def cause_accuracy(spark, sf):
    df = scored(spark, sf).selectExpr("*", f"{_LIKELY} AS likely_cause", "pred AS is_anomaly")
    return evaluate.cause_accuracy(df).select("correct", "total", R("accuracy").alias("accuracy"))


@query("daily_detection", f"WITH {SCORED} SELECT CAST(timestamp AS DATE) AS day, CAST(sum(pred) AS BIGINT) AS hit, count(*) AS total FROM scored WHERE label = 1 GROUP BY 1")
def daily_detection(spark, sf):
    return dashboard.daily_detection(scored(spark, sf))


@query(
    "latency_quantiles",
    """WITH o AS (SELECT type, cpu AS latency, row_number() OVER (PARTITION BY type ORDER BY cpu) - 1 AS i, count(*) OVER (PARTITION BY type) AS n FROM readings)
SELECT type, n, max(CASE WHEN i = n // 2 THEN latency END) AS p50, max(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN latency END) AS p95,
max(CASE WHEN i = n - 1 THEN latency END) AS max FROM o GROUP BY type, n""",
)
def latency_quantiles(spark, sf):
    """Quantiles by sorted position, not interpolated."""
    n = F.col("n")
    picks = {"p50": F.floor(n / 2), "p95": F.floor(n * F.lit(0.95)), "max": n - 1}
    return order_statistics(fx.readings(spark, sf), ["type"], "cpu", picks)


@query(
    "exact_percentiles",
    f"SELECT type, {r6('quantile_cont(cpu, 0.05)')} AS q05, {r6('quantile_cont(cpu, 0.95)')} AS q95 FROM readings GROUP BY type",
)
def exact_percentiles_query(spark, sf):
    """Interpolated percentiles by distributed counting, the path for hot groups."""
    out = exact_percentiles(fx.readings(spark, sf), ["type"], "cpu", {"q05": 0.05, "q95": 0.95})
    return out.select("type", R("q05").alias("q05"), R("q95").alias("q95"))


@query(
    "fleet_summary",
    f"SELECT type, count(*) AS n_rows, count(DISTINCT machine) AS n_machines, {r6('avg(label)')} AS anomaly_ratio FROM readings GROUP BY ROLLUP (type)",
)
def fleet_summary(spark, sf):
    return dashboard.fleet_summary(fx.readings(spark, sf)).select("type", "n_rows", "n_machines", R("anomaly_ratio").alias("anomaly_ratio"))


@query(
    "threshold_curve",
    f"""WITH s AS (SELECT label, cpu / 500 + ram / 300 AS score FROM readings), x AS (SELECT min(score) AS lo, max(score) AS hi, sum(label) AS positives FROM s),
t AS (SELECT i, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199) END AS threshold, positives FROM x, range(200) r(i)),
c AS (SELECT threshold, positives, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold) AS flagged FROM t, s GROUP BY threshold, positives),
p AS (SELECT *, {safe('tp', 'flagged')} AS precision, {safe('tp', 'positives')} AS recall FROM c)
SELECT {r6('threshold')} AS threshold, tp, flagged, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6(_F1)} AS f1 FROM p""",
)
def threshold_curve(spark, sf):
    """Quality at 200 evenly spaced thresholds from one histogram."""
    df = fx.readings(spark, sf).selectExpr("label", "cpu / 500 + ram / 300 AS score")
    out = sweep.linspace_curve(df)
    return out.select(R("threshold").alias("threshold"), "tp", "flagged", *[R(c).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "best_threshold",
    f"""WITH s AS (SELECT label, cpu / 500 + ram / 300 AS score FROM readings), x AS (SELECT min(score) AS lo, max(score) AS hi, sum(label) AS positives FROM s),
t AS (SELECT i, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199) END AS threshold, positives FROM x, range(200) r(i)),
c AS (SELECT threshold, positives, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold) AS flagged FROM t, s GROUP BY threshold, positives),
p AS (SELECT *, {safe('tp', 'flagged')} AS precision, {safe('tp', 'positives')} AS recall FROM c), f AS (SELECT *, {_F1} AS f1 FROM p)
SELECT {r6('threshold')} AS threshold, tp, flagged, {r6('f1')} AS f1 FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1""",
)
def best_threshold(spark, sf):
    df = fx.readings(spark, sf).selectExpr("label", "cpu / 500 + ram / 300 AS score")
    best = sweep.best_point(sweep.linspace_curve(df))
    return best.select(R("threshold").alias("threshold"), "tp", "flagged", R("f1").alias("f1"))
