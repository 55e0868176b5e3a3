"""Prediction log, operator verdicts, training examples from feedback and the promotion guardrail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.schemas import FEEDBACK_WEIGHT, MAX_RECALL_DROP, METRICS, VERDICTS


def verdict_stats(log: DataFrame, verdict: str = "operator_verdict") -> DataFrame:
    """Predictions per verdict, unanswered ones as ``_pending``, with the overall total."""
    counts = log.groupBy(F.coalesce(verdict, F.lit("_pending")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    # At most one row per verdict kind.
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def recent(log: DataFrame, limit: int = 100, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """Newest predictions, the limit clamped to 1..1000."""
    return log.orderBy(F.desc(ts), F.desc(tie)).limit(min(max(limit, 1), 1000))


def split_verdicts(verdicts: DataFrame, col: str = "verdict") -> tuple[DataFrame, DataFrame]:
    """Verdicts in the allowed set, and the rejects."""
    ok = F.coalesce(F.col(col).isin(*VERDICTS), F.lit(False))
    return verdicts.where(ok), verdicts.where(~ok)


def latest_verdicts(verdicts: DataFrame, key: str = "id", ts: str = "verdict_timestamp", tie: str = "seq") -> DataFrame:
    """Last verdict per prediction, as one map-side combined aggregate."""
    others = [c for c in verdicts.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(ts, tie))
    return verdicts.groupBy(key).agg(newest.alias("v")).select(key, "v.*")


def apply_verdicts(log: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log with the latest valid verdict of each prediction, and verdicts for unknown predictions.

    ``verdicts`` has ``id, verdict, verdict_timestamp, notes, seq``.
    """
    valid, _ = split_verdicts(verdicts)
    last = latest_verdicts(valid).select(
        "id",
        F.col("verdict").alias("_v"),
        F.col("verdict_timestamp").alias("_t"),
        F.col("notes").alias("_n"),
    )
    has = F.col("_v").isNotNull()
    updated = log.join(last, "id", "left")
    for name, new in (("operator_verdict", "_v"), ("verdict_timestamp", "_t"), ("verdict_notes", "_n")):
        old = F.col(name) if name in log.columns else F.lit(None)
        updated = updated.withColumn(name, F.when(has, F.col(new)).otherwise(old))
    return updated.drop("_v", "_t", "_n"), valid.join(log.select("id"), "id", "left_anti")


def labelled(log: DataFrame) -> DataFrame:
    return log.where(F.col("operator_verdict").isNotNull())


def verdict_label(verdict: Column, cause: Column) -> Column:
    """Training label of a verdict; NULL for an unknown verdict."""
    named = F.coalesce(F.nullif(cause, F.lit("")), F.lit("unknown_feedback"))
    return (
        F.when(verdict == "true_positive", named)
        .when(verdict.isin("false_positive", "true_negative"), F.lit("normal"))
        .when(verdict == "false_negative", F.lit("unknown_feedback"))
    )


def feedback_to_training(log: DataFrame, metrics: Sequence[str] = METRICS) -> tuple[DataFrame, DataFrame]:
    """Training rows ``id, machine, <metrics>, cause, weight`` from answered predictions, and the rejects.

    The machine stays in the row, so a skipped row cannot shift the others.
    """
    raw = F.from_json("raw_metrics_json", "map<string,double>")
    rows = (
        labelled(log)
        .withColumn("_raw", raw)
        .withColumns({m: F.try_element_at("_raw", F.lit(m)) for m in metrics})
        .withColumn("cause", verdict_label(F.col("operator_verdict"), F.col("final_cause")))
    )
    complete = F.col("cause").isNotNull()
    for m in metrics:
        complete = complete & F.col(m).isNotNull()
    keys = ["id", "machine", *[c for c in ("machine_type", "time_window", "timestamp") if c in log.columns]]
    ok = rows.where(complete).select(*keys, *metrics, "cause", F.lit(FEEDBACK_WEIGHT).alias("weight"))
    reason = F.when(F.col("cause").isNull(), F.lit("unknown verdict")).otherwise(F.lit("missing metric"))
    return ok, rows.where(~complete).select("id", "machine", "operator_verdict", reason.alias("reason"))


def combine_training(original: DataFrame, feedback: DataFrame) -> DataFrame:
    """Original rows at weight 1 and feedback rows at their own."""
    return original.withColumn("weight", F.lit(1.0)).unionByName(feedback, allowMissingColumns=True)


def compare_recall(current: DataFrame, new: DataFrame) -> DataFrame:
    """Recall per cause before and after; a cause the new model lacks counts as 0."""
    after = new.select("cause", F.col("recall").alias("_new"))
    return (
        current.select("cause", F.col("recall").alias("current_recall"))
        .join(after, "cause", "left")
        .select("cause", "current_recall", F.coalesce("_new", F.lit(0.0)).alias("new_recall"))
        .withColumn("drop", F.col("current_recall") - F.col("new_recall"))
    )


def guardrail(
    current_f1: DataFrame,
    new_f1: DataFrame,
    current_recall: DataFrame,
    new_recall: DataFrame,
    max_drop: float = MAX_RECALL_DROP,
) -> DataFrame:
    """One row ``passed, reason``: F1 must not fall and no cause may lose more than ``max_drop`` recall.

    The first two inputs are one-row tables with ``f1``; causes are examined in name order.
    """
    worst = (
        compare_recall(current_recall, new_recall)
        .where(F.col("drop") > max_drop)
        .agg(F.min_by(F.struct("cause", "current_recall", "new_recall", "drop"), "cause").alias("w"))
    )
    three = lambda c: F.format_string("%.3f", c)
    cur, new = F.col("cur"), F.col("new")
    both = current_f1.select(F.col("f1").alias("cur")).crossJoin(F.broadcast(new_f1.select(F.col("f1").alias("new"))))
    reason = (
        F.when(new < cur, F.concat(F.lit("lower F1: "), three(new), F.lit(" after "), three(cur)))
        .when(
            F.col("w").isNotNull(),
            F.concat(
                F.lit("lower recall of "),
                F.col("w.cause"),
                F.lit(": "),
                three(F.col("w.new_recall")),
                F.lit(" after "),
                three(F.col("w.current_recall")),
            ),
        )
        .otherwise(F.lit("no measure fell"))
    )
    passed = (new >= cur) & F.col("w").isNull()
    return both.crossJoin(F.broadcast(worst)).select(passed.alias("passed"), reason.alias("reason"))


def current_model(promotions: DataFrame, ts: str = "attempted_at") -> DataFrame:
    """The latest attempt that passed."""
    row = F.struct(*promotions.columns)
    return promotions.where("passed").agg(F.max_by(row, ts).alias("m")).where("m IS NOT NULL").select("m.*")


def verify(runs: DataFrame, production_f1: float, ratio: float = 1.0) -> DataFrame:
    """Compare each run's F1 with production; failed runs stay failed."""
    new, prod = F.col("f1"), F.lit(float(production_f1))
    passed = new >= prod * F.lit(ratio)
    three = lambda c: F.format_string("%.3f", c)
    reason = F.when(
        passed, F.concat(F.lit("accepted: F1 "), three(new), F.lit(" against "), three(prod))
    ).otherwise(F.concat(F.lit("refused: F1 "), three(new), F.lit(" against "), three(prod)))
    return runs.withColumns({"production_f1": prod, "passed": F.coalesce(passed, F.lit(False)), "reason": reason})


def runs_report(runs: DataFrame, production: DataFrame, ts: str = "run_ts") -> DataFrame:
    """The production row first, then runs newest first; ``position`` keeps the order."""
    listed = production.withColumn("is_production", F.lit(True)).unionByName(
        runs.withColumn("is_production", F.lit(False)), allowMissingColumns=True
    )
    return listed.orderBy(F.desc("is_production"), F.desc(ts))
