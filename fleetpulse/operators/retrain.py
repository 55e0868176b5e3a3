"""Retrain the cause classifier from operator verdicts, promote only through the guardrail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.decisions import normalise_cause
from fleetpulse.operators import evaluate, feedback
from fleetpulse.operators.classifier import CauseClassifier
from fleetpulse.operators.sampling import anomalies_and_normals
from fleetpulse.operators.zscore import zscore
from fleetpulse.plans.tables import materialize
from fleetpulse.sources.store import record_attempt


@dataclass
class Attempt:
    """One retraining attempt: the model, its quality and the guardrail's one-row verdict."""

    model: CauseClassifier
    quality: DataFrame
    recall: DataFrame
    verdict: DataFrame
    feedback_rows: int
    rejected: DataFrame


def likeliest(probs: str) -> Column:
    """Class of the largest probability; ties go to the alphabetically first."""
    best = F.array_max(F.transform(probs, lambda e: e["p"]))
    return F.array_min(F.transform(F.filter(probs, lambda e: e["p"] == best), lambda e: e["cause"]))


def evaluate_causes(model: CauseClassifier, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Binary quality (one row) and recall per true cause of a classifier on z-scored test rows."""
    judged = materialize(
        model.probabilities(test).select(
            "label",
            normalise_cause(F.col("anomaly_type")).alias("cause"),
            (likeliest("probs") != "normal").cast("int").alias("pred"),
        ),
        "judged",
    )
    quality = evaluate.with_prf(evaluate.confusion(judged)).select("precision", "recall", "f1")
    return quality, evaluate.cause_recall(judged.where("cause <> 'normal'"))


def retrain(
    train: DataFrame,
    test: DataFrame,
    log: DataFrame,
    baselines: DataFrame,
    metrics: Sequence[str],
    current_quality: DataFrame,
    current_recall: DataFrame,
    normals: int | None = None,
    trees: int = 150,
    seed: int = 42,
) -> Attempt:
    """Original readings at weight 1 and answered predictions at weight 5, both z-scored with the same
    baselines, train a new classifier that is judged on independent test rows.

    ``normals`` keeps all anomalies and that many normal readings. Each feedback row carries its own
    machine, type and window.
    """
    z = [f"z_{m}" for m in metrics]
    original = anomalies_and_normals(train, normals, seed=seed) if normals else train
    original = original.withColumn("cause", normalise_cause(F.col("anomaly_type"), True))
    answered, rejected = feedback.feedback_to_training(log, metrics)
    rename = {"machine_type": "type", "time_window": "window"}
    answered = answered.withColumnsRenamed({k: v for k, v in rename.items() if k in answered.columns})
    narrow = lambda d, *extra: zscore(d, baselines, metrics).select(*z, "cause", *extra)
    rows = feedback.combine_training(narrow(original), narrow(answered, "weight"))
    model = CauseClassifier.fit(rows, z, weight="weight", trees=trees, seed=seed)
    quality, recall = evaluate_causes(model, zscore(test, baselines, metrics))
    verdict = feedback.guardrail(current_quality.select("f1"), quality.select("f1"), current_recall, recall)
    return Attempt(model, quality, recall, verdict, answered.count(), rejected)


def keep_attempt(attempt: Attempt, root: str, version: str) -> bool:
    """Save the model whatever the outcome, append the attempt, and say whether it was promoted."""
    path = f"{root}/models/{version}"
    attempt.model.save(path)
    metrics = attempt.quality.first().asDict()
    record_attempt(attempt.verdict, f"{root}/promotions", version, path, metrics, attempt.feedback_rows)
    return bool(attempt.verdict.first()["passed"])
