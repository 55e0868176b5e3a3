"""Anomaly decisions from class probabilities and detector votes.

Probabilities are an array of ``struct<cause, p>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.schemas import PREDICT_THRESHOLD, SAFETY_NET_CAUSE

# A class without its own threshold gets one no probability can reach.
NEVER = 1.01


def normalise_cause(cause: Column, cascade_is_normal: bool = False) -> Column:
    """NULL and '' mean normal; training also folds cascade into normal."""
    known = F.coalesce(F.nullif(cause, F.lit("")), F.lit("normal"))
    return F.when(known == "cascade", F.lit("normal")).otherwise(known) if cascade_is_normal else known


def decide(
    df: DataFrame,
    threshold: float = PREDICT_THRESHOLD,
    per_class: dict[str, float] | None = None,
    probs: str = "probs",
) -> DataFrame:
    """Add ``clf_is_anomaly`` and ``clf_cause``.

    Single threshold: anomalous when P(normal) is below it, cause is the likeliest other class.
    Per class: anomalous when any class reaches its own threshold, cause has the largest margin.
    Ties go to the alphabetically first class.
    """
    others = F.filter(probs, lambda e: e["cause"] != "normal")
    ordered = F.array_sort(others, lambda a, b: F.when(a["cause"] < b["cause"], -1).otherwise(1))
    best = lambda arr, measure: F.reduce(
        arr,
        F.struct(F.lit("normal").alias("cause"), F.lit(float("-inf")).alias("m")),
        lambda acc, e: F.when(
            measure(e) > acc["m"], F.struct(e["cause"].alias("cause"), measure(e).alias("m"))
        ).otherwise(acc),
    )["cause"]
    if per_class is None:
        p_normal = F.element_at(F.filter(probs, lambda e: e["cause"] == "normal"), 1)["p"]
        flag = p_normal < F.lit(threshold)
        cause = best(ordered, lambda e: e["p"])
    else:
        bar = lambda e: F.coalesce(_threshold_of(e["cause"], per_class), F.lit(NEVER))
        over = F.filter(ordered, lambda e: e["p"] >= bar(e))
        flag = F.size(over) > 0
        cause = best(over, lambda e: e["p"] - bar(e))
    return df.withColumn("clf_is_anomaly", flag.cast("int")).withColumn(
        "clf_cause", F.when(flag, cause).otherwise(F.lit("normal"))
    )


def _threshold_of(cause: Column, per_class: dict[str, float]) -> Column:
    out = None
    for name, value in sorted(per_class.items()):
        out = F.when(cause == name, F.lit(float(value))) if out is None else out.when(cause == name, F.lit(float(value)))
    return out


def or_gate(df: DataFrame, clf: str = "clf_is_anomaly", iso: str = "iso_is_anomaly", cause: str = "clf_cause") -> DataFrame:
    """Either detector fires; the classifier names the cause, else the safety-net text, else NULL."""
    c, i = F.col(clf) == 1, F.col(iso) == 1
    return df.withColumn("is_anomaly", (c | i).cast("int")).withColumn(
        "likely_cause", F.when(c, F.col(cause)).when(i, F.lit(SAFETY_NET_CAUSE))
    )


def either(*flags: Column) -> Column:
    """Blind ensemble: 1 when any detector fires."""
    return F.greatest(*flags)


def severity(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size >= 3, F.lit("red")).when(size >= 2, F.lit("yellow")).otherwise(F.lit("green"))


def outcome(label: Column, pred: Column) -> Column:
    return (
        F.when((label == 1) & (pred == 1), F.lit("TP"))
        .when((label == 0) & (pred == 0), F.lit("TN"))
        .when((label == 0) & (pred == 1), F.lit("FP"))
        .otherwise(F.lit("FN"))
    )


def rolling_from_history(df: DataFrame, metrics, col: str = "history", n: int = 10) -> DataFrame:
    """Rolling features of a supplied ``map<metric, array<double>>`` whose last entry is current.

    Only the last ``n`` values count; delta needs all ``n``, as in training. A missing or empty list for
    any metric makes every feature NULL (``history_ok`` false).
    """
    value = lambda m: F.try_element_at(col, F.lit(m))
    ok = None
    for m in metrics:
        good = F.coalesce(F.size(value(m)) > 0, F.lit(False))
        ok = good if ok is None else ok & good
    out = {"history_ok": F.coalesce(ok, F.lit(False))}
    for m in metrics:
        arr = F.slice(value(m), F.greatest(F.size(value(m)) - n + 1, F.lit(1)), F.lit(n))
        mean = F.reduce(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)
        spread = F.reduce(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        std = F.when(F.size(arr) >= 2, F.sqrt(spread / (F.size(arr) - 1))).otherwise(F.lit(0.0))
        delta = F.when(F.size(arr) == n, F.element_at(arr, -1) - F.element_at(arr, 1)).otherwise(F.lit(0.0))
        for name, c in (("rolling_mean", mean), ("rolling_std", std), ("delta", delta)):
            out[f"{m}_{name}"] = F.when(ok, c)
    return df.withColumns(out)
