"""Detection quality: strict, point-adjusted and threshold-free metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import f1_of, safe_ratio
from fleetpulse.plans.chunks import CHUNK, CHUNK_ROWS, assign_chunks, lookback_on, running_sum_on
from fleetpulse.plans.prefix import cumulative_counts, is_number
from fleetpulse.plans.tables import materialize, null_safe_join


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Counts ``tn, fp, fn, tp, n, n_anomalies``."""
    y, p = F.col(label), F.col(pred)
    hit = lambda a, b: F.count_if((y == a) & (p == b))
    return df.groupBy(*by).agg(
        hit(0, 0).alias("tn"),
        hit(0, 1).alias("fp"),
        hit(1, 0).alias("fn"),
        hit(1, 1).alias("tp"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == 1).alias("n_anomalies"),
    )


def with_prf(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1, each 0 where undefined."""
    tp = F.col("tp")
    return (
        counts.withColumn("precision", safe_ratio(tp, tp + F.col("fp")))
        .withColumn("recall", safe_ratio(tp, tp + F.col("fn")))
        .withColumn("f1", f1_of(F.col("precision"), F.col("recall")))
    )


def point_adjust(
    df: DataFrame,
    by: Sequence[str] = ("machine",),
    order: Sequence[str] = ("timestamp", "event_id"),
    label: str = "label",
    pred: str = "pred",
    score: str | None = "score",
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Add ``pred_adj`` and ``score_adj``: inside a true block both become the block's maximum.

    Ordinary keys need one shuffle: block numbers and block maxima are windows over the same
    partitioning. When a key is hot its blocks may cross slices, so block maxima are a map-side combined
    aggregate joined back on (key, block).
    """
    by = list(by)
    measures = {"pred_adj": pred, **({"score_adj": score} if score else {})}
    sliced, split = assign_chunks(df, by, order[0], chunk_rows)

    def starts(d, parts):
        before = F.lag(label, 1).over(Window.partitionBy(*parts).orderBy(*order))
        begins = (F.col(label) == 1) & (F.coalesce(before, F.lit(0)) != 1)
        return d.withColumn("_start", begins.cast("bigint"))

    flagged = lookback_on(sliced, split, by, order, 1, starts, [label])
    blocked = running_sum_on(flagged, split, by, order, "_start", "_block").drop("_start")
    true = F.col(label) == 1
    if not split:
        block = Window.partitionBy(*by, CHUNK, "_block", label)
        out = blocked.withColumns({n: F.when(true, F.max(src).over(block)).otherwise(F.col(src)) for n, src in measures.items()})
        return out.drop("_block", CHUNK)
    tops = blocked.where(true).groupBy(*by, "_block").agg(*[F.max(src).alias(f"_{n}") for n, src in measures.items()])
    out = null_safe_join(blocked, tops, [*by, "_block"], "left")
    for n, src in measures.items():
        out = out.withColumn(n, F.when(true, F.col(f"_{n}")).otherwise(F.col(src))).drop(f"_{n}")
    return out.drop("_block", CHUNK)


def curve_counts(df: DataFrame, by: Sequence[str], score: str, label: str = "label") -> DataFrame:
    """Per distinct score: positives and negatives at it and below it."""
    y = F.col(label)
    return cumulative_counts(
        df.where(is_number(score)), by, score, {"pos": F.count_if(y == 1), "neg": F.count_if(y == 0)}
    )


def roc_auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half; NULL with one class."""
    return rank_quality(df, by, score, label).select(*by, "roc_auc")


def rank_quality(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """``roc_auc``, ``pr_auc`` and ``best_f1`` per group from one pass over the scores.

    ``pr_auc`` is the step-wise area: recall gained times precision, summed over thresholds.
    """
    p, r = "(tp / flagged)", "try_divide(tp, positives)"
    aggs = {
        "roc_auc": "try_divide(sum(gained * (negatives - (flagged - tp) + neg / 2D)), CAST(max(positives) * max(negatives) AS DOUBLE))",
        "pr_auc": f"CASE WHEN max(positives) > 0 AND max(negatives) > 0 THEN sum(try_divide(gained, positives) * {p}) END",
        "best_f1": f"max(2 * {p} * {r} / ({p} + {r} + 1e-12D))",
    }
    return precision_recall_steps(df, by, score, label).groupBy(*by).agg(*[F.expr(f"{e} AS {n}") for n, e in aggs.items()])


def precision_recall_steps(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct threshold (flag when score >= it): ``tp, flagged``, what the threshold itself adds
    (``gained, neg``) and the totals."""
    by = list(by)
    counts = curve_counts(df, by, score, label)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    joined = null_safe_join(counts, totals, by) if by else counts.crossJoin(F.broadcast(totals))  # one row
    return joined.selectExpr(
        *[f"`{b}`" for b in by],
        f"`{score}` AS threshold",
        "pos AS gained",
        "neg",
        "positives - pos_below AS tp",
        "positives - pos_below + negatives - neg_below AS flagged",
        "positives",
        "negatives",
    )


def average_precision(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Step-wise area under the precision-recall curve; NULL with one class."""
    return rank_quality(df, by, score, label).select(*by, "pr_auc")


def best_curve_f1(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Largest F1 over all thresholds of the precision-recall curve."""
    return rank_quality(df, by, score, label).select(*by, "best_f1")


def evaluate(df: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Seven metrics per group from ``label, pred, score, pred_adj, score_adj``.

    The narrow input is written once and read by three aggregates.
    """
    by = list(by)
    data = materialize(df.select(*by, "label", "pred", "score", "pred_adj", "score_adj"), "judged")
    out = with_prf(confusion(data, by)).select(*by, "precision", "recall", "f1")
    adjusted = with_prf(confusion(data, by, pred="pred_adj")).select(*by, F.col("f1").alias("f1_adj"))
    ranks = rank_quality(data, by).select(*by, "roc_auc", "pr_auc")
    ranks_adj = rank_quality(data, by, "score_adj").select(*by, F.col("pr_auc").alias("pr_auc_adj"))
    for part in (adjusted, ranks, ranks_adj):
        out = null_safe_join(out, part, by) if by else out.crossJoin(F.broadcast(part))  # one row each
    return out


def class_report(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages."""
    true_side = df.select(F.col(truth).cast("string").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                          (F.col(truth) == F.col(pred)).cast("int").alias("hit"))
    pred_side = df.select(F.col(pred).cast("string").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"),
                          F.lit(0).alias("hit"))
    per = (
        true_side.unionByName(pred_side)
        .groupBy("class")
        .agg(F.sum("t").alias("support"), F.sum("p").alias("_p"), F.sum("hit").alias("_tp"))
        .withColumn("precision", safe_ratio(F.col("_tp"), F.col("_p")))
        .withColumn("recall", safe_ratio(F.col("_tp"), F.col("support")))
        .withColumn("f1", f1_of(F.col("precision"), F.col("recall")))
        .select("class", "precision", "recall", "f1", "support")
    )
    names = ("precision", "recall", "f1")
    weight = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    macro = per.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per.agg(*[weight(c).alias(c) for c in names], F.sum("support").alias("support"))
    return per.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        weighted.withColumn("class", F.lit("weighted avg"))
    )


def cause_recall(df: DataFrame, cause: str = "cause", pred: str = "pred") -> DataFrame:
    """Share of each cause's rows that were flagged."""
    return df.groupBy(cause).agg(F.avg(F.col(pred).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def positive_f1(df: DataFrame, by: str = "anomaly_type", pred: str = "pred") -> DataFrame:
    """F1 of each anomaly type over its own positives, where precision is 1 as soon as one is hit."""
    r = F.avg(F.col(pred).cast("double"))
    return df.where(F.col("label") == 1).groupBy(by).agg((2 * r / (1 + r)).alias("f1"))


def cause_accuracy(df: DataFrame, likely: str = "likely_cause", truth: str = "anomaly_type") -> DataFrame:
    """Among true positives, the share whose reported cause is the true one."""
    right = F.coalesce((F.col(likely) == F.col(truth)).cast("int"), F.lit(0))
    return df.where((F.col("label") == 1) & (F.col("is_anomaly") == 1)).agg(
        F.sum(right).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.avg(right.cast("double")).alias("accuracy"),
    )
