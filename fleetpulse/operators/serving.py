"""Scoring with fitted models: one versioned bundle, one function for batch and stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions import decisions as dec
from fleetpulse.functions.timefeat import resolve_window
from fleetpulse.operators.baselines import metric_order
from fleetpulse.operators.boosting import SoftmaxBoosting
from fleetpulse.operators.classifier import CauseClassifier, p_of
from fleetpulse.operators.iforest import IsolationForest
from fleetpulse.operators.rolling import rolling_names
from fleetpulse.operators.zscore import zscore
from fleetpulse.plans.tables import broadcast_if_small, materialize
from fleetpulse.schemas import PREDICT_THRESHOLD, ROLLING_METRICS, ROLLING_N

KINDS = {"boosted": SoftmaxBoosting, "forest": CauseClassifier}
Classifier = SoftmaxBoosting | CauseClassifier
CONTRACT = (
    "version string, metrics array<string>, threshold double, per_class map<string,double>, iso_threshold double, plain_kind string, trends_kind string"
)


@dataclass
class Bundle:
    """Everything a reading is scored with, under one version.

    ``plain`` takes the z-scores, ``trends`` (optional) the z-scores and the rolling features of a supplied history; the
    isolation forest is the safety net of both. ``machines`` names the type of each known machine.
    """

    version: str
    metrics: list[str]
    baselines: DataFrame
    machines: DataFrame
    forest: IsolationForest
    iso_threshold: float
    plain: Classifier
    trends: Classifier | None = None
    threshold: float = PREDICT_THRESHOLD
    per_class: Mapping[str, float] | None = None

    def __post_init__(self) -> None:
        """Refuse parts whose features or feature order differ."""
        z = [f"z_{m}" for m in self.metrics]
        expected = {"baselines": (metric_order(self.baselines), list(self.metrics)), "isolation forest": (self.forest.features, z), "classifier": (self.plain.features, z)}
        if self.trends:
            expected["trend classifier"] = (self.trends.features, z + rolling_names(ROLLING_METRICS))
        for part, (has, needs) in expected.items():
            if list(has) != needs:
                raise ValueError(f"bundle {self.version}: {part} has features {list(has)}, expected {needs}")
        for part, model in (("classifier", self.plain), ("trend classifier", self.trends)):
            if model and "normal" not in model.classes:
                raise ValueError(f"bundle {self.version}: {part} knows no class 'normal'")

    def save(self, root: str) -> str:
        """Write all parts below a new version folder, the contract last: a folder without it is no bundle."""
        spark, path = self.baselines.sparkSession, f"{root}/{self.version}"
        self.baselines.write.parquet(f"{path}/baselines")
        self.machines.select("machine", "type").write.parquet(f"{path}/machines")
        self.forest.save(f"{path}/isolation")
        kinds = []
        for name, model in (("plain", self.plain), ("trends", self.trends)):
            kinds.append(next((k for k, c in KINDS.items() if isinstance(model, c)), None))
            if model:
                model.save(f"{path}/{name}")
        row = (self.version, list(self.metrics), float(self.threshold), dict(self.per_class) if self.per_class is not None else None, float(self.iso_threshold), *kinds)
        spark.createDataFrame([row], CONTRACT).coalesce(1).write.parquet(f"{path}/contract")
        return path

    @staticmethod
    def load(spark: SparkSession, root: str, version: str) -> "Bundle":
        path = f"{root}/{version}"
        row = spark.read.schema(CONTRACT).parquet(f"{path}/contract").first()
        model = lambda name, kind: KINDS[kind].load(f"{path}/{name}") if kind else None
        return Bundle(
            version=row["version"],
            metrics=list(row["metrics"]),
            baselines=spark.read.parquet(f"{path}/baselines"),
            machines=spark.read.parquet(f"{path}/machines"),
            forest=IsolationForest.load(spark, f"{path}/isolation"),
            iso_threshold=row["iso_threshold"],
            plain=model("plain", row["plain_kind"]),
            trends=model("trends", row["trends_kind"]),
            threshold=row["threshold"],
            per_class=row["per_class"],
        )


def fit_bundle(
    train: DataFrame,
    metrics: Sequence[str],
    version: str,
    contamination: float,
    machines: DataFrame,
    baselines: DataFrame,
    trends: bool = True,
    **boosting,
) -> Bundle:
    """Fit forest and classifiers on windowed training readings with causes (``anomaly_type``) and, for ``trends``, rolling features."""
    metrics, z = list(metrics), [f"z_{m}" for m in metrics]
    rolled = rolling_names(ROLLING_METRICS) if trends else []
    scored = zscore(train, baselines, metrics).withColumn("cause", dec.normalise_cause(F.col("anomaly_type"), True))
    scored = materialize(scored.select("event_id", "cause", *z, *rolled), "bundle-training")
    forest = IsolationForest.fit(scored, z)
    cut = forest.threshold(forest.score(scored), contamination).first()[0]
    plain = SoftmaxBoosting.fit(scored, z, **boosting)
    rich = SoftmaxBoosting.fit(scored, z + rolled, **boosting) if trends else None
    return Bundle(version, metrics, baselines, machines, forest, cut, plain, rich)


def requests_to_readings(requests: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Readings of requests (``machine``, ``metrics`` map, ``machine_type``, ``hour``, ``timestamp`` text, ``history`` map).

    The map becomes one column per metric, hour or timestamp the window; ``error`` tells why a request is refused (an hour
    out of range, a text that is no time, a missing metric) and is null for the others.
    """
    value = lambda m: F.try_element_at("metrics", F.lit(m))
    missing = F.filter(F.array(*[F.when(value(m).isNull(), F.lit(m)) for m in metrics]), lambda m: m.isNotNull())
    windowed = resolve_window(requests)
    error = F.coalesce("error", F.when(F.size(missing) > 0, F.concat(F.lit("missing metric: "), F.array_join(missing, ", "))))
    return windowed.withColumns({"error": error, "type": F.col("machine_type"), **{m: value(m) for m in metrics}}).drop("metrics", "machine_type")


def known_types(readings: DataFrame, machines: DataFrame) -> DataFrame:
    """Fill the type of readings that name none with the one the machine was seen with; add ``machine_known``."""
    if "type" not in readings.columns:
        readings = readings.withColumn("type", F.lit(None).cast("string"))
    known = machines.select("machine", F.col("type").alias("_known_type"), F.lit(True).alias("_known"))
    found = readings.join(broadcast_if_small(known), "machine", "left")
    filled = {"type": F.coalesce(F.nullif(F.col("type"), F.lit("")), "_known_type"), "machine_known": F.coalesce("_known", F.lit(False))}
    return found.withColumns(filled).drop("_known_type", "_known")


def score(readings: DataFrame, bundle: Bundle) -> DataFrame:
    """Add the decision on every reading, batch or stream.

    Added: ``machine_known``, ``baseline_used``, ``z_<metric>``, ``rolling_features_used`` (the history was valid and the bundle
    has a trend classifier), ``probs``, ``p_normal``, ``clf_is_anomaly``, ``clf_cause``, ``iso_score``, ``iso_is_anomaly``, ``is_anomaly``,
    ``likely_cause`` and ``model_version``. Per-class thresholds, where the bundle has them, hold for the trend classifier;
    the plain one always takes the single threshold. A null window falls back to the machine's all-day baseline.
    Columns of these names in ``readings`` are replaced.
    """
    metrics, z = bundle.metrics, [f"z_{m}" for m in bundle.metrics]
    trends = rolling_names(ROLLING_METRICS)
    own = readings.columns
    scored = zscore(known_types(readings, bundle.machines), bundle.baselines, metrics)
    if bundle.trends and "history" in own:
        scored = dec.rolling_from_history(scored.drop(*[t for t in trends if t in own]), ROLLING_METRICS, n=ROLLING_N)
        scored = bundle.trends.probabilities(scored, "_rich").withColumnRenamed("history_ok", "rolling_features_used").drop(*trends)
        scored = dec.decide(scored, bundle.threshold, bundle.per_class, "_rich")
        rich = ("_rich", "clf_is_anomaly", "clf_cause")
        scored = scored.withColumns({f"_rich_{i}": F.col(c) for i, c in enumerate(rich)}).drop(*rich)
    else:
        scored = scored.withColumn("rolling_features_used", F.lit(False))
    scored = dec.decide(bundle.plain.probabilities(scored), bundle.threshold)
    if "_rich_0" in scored.columns:
        use = F.col("rolling_features_used")
        either = {c: F.when(use, F.col(f"_rich_{i}")).otherwise(F.col(c)) for i, c in enumerate(("probs", "clf_is_anomaly", "clf_cause"))}
        scored = scored.withColumns(either).drop("_rich_0", "_rich_1", "_rich_2")
    scored = bundle.forest.score_in_plan(scored).withColumn("iso_is_anomaly", (F.col("iso_score") > F.lit(bundle.iso_threshold)).cast("int"))
    gated = dec.or_gate(scored).withColumns({"p_normal": p_of("probs", "normal"), "model_version": F.lit(bundle.version)})
    added = ["machine_known", "baseline_used", *z, "rolling_features_used", "probs", "p_normal", "clf_is_anomaly", "clf_cause"]
    added += ["iso_score", "iso_is_anomaly", "is_anomaly", "likely_cause", "model_version"]
    kept = [c for c in own if c not in added]
    return gated.select(*[F.col(f"`{c}`") for c in [*kept, *([] if "type" in own else ["type"]), *added]])
