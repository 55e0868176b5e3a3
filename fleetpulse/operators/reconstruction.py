"""Reconstruction-error detector: principal components fitted by Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.plans.prefix import exact_percentiles


@dataclass
class Reconstruction:
    """Projection matrix and column means: features x k numbers."""

    features: list[str]
    means: list[float]
    axes: list[list[float]]

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], k: int = 4) -> "Reconstruction":
        features = list(features)
        # One row with one number per feature.
        row = df.agg(*[F.avg(f).alias(f) for f in features]).first()
        means = [float(row[f] or 0.0) for f in features]
        centred = df.select(*[(F.coalesce(F.col(f), F.lit(m)) - F.lit(m)).alias(f) for f, m in zip(features, means)])
        vectors = VectorAssembler(inputCols=features, outputCol="x").transform(centred).select("x")
        matrix = PCA(k=min(k, len(features)), inputCol="x", outputCol="y").fit(vectors).pc.toArray()
        return Reconstruction(features, means, matrix.T.tolist())

    def score(self, df: DataFrame, out: str = "rebuild_error") -> DataFrame:
        """Add the mean squared error of a row rebuilt from its components, as column arithmetic."""
        x = [F.coalesce(F.col(f), F.lit(m)) - F.lit(m) for f, m in zip(self.features, self.means)]
        prepared = df.withColumn("_x", F.array(*x))
        axes = [F.array(*[F.lit(v) for v in axis]) for axis in self.axes]
        dot = lambda a, b: F.reduce(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        prepared = prepared.withColumn("_y", F.array(*[dot(F.col("_x"), a) for a in axes]))
        back = [
            sum((F.col("_y")[j] * F.lit(axis[i]) for j, axis in enumerate(self.axes)), F.lit(0.0))
            for i in range(len(self.features))
        ]
        gaps = [(F.col("_x")[i] - b) * (F.col("_x")[i] - b) for i, b in enumerate(back)]
        error = sum(gaps[1:], gaps[0]) / F.lit(float(len(gaps)))
        return prepared.withColumn(out, error).drop("_x", "_y")

    @staticmethod
    def threshold(scored: DataFrame, contamination: float, score: str = "rebuild_error") -> DataFrame:
        """One row ``rebuild_threshold``."""
        return exact_percentiles(scored, [], score, {"rebuild_threshold": 1.0 - contamination})
