"""Local outlier factor in novelty mode over all training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.neighbours import Cells, nearest
from fleetpulse.operators.sampling import hash_sample
from fleetpulse.plans.prefix import exact_percentiles
from fleetpulse.plans.tables import broadcast_if_small, materialize


def with_point(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``_x``, the features as finite doubles; null, NaN and infinite ones count as 0, and -0.0 as 0.0."""
    value = lambda f: F.col(f).cast("double")
    finite = lambda f: value(f).isNotNull() & ~F.isnan(value(f)) & (F.abs(value(f)) < F.lit(1e150))
    return df.withColumn("_x", F.array(*[F.when(finite(f), value(f) + F.lit(0.0)).otherwise(F.lit(0.0)) for f in features]))


def different_points(df: DataFrame, tag: str) -> DataFrame:
    """(_id, _x, _n): every different point once, with a number of its own and how many rows lie on it."""
    counted = df.groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    numbered = materialize(counted.withColumn("_id", F.monotonically_increasing_id()), tag)
    return numbered.select("_id", "_x", "_n")


def density(found: DataFrame, reach: DataFrame) -> DataFrame:
    """(_q, _density): inverse of the mean reachability distance of the neighbours."""
    far = F.greatest("_d", "_reach") * F.col("_n")
    return found.join(reach, "_o").groupBy("_q").agg((1 / (F.sum(far) / F.sum("_n") + F.lit(1e-10))).alias("_density"))


def factor(found: DataFrame, own: DataFrame, densities: DataFrame) -> DataFrame:
    """(_q, lof): mean density of the neighbours over the own one."""
    around = found.join(densities.select(F.col("_q").alias("_o"), F.col("_density").alias("_near")), "_o")
    mean = around.groupBy("_q").agg((F.sum(F.col("_near") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    return mean.join(own, "_q").select("_q", (F.col("_mean") / F.col("_density")).alias("lof"))


@dataclass
class LocalOutlierFactor:
    """Different training points and their cells, the distance to their k-th neighbour and their densities, all as written tables."""

    points: DataFrame
    cells: Cells | None
    reach: DataFrame
    densities: DataFrame
    train_scores: DataFrame
    k: int
    features: list[str]
    seed: int

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], k: int = 20, cap: int | None = None, key=("event_id",), seed: int = 42):
        """Neighbours and densities of all training rows; an optional ``cap`` fits on that many of them.

        Nothing but pivots and cell sizes passes the driver.
        """
        features = list(features)
        train = hash_sample(df, cap, key, seed) if cap else df
        points = different_points(with_point(train, features).select("_x"), "reference")
        total = points.agg(F.sum("_n")).first()[0] or 0
        k = max(1, min(k, total - 1))
        cells = Cells.of(points, seed)
        found = materialize(nearest(points, points, k, alone=True, seed=seed, cells=cells), "neighbours")
        reach = materialize(found.groupBy("_q").agg(F.max("_d").alias("_reach")).withColumnRenamed("_q", "_o"), "reach")
        densities = materialize(density(found, reach), "densities")
        own = factor(found, densities, densities).join(points.select(F.col("_id").alias("_q"), "_n"), "_q")
        scores = materialize(own.select("lof", "_n"), "factors")
        return LocalOutlierFactor(points, cells, reach, densities, scores, k, features, seed)

    def score(self, df: DataFrame, out: str = "lof") -> DataFrame:
        """Add the factor: mean density of the nearest training rows over the row's own density; null without training rows."""
        asked = with_point(df, self.features)
        queries = different_points(asked.select("_x"), "queries")
        found = materialize(nearest(queries, self.points, self.k, seed=self.seed, cells=self.cells), "neighbours")
        scored = factor(found, density(found, self.reach), self.densities)
        labelled = materialize(queries.join(scored.withColumnRenamed("_q", "_id"), "_id").select("_x", F.col("lof").alias("_lof")), "scored")
        kept = [c for c in df.columns if c != out]
        return asked.join(broadcast_if_small(labelled), "_x", "left").select(*[F.col(f"`{c}`") for c in kept], F.col("_lof").alias(out))

    def threshold(self, contamination: float) -> DataFrame:
        """One row ``lof_threshold``: the factor that leaves ``contamination`` of the training rows above it."""
        return exact_percentiles(self.train_scores, [], "lof", {"lof_threshold": 1.0 - contamination}, weight="_n")
