"""Isolation forest: trees are grown in parallel from hash samples, rows walk them in column expressions.

The score is that of the published method: ``2 ** (-E[path length] / c(sample size))``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators.trees import FlatTrees, cleaned_columns, with_features
from fleetpulse.plans.prefix import exact_percentiles
from fleetpulse.plans.tables import materialize

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"
EULER_GAMMA = 0.5772156649015329


def expected_path(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def grow_tree(tree: int, points: np.ndarray, seed: int) -> list[tuple]:
    """Split at random features and values until points are alone or the height limit is reached."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[list] = []
    todo = [(points, 0, None)]
    while todo:
        rows, depth, parent = todo.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent[0]][parent[1]] = me
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([tree, me, -1, 0.0, me, me, depth + expected_path(len(rows))])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        side = rows[:, f] <= cut
        nodes.append([tree, me, f, cut, -1, -1, 0.0])
        todo.append((rows[~side], depth + 1, (me, 5)))
        todo.append((rows[side], depth + 1, (me, 4)))
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForest:
    """A grown forest: the node table, its features and the number of points per tree."""

    nodes: DataFrame
    features: list[str]
    trees: int
    sample_size: int

    @staticmethod
    def fit(
        df: DataFrame,
        features: Sequence[str],
        trees: int = 100,
        max_samples: int = 256,
        seed: int = 42,
        key: Sequence[str] = ("event_id",),
    ) -> "IsolationForest":
        """Grow ``trees`` trees from at most ``max_samples`` rows each.

        A row enters tree t when its hash for t falls under a rate that gives each tree about half again
        as many rows as it needs; the smallest hashes win. One pass over the data, and only the
        sampled rows (trees x max_samples x 1.5 of them) are shuffled.
        """
        features = list(features)
        total = df.count()
        size = min(max_samples, total)
        rate = min(1.0, 1.5 * (max_samples + 64) / max(total, 1))
        scale = 1 << 40
        member = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, *key), F.lit(scale))
        expand = rate * trees
        rows = df.select(*key, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
        # Where few rows are wanted they are thinned once before single trees look at them.
        keep = min(1.0, 2.0 * expand)
        thin = F.pmod(F.xxhash64(F.lit(seed), F.lit("thin"), *key), F.lit(scale))
        rows = rows.where(thin < F.lit(int(keep * scale)))
        rate = min(1.0, rate / keep) if keep else 1.0
        picked = (
            rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
            .withColumn("_h", member(F.col("tree")))
            .where(F.col("_h") < F.lit(int(rate * scale)))
        )

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            best = pdf.sort_values(["_h", *key], kind="stable").head(size)
            out = grow_tree(int(pdf["tree"].iloc[0]), best[features].to_numpy(float), seed)
            return pd.DataFrame(out, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

        nodes = picked.groupBy("tree").applyInPandas(build, NODE_SCHEMA)
        return IsolationForest(materialize(nodes, "forest"), features, trees, size)

    def scorer(self):
        """Arrow UDF over the features. The node arrays hold at most trees x 2 x max_samples entries."""
        pdf = self.nodes.toPandas().sort_values(["tree", "node"])
        size = self.sample_size
        start = pdf.groupby("tree").size().cumsum().shift(fill_value=0)
        base = pdf["tree"].map(start).to_numpy()
        packed = (
            pdf["feature"].to_numpy(np.int32),
            pdf["threshold"].to_numpy(float),
            (pdf["left"].to_numpy() + base).astype(np.int32),
            (pdf["right"].to_numpy() + base).astype(np.int32),
            pdf["path"].to_numpy(float),
            start.to_numpy(np.int32),
        )
        shared = self.nodes.sparkSession.sparkContext.broadcast(packed)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            forest = shared.value
            for batch in batches:
                yield pd.Series(score_points(batch.fillna(0.0).to_numpy(float), forest, size))

        return score

    def flat(self) -> FlatTrees:
        """The node arrays: at most trees x 2 x max_samples entries."""
        rows = self.nodes.select("tree", "node", "feature", "threshold", "left", "right", "path").collect()
        return FlatTrees.of(map(tuple, rows))

    def scored(self, df: DataFrame, out: str, flat: FlatTrees, total: Column) -> DataFrame:
        norm = max(expected_path(self.sample_size), 1e-12) * max(len(flat.roots), 1)
        return df.withColumn(out, F.pow(F.lit(2.0), -total / F.lit(norm)))

    def score(self, df: DataFrame, out: str = "iso_score") -> DataFrame:
        """Add the isolation score, in (0, 1), higher is worse; null and NaN features count as 0.

        Arrow batches walk the trees level by level; ``score_in_plan`` gives the same values without Python.
        """
        flat = self.flat()
        return self.scored(df, out, flat, flat.batched(self.nodes.sparkSession)(*cleaned_columns(self.features)))

    def score_in_plan(self, df: DataFrame, out: str = "iso_score") -> DataFrame:
        """Like ``score``, the node arrays as part of the plan: no Python worker, but far slower for many rows."""
        flat = self.flat()
        return self.scored(df, out, flat, with_features(self.features, flat.total))

    def register(self, name: str = "isolation_score") -> None:
        """Make the scorer callable from SQL on a struct of the features, in their order."""
        self.nodes.sparkSession.udf.register(name, self.scorer())

    def threshold(self, scored_train: DataFrame, contamination: float, score: str = "iso_score") -> DataFrame:
        """One row ``iso_threshold``: the score that leaves ``contamination`` of the training rows above it."""
        # Ranks read the scores more than once: they are written first.
        return exact_percentiles(materialize(scored_train.select(score), "scores"), [], score, {"iso_threshold": 1.0 - contamination})

    def save(self, path: str) -> None:
        """Write the forest as Parquet, its settings on every row."""
        self.nodes.withColumns(
            {
                "features": F.array(*[F.lit(f) for f in self.features]),
                "trees": F.lit(self.trees),
                "sample_size": F.lit(self.sample_size),
            }
        ).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        table = spark.read.parquet(path)
        head = table.select("features", "trees", "sample_size").first()
        return IsolationForest(
            table.drop("features", "trees", "sample_size"), list(head["features"]), head["trees"], head["sample_size"]
        )


def score_points(points: np.ndarray, forest: tuple, size: int, block: int = 4096) -> np.ndarray:
    """Walk a block of points down every tree at once."""
    feature, cut, left, right, path, roots = forest
    out = np.empty(len(points))
    norm = max(expected_path(size), 1e-12)
    for lo in range(0, len(points), block):
        rows = points[lo : lo + block]
        at = np.tile(roots, (len(rows), 1))
        pick = np.arange(len(rows))[:, None]
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = rows[pick, np.maximum(f, 0)] <= cut[at]
            at = np.where(go_left, left[at], right[at])
        out[lo : lo + block] = 2.0 ** (-path[at].mean(axis=1) / norm)
    return out


def flag_over(df: DataFrame, threshold: DataFrame, score: str = "iso_score", out: str = "iso_is_anomaly", column: str = "iso_threshold") -> DataFrame:
    """Add ``out``: 1 where the score exceeds the threshold of a one-row table."""
    return df.crossJoin(F.broadcast(threshold)).withColumn(out, (F.col(score) > F.col(column)).cast("int")).drop(column)


