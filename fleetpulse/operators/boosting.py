"""Gradient boosting with softmax loss: one model for all causes, grown from histograms.

Features are cut into bins once. Every level of every tree of a round is one job: tasks add up the first and second
derivatives of the loss per class, node, feature and bin, the sums of all tasks are combined, and the best splits are
read off them. Only these sums, whose number the settings bound, reach the driver. Derivatives are summed as whole
numbers, so the model does not depend on partitioning or on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators.trees import FlatTrees, with_features
from fleetpulse.plans.tables import materialize

SCALE = float(1 << 24)
BINS = 64
# Margins are written again after so many rounds; until then tasks add up the trees since.
ROUNDS_KEPT = 10
NODE_SCHEMA = "class int, tree int, node int, feature int, cut double, left int, right int, value double"


@dataclass
class Tree:
    """A growing tree over bins, nodes numbered as they come; ``at`` of a leaf is -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def walk(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left = (np.array(x) for x in (self.feature, self.bin, self.left))
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(f, 0)] > cut[at]
            at = np.where(inner, left[at] + right, at)

    def split(self, node: int, feature: int, at: int, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.feature)
        for v in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(v)
        return self.left[node], self.left[node] + 1


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(margins: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted loss as whole numbers, one column per class."""
    p = softmax(margins)
    hit = y[:, None] == np.arange(margins.shape[1])[None, :]
    g = (p - hit) * w[:, None]
    h = np.maximum(2.0 * p * (1.0 - p), 1e-16) * w[:, None]
    return np.rint(g * SCALE), np.rint(h * SCALE)


def best_split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[int, int, np.ndarray] | None:
    """(feature, bin, [[G, H] left, right]) of the largest gain over (feature, bin) sums; ties go to the first."""
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    total_g, total_h = g[0].sum(), h[0].sum()
    gr, hr = total_g - gl, total_h - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
    gain = np.where((hl >= least) & (hr >= least), gain, 0.0)
    if gain.size == 0 or gain.max() <= 1e-6:
        return None
    f, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return int(f), int(at), np.array([[gl[f, at], hl[f, at]], [gr[f, at], hr[f, at]]])


def feature_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Ascending cut points per feature: quantiles within a quarter of a bin; a value up to a cut lies left of it."""
    found = df.approxQuantile(list(features), [i / bins for i in range(1, bins)], 0.25 / bins)
    return [sorted(set(map(float, c))) for c in found]


@dataclass
class SoftmaxBoosting:
    """Fitted trees as rows (class, tree, node, feature, cut, left, right, value), classes in alphabetical order."""

    nodes: list[tuple]
    classes: list[str]
    features: list[str]

    @staticmethod
    def fit(
        df: DataFrame,
        features: Sequence[str],
        cause: str = "cause",
        weight: str | None = None,
        rounds: int = 150,
        depth: int = 6,
        step: float = 0.1,
        bins: int = BINS,
        ridge: float = 1.0,
        least: float = 1.0,
        cuts: list[list[float]] | None = None,
    ) -> "SoftmaxBoosting":
        """Grow ``rounds`` trees per class. Null and NaN features count as 0, null weights as 1; rows without a cause are left out."""
        features = list(features)
        value = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f)
        named = F.col(cause).cast("string")
        data = df.where(named.isNotNull()).select(*map(value, features), named.alias("_cause"), (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("_w"))
        data = materialize(data, "training")
        classes = sorted(r[0] for r in data.select("_cause").distinct().collect())  # a handful of causes
        cuts = cuts if cuts is not None else feature_cuts(data, features, bins)
        if not classes:
            raise ValueError("no rows with a cause")
        table, pending, nodes = binned(data, features, classes, cuts), [], []
        for r in range(rounds):
            trees = grow_round(table, pending, len(classes), [len(c) + 1 for c in cuts], depth, step, ridge, least)
            nodes += [(k, r, *row) for k, t in enumerate(trees) for row in node_rows(t, cuts)]
            pending.append(trees)
            if len(pending) == ROUNDS_KEPT and r + 1 < rounds:
                table, pending = materialize(advanced(table, pending, len(classes)), "margins"), []
        return SoftmaxBoosting(nodes, classes, features)

    def probabilities(self, df: DataFrame, out: str = "probs") -> DataFrame:
        """Add an array of ``struct<cause, p>``, classes in alphabetical order."""
        flat = [FlatTrees.of([n[1:] for n in self.nodes if n[0] == k]) for k in range(len(self.classes))]
        margins = with_features(self.features, lambda x: F.array(*[t.total(x) for t in flat]))

        def spread(m):
            e = F.transform(m, lambda v: F.exp(v - F.array_max(m)))
            total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
            return F.array(*[F.struct(F.lit(c).alias("cause"), (e[i] / total).alias("p")) for i, c in enumerate(self.classes)])

        return df.withColumn(out, F.transform(F.array(margins), spread)[0])

    def save(self, path: str) -> None:
        """Write the node table and its contract, one row each per node and model."""
        spark = _session()
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(self.classes, self.features)], "classes array<string>, features array<string>").write.parquet(f"{path}/contract")

    @staticmethod
    def load(path: str) -> "SoftmaxBoosting":
        spark = _session()
        row = spark.read.parquet(f"{path}/contract").first()
        return SoftmaxBoosting(sorted(map(tuple, spark.read.parquet(f"{path}/nodes").collect())), list(row["classes"]), list(row["features"]))


def _session() -> SparkSession:
    return SparkSession.getActiveSession()


def row_schema(features: int, classes: int) -> str:
    return ", ".join([*[f"b{i} int" for i in range(features)], "y int", "w double", *[f"m{k} double" for k in range(classes)]])


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def binned(data: DataFrame, features: Sequence[str], classes: Sequence[str], cuts: list[list[float]]) -> DataFrame:
    """Written training table: bins, class number, weight and margins of 0."""
    place = {c: i for i, c in enumerate(classes)}
    schema = row_schema(len(features), len(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(np.searchsorted(c, batch.column(i).to_numpy(zero_copy_only=False), "left").astype(np.int32)) for i, c in enumerate(cuts)]
            columns.append(pa.array([place[c] for c in batch.column(len(cuts)).to_pylist()], pa.int32()))
            columns.append(batch.column(len(cuts) + 1))
            columns += [pa.array(np.zeros(len(batch)))] * len(classes)
            yield pa.RecordBatch.from_arrays(columns, _names(schema))

    return materialize(data.select(*features, "_cause", "_w").mapInArrow(run, schema), "binned")


def unpacked(batch: pa.RecordBatch, features: int, pending: list[list[Tree]]) -> tuple[np.ndarray, ...]:
    """(bins, class, weight, margins) of a batch, with the trees since the margins were written."""
    values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    bins, margins = np.stack(values[:features], axis=1), np.stack(values[features + 2 :], axis=1)
    for trees in pending:
        for k, tree in enumerate(trees):
            margins[:, k] += np.array(tree.value)[tree.walk(bins)]
    return bins, values[features], values[features + 1], margins


def advanced(table: DataFrame, pending: list[list[Tree]], classes: int) -> DataFrame:
    """The training table with the trees since added to its margins."""
    features = len(table.columns) - 2 - classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = unpacked(batch, features, pending)[3]
            yield pa.RecordBatch.from_arrays([*batch.columns[: features + 2], *[pa.array(margins[:, k]) for k in range(classes)]], batch.schema.names)

    return table.mapInArrow(run, table.schema)


def histograms(table: DataFrame, pending: list[list[Tree]], trees: list[Tree], open_nodes: list[list[int]], sizes: list[int]) -> dict[tuple[int, int], np.ndarray]:
    """Sums [[G], [H]] per feature and bin of each (class, open node), over all rows: one job."""
    features, width = len(sizes), max(sizes)
    slots = [(k, node) for k, nodes in enumerate(open_nodes) for node in nodes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(slots), features, width))
        for batch in batches:
            bins, y, w, margins = unpacked(batch, features, pending)
            both = derivatives(margins, y, w)
            for k, tree in enumerate(trees):
                mine = [s for s, (c, _) in enumerate(slots) if c == k]
                if not mine:
                    continue
                slot_of = np.full(len(tree.feature), -1)
                slot_of[[slots[s][1] for s in mine]] = mine
                slot = slot_of[tree.walk(bins)]
                rows = np.flatnonzero(slot >= 0)
                for f in range(features):
                    cell = slot[rows] * width + bins[rows, f]
                    for i, d in enumerate(both):
                        sums[i, :, f] += np.bincount(cell, weights=d[rows, k], minlength=len(slots) * width).reshape(len(slots), width)
        cell = np.flatnonzero(sums[1].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(cell), *[pa.array(s.reshape(-1)[cell].astype(np.int64)) for s in sums]], ["cell", "g", "h"])

    parts = table.mapInArrow(run, "cell bigint, g bigint, h bigint")
    found = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # slots x features x bins at most
    sums = np.zeros((2, len(slots) * features * width))
    sums[0, found["cell"]], sums[1, found["cell"]] = found["g"], found["h"]
    sums = sums.reshape(2, len(slots), features, width) / SCALE
    return {slot: sums[:, i] for i, slot in enumerate(slots)}


def grow_round(table: DataFrame, pending: list[list[Tree]], classes: int, sizes: list[int], depth: int, step: float, ridge: float, least: float) -> list[Tree]:
    """One tree per class, all grown level by level together."""
    trees = [Tree() for _ in range(classes)]
    open_nodes = [[0] for _ in range(classes)]
    for level in range(depth):
        sums = histograms(table, pending, trees, open_nodes, sizes)
        below = [[] for _ in range(classes)]
        for (k, node), (g, h) in sums.items():
            if level == 0:
                trees[k].value[0] = step * -g[0].sum() / (h[0].sum() + ridge)
            found = best_split(g, h, ridge, least)
            if found:
                feature, at, sides = found
                below[k] += trees[k].split(node, feature, at, tuple(float(step * -gg / (hh + ridge)) for gg, hh in sides))
        open_nodes = below
        if not any(open_nodes):
            break
    return trees


def node_rows(tree: Tree, cuts: list[list[float]]) -> list[tuple]:
    """(node, feature, cut, left, right, value) of every node."""
    rows = []
    for i, (f, b, left, v) in enumerate(zip(tree.feature, tree.bin, tree.left, tree.value)):
        rows.append((i, f, cuts[f][b], left, left + 1, float(v)) if f >= 0 else (i, -1, 0.0, i, i, float(v)))
    return rows
