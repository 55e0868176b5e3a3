"""Decision trees as flat arrays that column expressions or whole Arrow batches walk: no Python runs per row."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Nothing a cleaned feature holds lies above it, so a leaf always steps to itself.
TOP = 1e300


@dataclass(frozen=True)
class FlatTrees:
    """Nodes of all trees in one numbering where a right child follows its left sibling.

    A step from node ``i`` goes to ``child[i]``, or one further when the feature is above the cut; leaves
    step to themselves. ``depth`` steps reach a leaf from every root.
    """

    feature: tuple[int, ...]
    cut: tuple[float, ...]
    child: tuple[int, ...]
    value: tuple[float, ...]
    roots: tuple[int, ...]
    depth: int

    @staticmethod
    def of(nodes: Iterable[tuple[int, int, int, float, int, int, float]]) -> "FlatTrees":
        """From rows (tree, node, feature, cut, left, right, value); node 0 is the root, a leaf has feature -1."""
        trees: dict[int, dict[int, tuple]] = defaultdict(dict)
        for tree, node, *rest in nodes:
            trees[tree][node] = tuple(rest)
        feature, cut, child, value, roots, depth = [], [], [], [], [], 0

        def place(*found: tuple) -> None:
            for f, c, v in found:
                feature.append(f)
                cut.append(c)
                child.append(len(child))
                value.append(v)

        for _, tree in sorted(trees.items()):
            roots.append(len(child))
            level = [(0, len(child))]
            place((0, TOP, float(tree[0][4])))
            steps = 0
            while level:
                below = []
                for node, at in level:
                    f, c, left, right, _ = tree[node]
                    if f < 0:
                        continue
                    feature[at], cut[at], child[at] = int(f), float(c), len(child)
                    below += [(left, len(child)), (right, len(child) + 1)]
                    place((0, TOP, float(tree[left][4])), (0, TOP, float(tree[right][4])))
                level = below
                steps += bool(below)
            depth = max(depth, steps)
        return FlatTrees(tuple(feature), tuple(cut), tuple(child), tuple(value), tuple(roots), depth)

    def total(self, x: Column) -> Column:
        """Sum over the trees of the value of the leaf that the array ``x`` of cleaned features reaches."""
        feature, cut, child, value = constant(self.feature, "int"), constant(self.cut, "double"), constant(self.child, "int"), constant(self.value, "double")
        levels = F.sequence(F.lit(1), F.lit(self.depth)) if self.depth else F.array().cast("array<int>")
        step = lambda at, _: child[at] + F.when(x[feature[at]] <= cut[at], F.lit(0)).otherwise(F.lit(1))
        leaf = lambda root: F.aggregate(levels, root, step)
        return F.aggregate(constant(self.roots, "int"), F.lit(0.0), lambda upto, root: upto + value[leaf(root)])

    def batched(self, spark: SparkSession):
        """Arrow UDF over the cleaned features: the same sum as ``total``, added in the same order."""
        arrays = (np.array(self.feature, np.int64), np.array(self.cut, float), np.array(self.child, np.int64), np.array(self.value, float))
        shared = spark.sparkContext.broadcast((arrays, self.roots, self.depth))

        @F.pandas_udf("double")
        def total(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                yield pd.Series(walk(np.stack([c.to_numpy(float) for c in columns]), *shared.value))

        return total


def walk(x: np.ndarray, arrays: tuple[np.ndarray, ...], roots: Sequence[int], depth: int, block: int = 8192) -> np.ndarray:
    """Sum over the trees of the leaf values of points, given as one line per feature; all points of a block step at once."""
    feature, cut, child, value = arrays
    out = np.zeros(x.shape[1])
    for lo in range(0, x.shape[1], block):
        part = np.ascontiguousarray(x[:, lo : lo + block])
        n, points = part.shape[1], part.reshape(-1)
        place, sums, line = np.arange(n), out[lo : lo + n], feature * n
        for root in roots:
            at = np.full(n, root, np.int64)
            for _ in range(depth):
                at = child.take(at) + (points.take(line.take(at) + place) > cut.take(at))
            sums += value.take(at)
    return out


def constant(values: Sequence, kind: str) -> Column:
    """A constant array that the optimizer folds into one literal."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    text = ",".join(repr(v) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{kind}>")


def cleaned_columns(features: Sequence[str]) -> list[Column]:
    """Features as finite doubles; null and NaN count as 0."""
    value = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
    return [F.greatest(F.least(value(f), F.lit(TOP / 10)), F.lit(-TOP / 10)) for f in features]


def cleaned(features: Sequence[str]) -> Column:
    """Features as an array of finite doubles; null and NaN count as 0."""
    return F.array(*cleaned_columns(features))


def with_features(features: Sequence[str], body) -> Column:
    """``body`` of the cleaned features, which are put together once per row."""
    return F.transform(F.array(cleaned(features)), body)[0]
