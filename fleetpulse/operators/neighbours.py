"""Exact nearest-neighbour join over Voronoi cells, with distance bounds instead of a sample or a cross join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.plans.tables import materialize

# Pivots are drawn from the reference points: about one for CELL_POINTS of them, at most PIVOTS.
CELL_POINTS = 1000
PIVOTS = 16_384
# A task compares at most about so many queries with so many points, whatever a cell holds.
BLOCK = 4096
# Pairs compared at once, which fit a core's cache, and rows of them at least.
DIFFERENCES = 262_144
STEP = 128
# A visit to another cell costs about as much as to compare so many more points.
VISIT = 500
# Where bounds spare little, all pairs are compared in blocks of at most so many rows, in about so many tasks if blocks are smaller.
WIDE_BLOCK = 32_768
PAIRS = 64
# Queries whose bounds tell which of both ways is cheaper.
PROBES = 2_048
FOUND = "_q bigint, _o bigint, _d double, _n bigint"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed in the order of the columns."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(out)


def draw_pivots(points: DataFrame, seed: int) -> np.ndarray:
    """A bounded hash sample of the points, far fewer than they are."""
    total = points.count()
    wanted = int(min(PIVOTS, max(1, -(-total // CELL_POINTS))))
    share = min(1.0, 2.0 * wanted / max(total, 1))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 40))
    rows = points.where(drawn < int(share * (1 << 40)) + 1).orderBy(drawn, "_id").limit(wanted).select("_x").collect()
    rows = rows or points.orderBy("_id").limit(1).select("_x").collect()
    return np.array([r["_x"] for r in rows], dtype=float)


def steps(rows: int, others: int) -> Iterator[slice]:
    """Slices of rows that are compared with ``others`` at once."""
    step = max(STEP, DIFFERENCES // max(others, 1))
    return (slice(lo, lo + step) for lo in range(0, rows, step))


@lru_cache(maxsize=4)
def room(kind: type, size: int) -> np.ndarray:
    """Memory that a worker uses again for every step: fresh pages cost more than the sums."""
    return np.empty(size, kind)


def in_cells(points: DataFrame, pivots: Broadcast) -> DataFrame:
    """Add ``_cell``, the nearest pivot, and ``_away``, the distance to it."""
    schema = T.StructType([*points.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_away", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.value
        numbers, once = np.arange(len(centres)), np.ones(len(centres), dtype=np.int64)
        for batch in batches:
            x, cells, away = matrix(batch.column("_x")), [], []
            for part in steps(len(x), len(centres)):
                _, at, d = best_of(x[part], centres, numbers, once, 1)
                cells.append(at)
                away.append(d)
            columns = [pa.array(np.concatenate(cells).astype(np.int32)) if cells else pa.array([], pa.int32()), pa.array(np.concatenate(away) if away else np.zeros(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_cell", "_away"])

    return points.mapInArrow(run, schema)


def places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a table with few hits: eight places are looked at together."""
    flat = hit.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    word, byte = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    at = np.concatenate([words[word] * 8 + byte, whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, hit.shape[1])


def candidates(a: np.ndarray, b: np.ndarray, wanted: int, hidden: tuple | None, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of a, rows of b) among which are the ``wanted`` nearest of every row, ties included; the ``hidden`` pairs count as
    infinitely far. Pairs farther than ``reach`` of their row may be left out.

    Squared distances come from one matrix product. Its rounding error is bounded by the norms, and no pair is left out
    that could be among the nearest within that bound.
    """
    if len(b) <= 2 * wanted:
        both = np.ones((len(a), len(b)), dtype=bool)
        if hidden is not None:
            both[hidden] = False
        return np.nonzero(both)
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    kind = np.float32 if max(np.abs(a).max(initial=0.0), np.abs(b).max()) < 1e15 else np.float64
    slack = 4 * (a.shape[1] + 8) * float(np.finfo(kind).eps)
    size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    left = np.hstack([a, np.ones((len(a), 1))]).astype(kind)
    pairs = len(a) * len(b)
    space = lambda k: room(k, max(DIFFERENCES, pairs))[:pairs].reshape(len(a), len(b))
    product = lambda last: np.matmul(left, np.vstack([-2.0 * b.T, last]).astype(kind), out=space(kind))
    within = lambda values, limit: np.less_equal(values, np.nextafter(limit.astype(kind), kind(np.inf))[:, None], out=space(np.bool_))
    if reach is not None and np.isfinite(reach).all():
        # At most the squared distance less size_a * (1 - slack).
        limit = reach * reach - size_a
        hit = within(product(size_b * (1 - slack)), limit + slack * size_a + 1e-12 * (np.abs(limit) + reach * reach) + 1e-36)
        if hidden is not None:
            hit[hidden] = False
        # Where far more points lie within reach, the nearest are told by their distances.
        if np.count_nonzero(hit) <= 4 * wanted * len(a):
            return places(hit)
    # At least the squared distance less size_a * (1 + slack), and at most 2 * slack * (size_a + size_b) above it.
    upper = product(size_b * (1 + slack))
    if hidden is not None:
        upper[hidden] = np.inf
    # The wanted-th smallest minimum of groups of columns is no smaller than the wanted-th smallest column.
    least = upper
    while (half := least.shape[1] // 2) >= 4 * wanted:
        least = np.minimum(least[:, :half], least[:, half : 2 * half])
    limit = np.partition(least, wanted - 1, axis=1)[:, wanted - 1].astype(float)
    if reach is not None:
        limit = np.minimum(limit, reach * reach * (1 + 1e-12) - size_a * (1 + slack))
    limit += 2 * slack * size_a + 1e-12 * np.abs(limit + size_a) + 1e-36
    upper -= (2 * slack * size_b).astype(kind)
    hit = within(upper, limit)
    if hidden is not None:
        hit[hidden] = False
    return places(hit)


def best_of(a: np.ndarray, b: np.ndarray, ids: np.ndarray, counts: np.ndarray, k: int, hidden: tuple | None = None, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, distances): the nearest of every row that together stand for ``k``, ties by id; none farther than ``reach``."""
    rows, at = candidates(a, b, min(k, len(b)), hidden, reach)
    d = np.zeros(len(rows))
    for i in range(a.shape[1]):
        d += (a[rows, i] - b[at, i]) ** 2
    d = np.sqrt(d)
    if reach is not None:
        near = d <= reach[rows]
        rows, at, d = rows[near], at[near], d[near]
    order = np.lexsort((ids[at], d, rows))
    rows, at, d = rows[order], at[order], d[order]
    upto = np.cumsum(counts[at]) - counts[at]
    kept = upto - upto[np.searchsorted(rows, rows)] < k
    return rows[kept], at[kept], d[kept]


def compare_groups(left: DataFrame, right: DataFrame, on_left: list[str], on_right: list[str], k: int, alone: bool) -> DataFrame:
    """(_q, _o, _d, _n) of queries (_q, _qx, _reach) and points (_id, _x, _n) that meet in a group; no group outgrows a task."""

    def compare(queries: pa.Table, others: pa.Table) -> pa.Table:
        found = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)], [np.zeros(0, dtype=np.int64)]]
        if len(queries) and len(others):
            column = lambda table, name: table.column(name).combine_chunks()
            others = others.sort_by("_id")
            ids, counts, q, reach = (column(t, n).to_numpy(zero_copy_only=False) for t, n in ((others, "_id"), (others, "_n"), (queries, "_q"), (queries, "_reach")))
            reach = None if np.isnan(reach).all() else np.where(np.isnan(reach), np.inf, reach)
            a, b = matrix(column(queries, "_qx")), matrix(column(others, "_x"))
            for span in steps(len(a), len(b)):
                part, hidden = q[span], None
                if alone:
                    # Copies of the query itself stand one fewer.
                    itself = np.minimum(np.searchsorted(ids, part), len(ids) - 1)
                    here = np.flatnonzero((ids[itself] == part) & (counts[itself] == 1))
                    hidden = (here, itself[here])
                rows, at, d = best_of(a[span], b, ids, counts, k + alone, hidden, None if reach is None else reach[span])
                mine = counts[at] - (part[rows] == ids[at]) if alone else counts[at]
                for out, values in zip(found, (part[rows], ids[at], d, mine)):
                    out.append(values)
        return pa.table([pa.array(np.concatenate(out)) for out in found], names=["_q", "_o", "_d", "_n"])

    return left.groupBy(*on_left).cogroup(right.groupBy(*on_right)).applyInArrow(compare, FOUND)


def compare_blocks(visits: DataFrame, points: DataFrame, k: int, alone: bool) -> DataFrame:
    """(_q, _o, _d, _n): for each visit of a query to a cell, the cell's nearest points that stand for ``k``, none beyond its ``_reach`` if it has one.

    Cells are cut into blocks on both sides by their counts. With ``alone`` a point does not count itself, only its copies.
    """
    blocks = lambda name: F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(name)
    sizes = points.groupBy("_cell").agg(blocks("_points")).join(visits.groupBy("_cell").agg(blocks("_queries")), "_cell")
    sizes = F.broadcast(materialize(sizes, "cells"))  # at most one row per pivot
    deal = lambda df, own, other: df.join(sizes, "_cell").withColumns(
        {f"_b{own}": F.pmod(F.xxhash64("_id"), F.col(own)).cast("int"), f"_b{other}": F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
    )
    keys = ["_cell", "_b_points", "_b_queries"]
    # The two sides may be one table: the queries' columns get names of their own.
    asking = ["_at", "_with", "_as"]
    reach = F.col("_reach") if "_reach" in visits.columns else F.lit(None).cast("double")
    left = deal(visits, "_queries", "_points").select(*keys, "_id", "_x", reach).toDF(*asking, "_q", "_qx", "_reach")
    right = deal(points, "_points", "_queries").select(*keys, "_id", "_x", "_n")
    return compare_groups(left, right, asking, keys, k, alone)


def compare_all(queries: DataFrame, points: DataFrame, k: int, alone: bool) -> DataFrame:
    """(_q, _o, _d, _n): like ``compare_blocks`` for every block of queries with every block of points."""
    asked, held = queries.count(), points.count()
    size = min(WIDE_BLOCK, max(BLOCK, math.isqrt(asked * held // PAIRS)))
    blocks, others = (max(1, -(-n // size)) for n in (asked, held))
    dealt = lambda df, n, m: (F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_other"))
    left = queries.select(*dealt(queries, blocks, others), F.col("_id").alias("_q"), F.col("_x").alias("_qx"), F.lit(None).cast("double").alias("_reach")).withColumnsRenamed({"_own": "_as", "_other": "_with"})
    right = points.select(*dealt(points, others, blocks), "_id", "_x", "_n")
    return compare_groups(left, right, ["_with", "_as"], ["_own", "_other"], k, alone)


def within_bounds(queries: DataFrame, pivots: Broadcast, stats: Broadcast, k: int) -> DataFrame:
    """(_id, _x, _reach, _cell): the other cells that may hold one of the ``k`` nearest points of a query.

    No point of a cell is nearer than the distance to its pivot less the cell's radius, or than the plane between the pivots of
    both cells; the ``k`` nearest are no farther than ``_reach`` (from the own cell) or, without one, than cells that hold as many reach.
    Queries of a cell are looked at together: far cells are left out for all of them at once, so it helps if they come in order of cells.
    """

    def limits(d: np.ndarray, radius: np.ndarray, held: np.ndarray) -> np.ndarray:
        far = np.where(held > 0, d + radius, np.inf)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(held[order], axis=1) >= k + 1
        first = np.take_along_axis(far, np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1), 1)[:, 0]
        return np.where(enough.any(axis=1), first, np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, (radius, held, _) = pivots.value, stats.value
        loose = lambda limit: limit * (1 + 1e-9) + 1e-12
        for batch in batches:
            x, own = matrix(batch.column("_x")), batch.column("_cell").to_numpy(zero_copy_only=False)
            reach = batch.column("_reach").to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            runs = np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else []
            rows, cells = [], []
            for mine in (r[part] for r in runs for part in steps(len(r), len(centres))):
                cell = own[mine[0]]
                between, away = gaps(centres[cell][None, :], centres)[0], gaps(x[mine], centres[cell][None, :])[:, 0]
                limit = reach[mine].copy()
                open_ = np.isnan(limit)
                if open_.any():
                    limit[open_] = limits(gaps(x[mine[open_]], centres), radius, held)
                # The same bounds for all queries of the cell, which lie within ``away`` of its pivot.
                most = loose((away + limit).max())
                near = np.flatnonzero((held > 0) & (between <= np.fmin(most + radius, 2 * most) * (1 + 1e-9)))
                near = near[near != cell]
                d = gaps(x[mine], centres[near])
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d**2 - away[:, None] ** 2) / (2 * between[near])
                least = np.fmax(d - radius[near], np.where(between[near] > 0, plane, 0.0))
                r, c = np.nonzero(least <= loose(limit)[:, None])
                rows.append(mine[r])
                cells.append(near[c])
            taken = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
            part = batch.select(["_id", "_x", "_reach"]).take(pa.array(taken))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array((np.concatenate(cells) if cells else np.zeros(0)).astype(np.int32))], ["_id", "_x", "_reach", "_cell"])

    return queries.select("_id", "_x", "_cell", "_reach").mapInArrow(run, "_id bigint, _x array<double>, _reach double, _cell int")


def cells_pay(reached: DataFrame, points: DataFrame, pivots: Broadcast, stats: Broadcast, k: int, seed: int) -> bool:
    """Whether visits to cells cost less than all pairs, told by the bounds of about ``PROBES`` queries.

    A visit costs about as much as to compare ``VISIT`` more points, which a row of its own and its findings make up.
    """
    total = reached.count()
    share = F.pmod(F.xxhash64(F.lit(seed), F.lit("probe"), "_id"), F.lit(1 << 30)) < int(min(1.0, PROBES / max(total, 1)) * (1 << 30)) + 1
    probes = materialize(reached.where(share), "probes")
    visits = within_bounds(probes, pivots, stats, k).groupBy("_cell").count().collect()  # one row per pivot
    cost = sum(v["count"] * (VISIT + int(stats.value[2][v["_cell"]])) for v in visits)
    return cost <= probes.count() * points.count()


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The nearest points of every query that stand for exactly ``k``; ties go to the smaller id."""
    upto = "sum(_n) OVER (PARTITION BY _q ORDER BY _d, _o ROWS UNBOUNDED PRECEDING) - _n"
    return found.where("_n > 0").selectExpr("*", f"{upto} AS _before").where(F.col("_before") < k).withColumn("_n", F.least("_n", F.lit(k) - F.col("_before"))).drop("_before")


@dataclass
class Cells:
    """Reference points dealt to their pivots, with the radius, the rows and the different points of every cell."""

    points: DataFrame
    pivots: Broadcast
    stats: Broadcast

    @staticmethod
    def of(reference: DataFrame, seed: int = 42) -> "Cells | None":
        """None without points. Only pivots and three numbers of each pass the driver."""
        sc = reference.sparkSession.sparkContext
        pivots = sc.broadcast(draw_pivots(reference, seed))
        if not len(pivots.value):
            return None
        points = materialize(in_cells(reference, pivots), "points")
        cells = points.groupBy("_cell").agg(F.max("_away").alias("radius"), F.sum("_n").alias("held"), F.count(F.lit(1)).alias("points")).collect()  # one row per pivot
        radius, held, sizes = np.zeros(len(pivots.value)), np.zeros(len(pivots.value), dtype=np.int64), np.zeros(len(pivots.value), dtype=np.int64)
        for c in cells:
            radius[c["_cell"]], held[c["_cell"]], sizes[c["_cell"]] = c["radius"], c["held"], c["points"]
        return Cells(points, pivots, sc.broadcast((radius, held, sizes)))


def nearest(queries: DataFrame, reference: DataFrame, k: int, alone: bool = False, seed: int = 42, cells: Cells | None = None) -> DataFrame:
    """(_q, _o, _d, _n): the ``k`` nearest reference points of every query, equal points as one row that stands for ``_n``.

    ``queries`` has (_id, _x), ``reference`` (_id, _x, _n) with different points; both are written tables with arrays of
    finite doubles of one length. With ``alone`` the queries are the reference points and none is its own neighbour. Two rounds:
    the own cell gives a first reach, then the cells within bounds; the results are merged. Where the bounds spare too little,
    as among many independent features, all pairs are compared in large blocks instead: both ways are exact. ``cells`` are those of
    the reference points, where they have been made before.
    """
    cells = cells or Cells.of(reference, seed)
    if cells is None:
        return reference.sparkSession.createDataFrame([], FOUND)
    points, pivots, stats = cells.points, cells.pivots, cells.stats
    asked = points.select("_id", "_x", "_cell", "_away") if alone else materialize(in_cells(queries.select("_id", "_x"), pivots), "asked")
    near = materialize(compare_blocks(asked, points, k, alone), "near")
    # As many as are wanted lie within the farthest found; where a cell has several blocks, that is somewhat far.
    full = near.groupBy("_q").agg(F.when(F.sum("_n") >= k, F.max("_d")).alias("_reach")).withColumnRenamed("_q", "_id")
    reached = asked.join(full, "_id", "left").select("_id", "_x", "_cell", "_reach")
    reached = materialize(reached.sortWithinPartitions("_cell"), "reached")
    if not cells_pay(reached, points, pivots, stats, k, seed):
        return first_k(compare_all(asked, points, k, alone), k)
    visits = materialize(within_bounds(reached, pivots, stats, k), "visits")
    return first_k(near.unionByName(compare_blocks(visits, points, k, False)), k)
