"""SimHash near-duplicates through vantage-point trees.

Documents get a 64-bit fingerprint. Distinct fingerprints are dealt to shards by their Hamming distance to
vantage points: a shard is a leaf of a vantage-point tree, and a fingerprint outside a ball that lies within the
radius of its boundary is also sent inside, so that every pair within the radius meets in one shard. Each
shard grows its own tree, prunes by the same triangle bound and returns a spanning forest of its links,
never all pairs. The forests are joined by connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import attach, with_runs
from fleetpulse.llm.graph import components
from fleetpulse.plans.tables import materialize

RADIUS = 2
# A shard with more fingerprints is split further; trees are fitted on at most SAMPLE fingerprints a round.
SHARD_ROWS = 131_072
SAMPLE = 131_072
SPLIT_LEAST = 32
# Below this many fingerprints a node of the in-shard tree compares all of them.
LEAF_ROWS = 1024
BLOCK = 65_536
NO_ID = (1 << 63) - 1
RUNS = 256


def shingles(text: bytes, width: int) -> list[bytes]:
    """Word shingles of a text, A-Z lower-cased, repeats included; a shorter text is one shingle."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    return [joined[s:e] for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())]


def hashes(parts: list[bytes]) -> np.ndarray:
    """XXH64 (seed 42) of each part."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(x, 42) for x in parts]), dtype=">u8")


def majority(values: np.ndarray) -> int:
    """64-bit number whose bits are set in over half of ``values``; 0 without values."""
    n = len(values)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255 * 256):
        part = values[at : at + 255 * 256].astype(">u8").view(np.uint8)
        part = np.concatenate([part, np.zeros(-len(part) % (255 * 8), dtype=np.uint8)])
        bits = np.unpackbits(part).reshape(-1, 255, 64)
        counts += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big") if n else 0


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, id_type: str = "bigint") -> DataFrame:
    """(_id, _fp) of every row; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                parts = shingles(text.as_buffer().to_pybytes(), width) if text.is_valid else []
                found.append(signed(majority(hashes(parts))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["_id", "_fp"])

    plain = docs.select(F.col(id_col).cast(id_type).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return plain.mapInArrow(run, f"_id {id_type}, _fp bigint")


def best_split(distances: np.ndarray, radius: int) -> tuple[int, float]:
    """Ball size with the least pairs left to compare, and their share of all pairs."""
    n = len(distances)
    upto = np.cumsum(np.bincount(distances, minlength=65)).astype(float)
    inside = np.concatenate([upto[radius:], np.full(radius, upto[-1])])
    cost = (inside**2 + (n - upto) ** 2) / n**2
    at = int(np.argmin(cost))
    return at, float(cost[at])


def spanning(near: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Components of ``rows`` as (root, other members); every row is compared with unreached rows only."""
    found = []
    while len(rows) > 1:
        root, rows = rows[0], rows[1:]
        frontier, members = np.array([root]), []
        while len(frontier) and len(rows):
            hit = np.zeros(len(rows), dtype=bool)
            for at in range(0, len(frontier), 64):
                left = np.flatnonzero(~hit)
                hit[left] = near(frontier[at : at + 64], rows[left])
            frontier, rows = rows[hit], rows[~hit]
            members.append(frontier)
        if members and sum(map(len, members)):
            found.append((int(root), np.concatenate(members)))
    return found


def vp_links(fps: np.ndarray, radius: int, seed: int = 1) -> list[tuple[int, np.ndarray]]:
    """Groups (root, members) whose union has the components of all pairs within ``radius``."""
    rng = np.random.default_rng(seed)
    near = lambda some, rest: (np.bitwise_count(fps[some][:, None] ^ fps[rest][None, :]) <= radius).any(axis=0)
    found, todo = [], [np.arange(len(fps))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF_ROWS:
            if len(rows) > 1:
                part = fps[rows]
                linked = (np.bitwise_count(part[:, None] ^ part[None, :]) <= radius).sum(axis=1) > 1
                found += spanning(near, rows[linked])
            continue
        distances = np.bitwise_count(fps[rows] ^ fps[rows[rng.integers(len(rows))]])
        ball, cost = best_split(distances, radius)
        if cost > 0.95:
            found += spanning(near, rows)
        else:
            todo += [rows[distances <= ball + radius], rows[distances > ball]]
    return found


def fit_tree(sample: np.ndarray, scale: float, cap: int, radius: int, new_leaf: Callable[[], int], rng) -> tuple | int:
    """Tree over a sample whose points stand for ``scale`` fingerprints each; leaves hold about ``cap``."""
    if len(sample) * scale <= cap or len(sample) < SPLIT_LEAST:
        return new_leaf()
    point = sample[rng.integers(len(sample))]
    distances = np.bitwise_count(sample ^ point)
    ball, cost = best_split(distances, radius)
    if cost > 0.95:
        return new_leaf()
    inside = fit_tree(sample[distances <= ball + radius], scale, cap, radius, new_leaf, rng)
    return int(point), ball, inside, fit_tree(sample[distances > ball], scale, cap, radius, new_leaf, rng)


def route(tree: tuple | int, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions): every leaf that a fingerprint must visit for its pairs to meet."""
    todo = [(tree, np.arange(len(fps)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield node, rows
            continue
        point, ball, inside, outside = node
        distances = np.bitwise_count(fps[rows] ^ np.uint64(point))
        todo += [(inside, rows[distances <= ball + radius]), (outside, rows[distances > ball])]


def vantage_shards(nodes: DataFrame, radius: int, cap: int = SHARD_ROWS) -> DataFrame:
    """(_leaf, _id, _fp): distinct fingerprints in overlapping shards of about ``cap``.

    Overfull shards are split by trees fitted on bounded samples of them until none is left that a
    vantage point can split. Only samples, sizes of overfull shards and tree nodes pass the driver.
    """
    placed, final, leaves = nodes.withColumn("_leaf", F.lit(0).cast("bigint")), set(), [0]
    rng = np.random.default_rng(7)

    def new_leaf() -> int:
        leaves[0] += 1
        return leaves[0]

    while True:
        sizes = placed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).collect()
        sizes = {r["_leaf"]: r["n"] for r in sizes if r["_leaf"] not in final}
        if not sizes:
            return placed
        each = max(2 * SPLIT_LEAST, SAMPLE // len(sizes))
        limits, salt = {k: each / n for k, n in sizes.items()}, np.uint64(2 * leaves[0] + 1)

        def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                mixed = frame["_fp"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) * salt
                draw = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)) / float(1 << 53)
                yield frame[draw < frame["_leaf"].map(limits).fillna(0.0).to_numpy(float)]

        picked = placed.select("_leaf", "_fp").mapInPandas(pick, "_leaf bigint, _fp bigint").toPandas()
        trees = {}
        for leaf, part in picked.groupby("_leaf"):
            sample = np.sort(part["_fp"].to_numpy(np.int64)).view(np.uint64)
            tree = fit_tree(sample, sizes[leaf] / len(sample), cap, radius, new_leaf, rng)
            if isinstance(tree, int):
                final.add(leaf)
            else:
                trees[int(leaf)] = tree
        final |= set(sizes) - set(trees)
        if not trees:
            return placed

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for leaf, part in frame.groupby("_leaf"):
                    if leaf not in trees:
                        yield part
                        continue
                    fps = part["_fp"].to_numpy(np.int64).view(np.uint64)
                    for to, rows in route(trees[leaf], fps, radius):
                        yield part.iloc[rows].assign(_leaf=to)

        placed = materialize(placed.select("_leaf", "_id", "_fp").mapInPandas(deal, "_leaf bigint, _id bigint, _fp bigint"), "vantage")


NODE = "struct<id:bigint,fp:bigint>"


def forest_edges(ids: np.ndarray, fps: np.ndarray, groups: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
    """Edges from each member of a group to its smallest node."""
    out = []
    for root, members in groups:
        rows = np.append(members, root)
        least = rows[np.lexsort((fps[rows], ids[rows]))[0]]
        rows = rows[rows != least]
        out.append(pd.DataFrame({"a_id": ids[rows], "a_fp": fps[rows], "b_id": ids[least], "b_fp": fps[least]}))
    columns = ["a_id", "a_fp", "b_id", "b_fp"]
    return pd.concat(out) if out else pd.DataFrame({c: np.array([], dtype=np.int64) for c in columns})


EDGE = "a_id bigint, a_fp bigint, b_id bigint, b_fp bigint"


def as_edges(pairs: DataFrame) -> DataFrame:
    node = lambda side: F.struct(F.col(f"{side}_id").alias("id"), F.col(f"{side}_fp").alias("fp")).alias(side)
    return pairs.select(node("a"), node("b"))


def hamming_links(nodes: DataFrame, radius: int, cap: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within ``radius``."""

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        ids, fps = frame["_id"].to_numpy(np.int64), frame["_fp"].to_numpy(np.int64)
        return forest_edges(ids, fps, vp_links(fps.view(np.uint64), radius))

    shards = vantage_shards(nodes, radius, cap)
    return as_edges(shards.groupBy("_leaf").applyInPandas(search, EDGE))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS, cap: int = SHARD_ROWS
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (hex) and the smallest id reachable over links.

    Two rows link when their fingerprints differ in at most ``radius`` bits. Empty and null texts share
    fingerprint 0. Null ids count as larger than all others; a component of null ids only has id null.
    Repeated rows are kept; other columns of ``docs`` are not read. Ids are integers.
    """
    rows = with_runs(fingerprints(docs, id_col, text_col, width), RUNS, "fingerprints")
    smallest = F.coalesce(F.min("_id"), F.lit(NO_ID)).alias("_id")
    nodes = materialize(rows.groupBy("_fp").agg(smallest), "nodes")
    found = components(hamming_links(nodes, radius, cap))
    moved = found.select(F.col("node.fp").alias("_fp"), F.col("root.id").alias("_root"))
    labels = nodes.join(moved, "_fp", "left").select("_fp", F.coalesce("_root", "_id").alias("_root"))
    return attach(rows, labels, ["_fp"]).select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_root") != NO_ID, F.col("_root")).alias("component_id"),
    )


def row_keys(docs: DataFrame, id_col: str, *more) -> DataFrame:
    """Id (null is the largest number) and hash of all columns of each row."""
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id")
    return docs.select(key, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *more)


def keepers(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, cap: int) -> DataFrame:
    """(_id, _row) of the row that stays of each component: the smallest id, then the smallest hash of all columns."""
    keyed = row_keys(docs, id_col, F.col(text_col).alias("_text"))
    prints = fingerprints(keyed.select(F.struct("_id", "_row").alias("_key"), "_text"), "_key", "_text", width, "struct<_id:bigint,_row:bigint>")
    nodes = materialize(prints.groupBy("_fp").agg(F.min("_id").alias("_best")), "nodes")
    found = components(hamming_links(nodes.select(F.col("_best._id").alias("_id"), "_fp"), radius, cap))
    moved = found.select(F.col("node.fp").alias("_fp"), F.col("root.fp").alias("_root"))
    rooted = nodes.join(moved, "_fp", "left").select(F.coalesce("_root", "_fp").alias("_root"), "_best")
    return rooted.groupBy("_root").agg(F.min("_best").alias("_best")).select("_best._id", "_best._row")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS, cap: int = SHARD_ROWS
) -> DataFrame:
    """One row of each component of near-duplicates, with the columns of ``docs``.

    Rows link as in ``simhash_components``; of each component the row with the smallest id stays, and one row where it is
    repeated. Null ids lose to others. All texts without words are one component. Repeated rows are combined
    before they travel, then rows meet the keepers by id and hash: the texts are shuffled once.
    """
    names = [f"`{c}`" for c in docs.columns]
    rows = row_keys(docs, id_col, F.struct(*names).alias("_doc")).dropDuplicates(["_id", "_row"])
    kept = materialize(keepers(docs, id_col, text_col, width, radius, cap), "keepers")
    return rows.join(kept, ["_id", "_row"], "left_semi").select("_doc.*")
