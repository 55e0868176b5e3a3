"""Benchmark decontamination by q-gram lemma filtering.

A passage that differs from a benchmark item of m characters in at most k edits shares at least
``m - q + 1 - k * q`` q-grams with it, all on k + 1 neighbouring diagonals. The shared q-grams of each
document are counted in overlapping bands of diagonals; bands that reach the bound are verified by a banded
alignment. Items are dealt to blocks of bounded size, whose index is broadcast; each block scans all documents.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
# Edits allowed, as a share of an item's characters.
EDITS = 0.1
# Characters of items in one broadcast block, and of a document looked at at once.
BLOCK_CHARS = 1 << 21
CHUNK = 1 << 22
FILTER_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
UNIT = np.int64(1 << 40)

_CHARS = None


def char_table() -> np.ndarray:
    """Lower-case code point of every code point; white space becomes 32."""
    global _CHARS
    if _CHARS is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            low = x.lower()
            if x.isspace():
                table[c] = 32
            elif low != x and len(low) == 1:
                table[c] = ord(low)
        _CHARS = table
    return _CHARS


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with runs of white space as one space, and the place of each in the text."""
    points = char_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not len(points):
        return points, np.zeros(0, dtype=np.int64)
    keep = np.append(True, (points[1:] != 32) | (points[:-1] != 32))
    return points[keep], np.flatnonzero(keep)


def trimmed(points: np.ndarray) -> np.ndarray:
    solid = np.flatnonzero(points != 32)
    return points[solid[0] : solid[-1] + 1] if len(solid) else points[:0]


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of every q-gram, from the hashes of its two halves."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)

    def made(width: int) -> np.ndarray:
        if width == 1:
            return points.astype(np.uint64) + np.uint64(1)
        left = width // 2
        head, tail = made(left), made(width - left) if width % 2 else None
        tail = head if tail is None else tail
        size = len(points) - width + 1
        return head[:size] * np.uint64(pow(int(BASE), width - left, 1 << 64)) + tail[left : left + size]

    out = made(q) * BASE
    out ^= out >> np.uint64(29)
    return out


class Index:
    """q-grams of a block of items, in the order of their hashes."""

    def __init__(self, ids: list, texts: list[str | None], q: int = Q, edits: float = EDITS):
        self.q, self.ids, self.items, grams, owners, places = q, [], [], [], [], []
        for name, text in zip(ids, texts):
            points = trimmed(normalise(text or "")[0])
            if len(points) < q:
                continue
            grams.append(gram_hashes(points, q))
            owners.append(np.full(len(grams[-1]), len(self.ids)))
            places.append(np.arange(len(grams[-1])))
            self.ids.append(name)
            self.items.append(points)
        size = np.array([len(x) for x in self.items], dtype=np.int64)
        self.longest = int(size.max(initial=0))
        # So many edits that the bound stays positive.
        self.budget = np.maximum(0, np.minimum(np.floor(size * edits), (size - q) // q)).astype(np.int64)
        self.bound = size - q + 1 - self.budget * q
        flat = np.concatenate([*grams, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        # Distinct q-grams, and where the occurrences of each start.
        self.grams, self.starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(self.starts, len(flat))
        self.owner = np.concatenate([*owners, np.zeros(0, dtype=np.int64)]).astype(np.int64)[order]
        self.place = np.concatenate([*places, np.zeros(0, dtype=np.int64)]).astype(np.int64)[order]
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[self.grams >> np.uint64(64 - FILTER_BITS)] = True

    def regions(self, points: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands that reach the item's bound."""
        grams = gram_hashes(points, self.q)
        at = np.flatnonzero(self.seen[grams >> np.uint64(64 - FILTER_BITS)])
        gram = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        shared = self.grams[gram] == grams[at]
        at, gram = at[shared], gram[shared]
        low, many = self.starts[gram], self.starts[gram + 1] - self.starts[gram]
        if len(at) < self.bound.min(initial=1 << 40):
            return
        # Every occurrence of a shared q-gram in an item is one hit.
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(low, many) + inside
        item = self.owner[entry]
        diagonal = np.repeat(at, many) - self.place[entry] + self.longest
        width = self.budget[item] + 1
        band = diagonal // width
        stride = len(points) + 2 * self.longest + 2
        # Each hit counts in its own band and the one before: a band covers two widths.
        keys = np.concatenate([item * stride + band, (item * stride + band - 1)[band > 0]])
        places = np.concatenate([self.place[entry], self.place[entry][band > 0]])
        some, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
        # Of the bands with enough hits, those with enough different q-grams of the item.
        full = (counts >= self.bound[some // stride])[where]
        different = np.unique(keys[full] * (self.longest + 1) + places[full]) // (self.longest + 1)
        some, counts = np.unique(different, return_counts=True)
        item = some // stride
        good = counts >= self.bound[item]
        for i, b in zip(item[good].tolist(), (some % stride)[good].tolist()):
            width = int(self.budget[i]) + 1
            yield i, b * width - self.longest, (b + 2) * width - 1 - self.longest


def align(item: np.ndarray, points: np.ndarray, first: int, last: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole item within the diagonals, if within budget."""
    for start in range(max(0, first), last + 1):
        if len(points) - start >= len(item) and np.array_equal(points[start : start + len(item)], item):
            return 0, start, start + len(item)
    first, last = first - budget, last + budget
    width = last - first + 1
    padded = np.zeros(len(item) + width + 1, dtype=np.int64) - 1
    lo, hi = max(0, first), min(len(points), first + len(padded))
    if hi <= lo:
        return None
    padded[lo - first : hi - first] = points[lo:hi]
    steps = np.arange(width, dtype=np.int64) * UNIT
    # Cost and start share a number; cell c of row r stands for r item characters read, and r + c + first of the text.
    cost = np.clip(np.arange(width, dtype=np.int64) + first, 0, len(points))
    far = UNIT * (len(item) + 1)
    for r in range(len(item)):
        match = cost + np.where(padded[r : r + width] == item[r], 0, UNIT)
        skip = np.append(cost[1:], far) + UNIT
        cost = np.minimum(match, skip)
        cost = np.minimum.accumulate(cost - steps) + steps
        if r % 16 == 15 and cost.min() // UNIT > budget:
            return None
    best = int(np.argmin(cost))
    edits, start = int(cost[best] // UNIT), int(cost[best] % UNIT)
    end = min(len(points), best + first + len(item))
    return (edits, start, end) if edits <= budget and start < end else None


def verified(index: Index, points: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(item position, edits, start, end) for each band that an alignment confirms."""
    overlap = 2 * index.longest + 2
    for at in range(0, len(points) if index.ids else 0, CHUNK):
        part = points[at : at + CHUNK + overlap]
        for item, first, last in index.regions(part):
            hit = align(index.items[item], part, first, last, int(index.budget[item]))
            if hit:
                yield item, hit[0], hit[1] + at, hit[2] + at


def is_leaking(index: Index, text: str | None) -> bool:
    return next(verified(index, normalise(text or "")[0]), None) is not None


def find_leaks(index: Index, text: str | None) -> list[tuple[int, int, int, int]]:
    """(item position, start, end, edits) of each verified passage; the best of overlapping ones."""
    points, places = normalise(text or "")
    out, taken = [], {}
    for item, edits, start, end in sorted(set(verified(index, points))):
        spans = taken.setdefault(item, [])
        at = bisect.bisect(spans, (start, end))
        if (at and spans[at - 1][1] > start) or (at < len(spans) and spans[at][0] < end):
            continue
        spans.insert(at, (start, end))
        out.append((item, int(places[start]), int(places[end - 1]) + 1, edits))
    return sorted(out)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, a block of about BLOCK_CHARS characters at a time."""
    size = benchmark.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    blocks = int(size) // BLOCK_CHARS + 1
    keyed = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    for block in range(blocks):
        rows = keyed.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()
        yield [r["id"] for r in rows], [r["text"] for r in rows]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    q: int = Q,
    edits: float = EDITS,
) -> DataFrame:
    """One row per benchmark passage found: doc_id, item_id, start, end (code points), edits, item_chars, passage.

    Letter case and runs of white space do not count. Null and empty texts hold no passage; items of fewer
    than ``q`` characters match nothing. Repeated documents and items are reported each. Other columns of
    ``docs`` are not read. Ids are integers.
    """
    spark, found = docs.sparkSession, None
    plain = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
    schema = "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint, item_chars bigint, passage string"
    types = [pa.int64()] * 6 + [pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]
    for ids, texts in item_blocks(benchmark, item_col):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value, q, edits)
            for batch in batches:
                rows = []
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = value.as_py()
                    for item, start, end, cost in find_leaks(index, text):
                        rows.append((name, index.ids[item], start, end, cost, len(index.items[item]), text[start:end]))
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        part = plain.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = Q, edits: float = EDITS) -> DataFrame:
    """Rows of ``docs``, same columns, that hold no passage of the benchmark."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    schema = docs.schema
    for ids, texts in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value, q, edits)
            for batch in batches:
                clean = [not is_leaking(index, text.as_py()) for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
