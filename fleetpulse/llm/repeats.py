"""Repeated passages by prefix-free parsing.

A position is a trigger if the rolling hash of the bytes that start there is the smallest in some window of ``reach``
hashes; triggers cut a text into phrases of at most ``reach`` bytes, and equal passages into equal phrases. Every window of
``length`` bytes belongs to the first trigger that lies at least ``reach`` bytes after its start: a suffix of the phrases
before the trigger, then the parse after it. Windows that occur twice are neighbours in corpus order, the order of these
two parts. It is built where neighbours can be alike at all:

1. Triggers are grouped by a hash of the parse that follows (the least that any of their windows holds). Groups of one are done.
2. Where all triggers of a group have one context (the bytes of all their windows), every window is repeated.
3. In the other groups each different context goes to one place once. There the parses are sorted, and for every
   suffix of the phrases its occurrences are walked in parse order: neighbours that agree for the rest of the length
   are repeated windows. Groups of very many contexts are spread by the windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import keyfilter
from fleetpulse.llm.common import attach, with_runs
from fleetpulse.plans.tables import materialize

LENGTH = 400
GRAM = 8
SEGMENT = 1 << 20
# Groups with more contexts than this are spread by window.
GROUP = 2048
RUNS = 256
BATCH_ROWS = 1 << 16


def reach_of(length: int) -> int:
    """Window of the trigger rule: triggers within a passage of ``length`` bytes then depend on its bytes alone."""
    if length < GRAM + 1:
        raise ValueError(f"length must be at least {GRAM + 1} bytes")
    return max(1, (length - GRAM + 2) // 3)


def triggers(raw: bytes, reach: int) -> np.ndarray:
    """Positions whose rolling hash is the smallest (the last of equal ones) of some ``reach`` neighbours."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    windows = len(codes) - GRAM + 1 - reach + 1
    found = []
    for start in range(0, windows, SEGMENT):
        part = codes[start : min(start + SEGMENT, windows) + reach + GRAM - 2].astype(np.uint64)
        for s in (1, 2, 4):
            part = part[:-s] | (part[s:] << np.uint64(8 * s))
        part *= np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part &= np.uint64(0xFFFFFFFF00000000)
        part |= np.arange(len(part), 0, -1, dtype=np.uint64)  # of equal hashes, the last position is smaller
        total, s = len(part), 1
        while 2 * s <= reach:
            part, s = np.minimum(part[:-s], part[s:]), 2 * s
        if s < reach:
            part = np.minimum(part[: s - reach], part[reach - s :])
        at = total - (part & np.uint64(0xFFFFFFFF)).astype(np.int64)
        found.append(start + at[np.concatenate([[True], at[1:] != at[:-1]])])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first, last): the window starts from first to last belong to the trigger; together all starts of the text."""
    reach = reach_of(length)
    if len(raw) < length:
        return (np.zeros(0, dtype=np.int64),) * 3
    at = triggers(raw, reach)
    first = np.maximum(np.concatenate([[0], at[:-1] - reach + 1]), 0)
    last = np.minimum(at - reach, len(raw) - length)
    used = last >= first
    return at[used], first[used], last[used]


def text_name(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def names_of(raws: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(text_name, raws)), dtype="<i8").reshape(-1, 2)


def raw_bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def parse(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """(key, ctx) of every trigger: hashes of the parse that follows and of the bytes of all its windows."""
    following = length - 2 * reach_of(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, contexts = [], []
            for raw in raw_bytes(batch.column(0)):
                view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
                for at, first, last in zip(*(x.tolist() for x in anchors(raw, length))):
                    keys.append(digest(view[at : at + following]))
                    contexts.append(digest(view[first : last + length], at - first))
                if len(keys) >= BATCH_ROWS:
                    yield _longs(["key", "ctx"], keys, contexts)
                    keys, contexts = [], []
            yield _longs(["key", "ctx"], keys, contexts)

    return _texts(docs, text_col).mapInArrow(run, "key bigint, ctx bigint")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("binary").alias("_text"))


def _longs(names: list[str], *columns: list[int]) -> pa.RecordBatch:
    arrays = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names)


PLACED = "key bigint, ctx bigint, u1 bigint, u2 bigint, at bigint, first bigint, last bigint"


def parse_places(docs: DataFrame, text_col: str, length: int, wanted: Broadcast) -> DataFrame:
    """Triggers whose key may be wanted, with their context, the name of their text and their windows."""
    following = length - 2 * reach_of(length) + 1
    names = [c.split()[0] for c in PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows, size = [], 0
            for raw in raw_bytes(batch.column(0)):
                view, (at, first, last) = memoryview(raw), anchors(raw, length)
                keys = np.array([digest(view[a : a + following]) for a in at.tolist()], dtype=np.uint64).view(np.int64)
                hit = np.flatnonzero(keyfilter.may_hold(wanted.value, keys))
                if not len(hit):
                    continue
                at, first, last = at[hit], first[hit], last[hit]
                contexts = [digest(view[f : t + length], a - f) for a, f, t in zip(at.tolist(), first.tolist(), last.tolist())]
                name = np.broadcast_to(np.frombuffer(text_name(raw), dtype="<i8"), (len(hit), 2))
                rows.append([keys[hit], np.array(contexts, dtype=np.uint64).view(np.int64), name[:, 0], name[:, 1], at, first, last])
                size += len(hit)
                if size >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names)

    return _texts(docs, text_col).mapInArrow(run, PLACED)


def texts_once(docs: DataFrame, text_col: str, wanted: Broadcast) -> DataFrame:
    """(u1, u2, _text) of the texts that may be wanted; a task sends equal texts once, so copies make no hot key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            raws = raw_bytes(batch.column(0))
            if not raws:
                continue
            names = names_of(raws)
            keep = []
            for i in np.flatnonzero(keyfilter.may_hold(wanted.value, names[:, 0])).tolist():
                name = names[i].tobytes()
                if name not in seen:
                    seen.add(name)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[keep, 0]), pa.array(names[keep, 1]), pa.array([raws[i] for i in keep], pa.binary())], ["u1", "u2", "_text"]
            )

    return _texts(docs, text_col).mapInArrow(run, "u1 bigint, u2 bigint, _text binary")


def contexts_of(classes: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(key, ctx, n, at, region): the bytes of all windows of one trigger of each class, and the trigger's place in them."""
    asked = classes.groupBy("rep.u1", "rep.u2").agg(
        F.collect_list(F.struct("key", "ctx", "n", F.col("rep.at").alias("at"), F.col("rep.first").alias("first"), F.col("rep.last").alias("last"))).alias("asked")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                for i in range(0, len(asked), 4096):
                    part = asked[i : i + 4096]
                    regions = [raw[a["first"] : a["last"] + length] for a in part]
                    columns = [pa.array([a[c] for a in part], pa.int64()) for c in ("key", "ctx", "n")]
                    columns += [pa.array([a["at"] - a["first"] for a in part], pa.int64()), pa.array(regions, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "ctx", "n", "at", "region"])

    joined = asked.join(texts, ["u1", "u2"]).select("asked", "_text")
    return joined.mapInArrow(run, "key bigint, ctx bigint, n bigint, at bigint, region binary")


def corpus_order(members: list[tuple[int, bytes, int]], length: int) -> list[np.ndarray]:
    """Which windows of each member (trigger's place, region, occurrences) occur elsewhere in the group, or more than once.

    The parses after the triggers are sorted once; for every suffix before them its occurrences come in that order, and
    equal windows are neighbours.
    """
    counts = [len(region) - length + 1 for _, region, _ in members]
    found = [np.full(c, n > 1) for c, (_, _, n) in zip(counts, members)]
    left = [region[:at] for at, region, _ in members]
    right = [region[at:] for at, region, _ in members]
    order = sorted(range(len(members)), key=right.__getitem__)
    for size in range(min(m[0] - c + 1 for m, c in zip(members, counts)), max(m[0] for m in members) + 1):
        latest: dict[bytes, int] = {}
        for r in order:
            j = members[r][0] - size
            if not 0 <= j < counts[r]:
                continue
            suffix = left[r][j:]
            before = latest.get(suffix)
            if before is not None and right[before][: length - size] == right[r][: length - size]:
                found[r][j] = found[before][members[before][0] - size] = True
            latest[suffix] = r
    return found


def ordered_groups(contexts: DataFrame, length: int) -> DataFrame:
    """(key, ctx, starts): the repeated windows of every context, counted from its first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}

        def close() -> pa.RecordBatch:
            found = corpus_order(list(group.values()), length)
            columns = [pa.array([key] * len(group), pa.int64()), pa.array(list(group), pa.int64()), pa.array([np.flatnonzero(f).tolist() for f in found], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["key", "ctx", "starts"])

        for batch in batches:
            for k, ctx, n, at, region in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if group:
                        yield close()
                    key, group = k, {}
                group[ctx] = (at, region, n)
        if group:
            yield close()

    placed = contexts.repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "key bigint, ctx bigint, starts array<int>")


def spread_groups(contexts: DataFrame, length: int) -> DataFrame:
    """Like ``ordered_groups`` for groups of any size: equal windows meet by their digest, combined before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, ctx, n, _, region in zip(*(c.to_pylist() for c in batch.columns)):
                m = len(region) - length + 1
                digests = [xxhash.xxh3_128_digest(region[j : j + length]) for j in range(m)]
                columns = [pa.array([v] * m, pa.int64()) for v in (key, ctx, n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(m), pa.int32()), pa.array(digests, pa.binary())], ["key", "ctx", "n", "start", "window"])

    windows = contexts.dropDuplicates(["key", "ctx"]).mapInArrow(run, "key bigint, ctx bigint, n bigint, start int, window binary")
    windows = materialize(windows, "windows")
    often = windows.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window")
    return windows.join(often, "window", "left_semi").groupBy("key", "ctx").agg(F.collect_list("start").alias("starts"))


def repeated_parts(docs: DataFrame, text_col: str, length: int, group: int = GROUP) -> DataFrame:
    """(u1, u2, parts): for each different text with a repeated window, the runs (first, last) of starts of such windows."""
    pairs = parse(docs, text_col, length)
    keys = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("ctx") != F.max("ctx")).alias("mixed"))
    keys = materialize(keys.where("n > 1").drop("n"), "keys")
    wanted = keyfilter.fit(keys.select("key"))
    places = materialize(parse_places(docs, text_col, length, wanted).join(keys, "key"), "places")
    wanted.unpersist()
    own = places.where("mixed").groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("u1", "u2", "at", "first", "last")).alias("rep"))
    classes = materialize(own, "classes")
    wanted = keyfilter.fit(classes.select("rep.u1"))
    contexts = materialize(contexts_of(classes, texts_once(docs, text_col, wanted), length), "contexts")
    wanted.unpersist()
    large = materialize(classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("key"), "large")
    small = ordered_groups(contexts.join(large, "key", "left_anti"), length)
    found = small.unionByName(spread_groups(contexts.join(large, "key", "left_semi"), length))
    plain = places.where("NOT mixed").select("u1", "u2", "first", "last", F.lit(None).cast("array<int>").alias("starts"))
    mixed = places.where("mixed").join(found.where("size(starts) > 0"), ["key", "ctx"]).select("u1", "u2", "first", "last", "starts")
    part = F.struct("first", F.when(F.col("starts").isNull(), F.col("last")).alias("last"), "starts")
    return materialize(plain.unionByName(mixed).groupBy("u1", "u2").agg(F.collect_set(part).alias("parts")), "parts")


def covered(parts: list[dict], length: int) -> np.ndarray:
    """Maximal runs (start, stop) of bytes that the windows of the parts cover."""
    starts = [np.arange(p["first"], p["last"] + 1) if p["starts"] is None else p["first"] + np.array(p["starts"], dtype=np.int64) for p in parts]
    starts = np.unique(np.concatenate(starts))
    breaks = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)] + length], axis=1)


CUT = "u1 bigint, u2 bigint, spans array<struct<start:bigint,stop:bigint>>, n_removed bigint, kept_sha256 string"


def cut_texts(docs: DataFrame, text_col: str, parts: DataFrame, length: int) -> DataFrame:
    """Removed spans, their bytes and the sha256 of what is left, once for each different text with a repeated window."""
    wanted = keyfilter.fit(parts.select("u1"))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, removed, digests = [], [], []
            for parts, text in zip(batch.column(2).to_pylist(), batch.column(3)):
                raw, kept, end = text.as_buffer().to_pybytes(), hashlib.sha256(), 0
                runs = covered(parts, length).tolist()
                for start, stop in runs:
                    kept.update(raw[end:start])
                    end = stop
                kept.update(raw[end:])
                spans.append([{"start": a, "stop": b} for a, b in runs])
                removed.append(sum(b - a for a, b in runs))
                digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(spans, spans_type), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["u1", "u2", "spans", "n_removed", "kept_sha256"],
            )

    joined = parts.join(texts_once(docs, text_col, wanted), ["u1", "u2"]).select("u1", "u2", "parts", "_text")
    return materialize(joined.mapInArrow(run, CUT).dropDuplicates(["u1", "u2"]), "cut")


def named_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, u1, u2, n_bytes, whole_sha256) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = raw_bytes(batch.column(1))
            names = names_of(raws)
            digests = [hashlib.sha256(r).hexdigest() for r in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(list(map(len, raws)), pa.int64()), pa.array(digests, pa.string())],
                ["_id", "u1", "u2", "n_bytes", "whole_sha256"],
            )

    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return plain.mapInArrow(run, f"_id {id_type}, u1 bigint, u2 bigint, n_bytes bigint, whole_sha256 string")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, the maximal byte spans to remove, n_removed, n_spans and kept_sha256.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in the same text (overlaps
    count) or another; judged on the input. Strings never cross texts. Null texts are empty; texts shorter than ``length`` lose
    nothing. Repeated rows are copies of each other like other equal texts. Ids may be null; other columns are not read.
    """
    cut = cut_texts(docs, text_col, repeated_parts(docs, text_col, length, group), length)
    rows = with_runs(named_rows(docs, id_col, text_col), RUNS, "named")
    found = attach(rows, cut, ["u1", "u2"])
    return found.select(
        F.col("_id").alias(id_col),
        "n_bytes",
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )


def repeats_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``repeated_spans`` without the spans themselves."""
    return repeated_spans(docs, id_col, text_col, length, group).drop("spans")
