"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units, two hashed cut points make prefix, middle and suffix, and each section goes out as
pieces of whole units keyed by row and place in the output. Pieces are repartitioned by row and sorted by place within
partitions; tasks stream them into a digest that grows piece by piece. To restore a text, the same partitions
are sorted again by the place that the output's markers give each piece; nothing is shuffled a second time and no
task holds more than one piece of a text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A piece ends at the last unit that ends within so many bytes; a longer unit is several pieces.
PIECE_BYTES = 1 << 16
BATCH_BYTES = 1 << 23
SEED = "42"
FIM_PERCENT = 50
SPM_PERCENT = 80
MARKERS = {b"<P>": 0, b"<M>": 1, b"<S>": 2}  # marker: place of its section in the restored text
ORDERS = {"psm": (b"<P>", b"<S>", b"<M>"), "spm": (b"<S>", b"<P>", b"<M>")}
SECTION = 1 << 40


def unit_ends(raw: bytes) -> np.ndarray:
    """Byte offsets where units end: white space with the word after it, or white space that ends the text."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    last = ~space
    last[:-1] &= space[1:]
    last[-1:] = True
    return np.flatnonzero(last) + 1


def code_points(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80))


def layout(raw: bytes, digest: str, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> tuple[str, np.ndarray, list[int]]:
    """Form, unit ends and the byte offsets [0, prefix end, middle end, length] of a text."""
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    ends = unit_ends(raw)
    n = len(ends)
    if not raw or any(m in raw for m in MARKERS) or h3 % 100 >= fim:
        return "plain", ends, [0, len(raw), len(raw), len(raw)]
    cuts = [0 if k == 0 else int(ends[k - 1]) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    return ("spm" if h4 % 100 < spm else "psm"), ends, [0, *cuts, len(raw)]


def unit_pieces(raw: bytes, ends: np.ndarray, start: int, stop: int) -> Iterator[bytes]:
    """The bytes from start to stop in chunks of whole units."""
    while stop - start > PIECE_BYTES:
        fits = int(np.searchsorted(ends, start + PIECE_BYTES, "right"))
        at = int(ends[fits - 1]) if fits else 0
        at = at if at > start else start + PIECE_BYTES
        yield raw[start:at]
        start = at
    if stop > start:
        yield raw[start:stop]


def output_pieces(raw: bytes, form: str, ends: np.ndarray, offsets: list[int]) -> Iterator[bytes]:
    """Pieces of the output in order; each marker is a piece of its own."""
    if form == "plain":
        yield from unit_pieces(raw, ends, 0, len(raw))
        return
    for marker in ORDERS[form]:
        yield marker
        yield from unit_pieces(raw, ends, *offsets[MARKERS[marker] : MARKERS[marker] + 2])


HEAD = ["n", "form", "prefix_chars", "middle_chars"]
HEAD_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
HEAD_SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint"


class Rows:
    """Collects rows as columns and hands them out as Arrow batches of bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types = names, types
        self.clear()

    def clear(self) -> None:
        self.columns, self.bytes = [[] for _ in self.names], 0

    def add(self, *values, size: int = 64) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, self.types)], self.names)
        self.clear()
        return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """(_row, _place, _piece, _id and the head columns): the pieces of all outputs, and a head row at place -1 for each row.

    ``_row`` is the content's hash, the task and how often the task has met that content: a rerun task gives
    the same names whatever order its rows come in, and repeated rows are never one group.
    """
    id_type = docs.schema[id_col].dataType
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), digest.alias("_digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = Counter(), TaskContext.get().partitionId().to_bytes(4, "big")
        out = None
        for batch in batches:
            out = out or Rows(["_row", "_place", "_piece", "_id", *HEAD], [pa.binary(), pa.int64(), pa.binary(), batch.schema.field(0).type, *HEAD_TYPES])
            for key, text, hexed in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                content = xxhash.xxh3_128_digest(raw + hexed.encode())
                row = content + task + seen[content].to_bytes(4, "big")
                seen[content] += 1
                form, ends, offsets = layout(raw, hexed, fim, spm)
                chars = [None, None] if form == "plain" else [code_points(raw[a:b]) for a, b in zip(offsets[:2], offsets[1:3])]
                out.add(row, -1, None, key.as_py(), len(ends), form, *chars)
                for place, piece in enumerate(output_pieces(raw, form, ends, offsets)):
                    out.add(row, place, piece, None, None, None, None, None, size=64 + len(piece))
                    if out.full():
                        yield out.batch()
        if out:
            yield out.batch()

    return plain.mapInArrow(run, f"_row binary, _place bigint, _piece binary, _id {id_type.simpleString()}, {HEAD_SCHEMA}")


class Digest:
    """sha256 of pieces as they come."""

    type, arrow = "string", pa.string()

    def __init__(self):
        self.state = hashlib.sha256()

    def add(self, piece: bytes) -> None:
        self.state.update(piece)

    def result(self) -> str:
        return self.state.hexdigest()


class Whole:
    """The joined pieces themselves: holds one text."""

    type, arrow = "binary", pa.binary()

    def __init__(self):
        self.parts = []

    def add(self, piece: bytes) -> None:
        self.parts.append(piece)

    def result(self) -> bytes:
        return b"".join(self.parts)


def assembled(cut: DataFrame, sink: Callable = Digest) -> DataFrame:
    """Outputs from their pieces: a row at ``_back`` -1 with the result of ``sink``, and each piece at its place in the restored text."""
    id_type = cut.schema["_id"].dataType.simpleString()
    names = ["_row", "_back", "_piece", "_output", "_id", *HEAD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = head = state = None
        section = 0

        def close() -> None:
            if head:
                result = state.result()
                out.add(head[0], -1, None, result, *head[1:], size=64 + len(result))

        for batch in batches:
            out = out or Rows(names, [pa.binary(), pa.int64(), pa.binary(), sink.arrow, batch.schema.field(3).type, *HEAD_TYPES])
            columns = [c.to_pylist() for c in batch.columns]
            for i, (row, place, piece) in enumerate(zip(*columns[:3])):
                if place < 0:
                    close()
                    head, state, section = [row, *[c[i] for c in columns[3:]]], sink(), 0
                    continue
                state.add(piece)
                if head[3] != "plain" and piece in MARKERS:
                    section = MARKERS[piece]
                else:
                    out.add(row, section * SECTION + place, piece, None, None, None, None, None, None, size=64 + len(piece))
                if out.full():
                    yield out.batch()
        if out:
            close()
            yield out.batch()

    placed = cut.repartition("_row").sortWithinPartitions("_row", "_place")
    return placed.mapInArrow(run, f"_row binary, _back bigint, _piece binary, _output {sink.type}, _id {id_type}, {HEAD_SCHEMA}")


def restored(outputs: DataFrame, sink: Callable = Digest) -> DataFrame:
    """One row per document: id, the head columns, the output's result and that of the text put together again.

    Expects the partitions of ``assembled``: they are sorted again, not shuffled.
    """
    id_type = outputs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = head = state = None
        for batch in batches:
            out = out or Rows(["_id", *HEAD, "output", "restored"], [batch.schema.field(4).type, *HEAD_TYPES, sink.arrow, sink.arrow])
            columns = [c.to_pylist() for c in batch.columns]
            for i, (back, piece) in enumerate(zip(columns[1], columns[2])):
                if back >= 0:
                    state.add(piece)
                    continue
                if head:
                    out.add(*head, state.result(), size=64 + 2 * len(head[-1]))
                head, state = [*[c[i] for c in columns[4:]], columns[3][i]], sink()
                if out.full():
                    yield out.batch()
        if out:
            if head:
                out.add(*head, state.result())
            yield out.batch()

    again = outputs.sortWithinPartitions("_row", "_back")
    return again.mapInArrow(run, f"_id {id_type}, {HEAD_SCHEMA}, output {sink.type}, restored {sink.type}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and the texts ``output`` and ``restored`` of every row.

    ``fim`` is the percentage of texts that are transformed, ``spm`` that of suffix-first forms among them. Null texts count
    as empty and stay plain, as do texts that hold a marker; a null id is hashed as the empty text. Repeated rows give
    repeated results. Other columns are not read.
    """
    found = restored(assembled(pieces(docs, id_col, text_col, fim, spm), Whole), Whole)
    texts = [F.col(c).cast("string").alias(c) for c in ("output", "restored")]
    return found.select(F.col("_id").alias(id_col), *HEAD, *texts)


def fim_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """Like ``fill_in_middle`` with the sha256 of output and restored text in place of the texts."""
    found = restored(assembled(pieces(docs, id_col, text_col, fim, spm)))
    digests = [F.col(c).alias(f"{c}_sha256") for c in ("output", "restored")]
    return found.select(F.col("_id").alias(id_col), *HEAD, *digests)
