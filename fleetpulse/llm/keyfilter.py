"""A filter of bounded size over hashed keys, fitted by Spark and sent to tasks.

It never grows beyond its bound: with more keys it only lets more strangers pass, so it may thin out rows before
a shuffle but never decides a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, LEAST_BITS = 1 << 27, 1 << 20
KEY_SHARE = 16  # bits for each key, below the bound
PROBES = 3
SLICES = 64


def bits_for(keys: int) -> int:
    """Bits of a filter of so many keys: a power of two between LEAST_BITS and BITS."""
    return min(BITS, max(LEAST_BITS, 1 << (KEY_SHARE * keys - 1).bit_length()))


def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """PROBES bit numbers of each hashed key."""
    mixed = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (mixed + np.uint64(i) * step) % np.uint64(bits)


def may_hold(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of those the filter was fitted on; false is certain."""
    found = np.ones(len(keys), dtype=bool)
    for at in places(keys, 8 * len(filled)):
        found &= (filled[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def fit(keys: DataFrame, bits: int = BITS) -> Broadcast:
    """Broadcast bit array of the first column (a hash, bigint) of ``keys``: ``bits`` / 8 bytes for any input."""

    def slices(filled: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for i, part in enumerate(np.split(filled, SLICES)):
            if part.any():
                yield i, zlib.compress(part.tobytes(), 1)

    def batch(rows) -> pa.RecordBatch:
        rows = list(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["_slice", "_bits"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(bits // 8, dtype=np.uint8)
        for part in batches:
            for at in places(part.column(0).drop_null().to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(filled, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield batch(slices(filled))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for part in batches:
            for i, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                more = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
                merged[i] = merged[i] | more if i in merged else more
        yield batch((i, zlib.compress(x.tobytes(), 1)) for i, x in merged.items())

    parts = keys.select(F.col(keys.columns[0])).mapInArrow(fill, "_slice int, _bits binary")
    merged = parts.repartition(SLICES, "_slice").mapInArrow(merge, "_slice int, _bits binary")
    filled = np.zeros((SLICES, bits // 8 // SLICES), dtype=np.uint8)
    for row in merged.collect():  # at most SLICES rows
        filled[row["_slice"]] = np.frombuffer(zlib.decompress(row["_bits"]), dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(filled.reshape(-1))
