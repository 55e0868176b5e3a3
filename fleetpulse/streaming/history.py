"""Stateful rolling features: the last readings of each machine live in bounded list state."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetpulse.schemas import ROLLING_METRICS, ROLLING_N

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """List state requires the RocksDB state store; the session's own setting is put back."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER_KEY, before) if before else spark.conf.unset(PROVIDER_KEY)


def reading_order(r: Row) -> tuple:
    """Time, then event; nulls come last. An instant, not the clock of a zone, which goes back an hour a year."""
    at = r["event_time"]
    return at is None, at.timestamp() if at else 0.0, r["event_id"] is None, r["event_id"] or 0


def number(value) -> float:
    return math.nan if value is None else float(value)


def rolling_features(values: np.ndarray, n: int) -> np.ndarray:
    """Per reading, for each column: mean and deviation of up to ``n`` readings ending there, difference to the first of a full window.

    NaN and infinite values are left out of the windows; where none is left the mean is NaN and the deviation 0.
    """
    padded = np.concatenate([np.full((n - 1, values.shape[1]), np.nan), np.where(np.isinf(values), np.nan, values)])
    window = np.lib.stride_tricks.sliding_window_view(padded, n, axis=0)
    held = ~np.isnan(window)
    times = held.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(held, window, 0.0).sum(axis=2) / times
        low, high = (f(np.where(held, window, x), axis=2) for f, x in ((np.min, np.inf), (np.max, -np.inf)))
        mean = np.where(low == high, low, mean)
        squares = np.where(held, window - mean[:, :, None], 0.0) ** 2
        spread = np.where(times > 1, np.sqrt(squares.sum(axis=2) / (times - 1)), 0.0)
        delta = np.zeros(values.shape)
        delta[n - 1 :] = np.nan_to_num(values[n - 1 :] - values[: max(0, len(values) - n + 1)], nan=0.0, posinf=np.inf, neginf=-np.inf)
    return np.stack([mean, spread, delta], axis=2).reshape(len(values), -1)


def output_schema(metrics: Sequence[str] = ROLLING_METRICS) -> T.StructType:
    fields = [
        T.StructField("machine", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
    ]
    fields += [T.StructField(f"{m}_{s}", T.DoubleType()) for m in metrics for s in ("rolling_mean", "rolling_std", "delta")]
    return T.StructType(fields)


class RollingHistory(StatefulProcessor):
    """Keeps ``n - 1`` earlier readings per machine and emits the rolling features of each new one.

    State may start from stored readings, and that of a machine silent for ``ttl_ms`` is dropped.
    """

    def __init__(self, metrics: Sequence[str] = ROLLING_METRICS, n: int = ROLLING_N, ttl_ms: int | None = None):
        self.metrics, self.n, self.ttl_ms = list(metrics), n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        shape = T.StructType([T.StructField(m, T.DoubleType()) for m in self.metrics])
        self.earlier = handle.getListState("earlier", shape, self.ttl_ms)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        stored = sorted(initialState["stored"], key=reading_order)
        self.earlier.put([tuple(number(r[m]) for m in self.metrics) for r in stored[-(self.n - 1) :]])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A micro-batch holds one trigger's rows of a machine; maxFilesPerTrigger bounds it.
        batch = sorted(rows, key=reading_order)
        past = [tuple(map(number, r)) for r in self.earlier.get()]
        values = past + [tuple(number(r[m]) for m in self.metrics) for r in batch]
        features = rolling_features(np.array(values, dtype=float), self.n)[len(past) :]
        self.earlier.put(values[-(self.n - 1) :])
        made = Row(*output_schema(self.metrics).names)
        for r, found in zip(batch, features.tolist()):
            yield made(key[0], r["event_time"], r["event_id"], *[None if math.isnan(x) else x for x in found])

    def close(self) -> None:
        pass


def last_readings(stored: DataFrame, n: int = ROLLING_N) -> DataFrame:
    """The newest ``n - 1`` readings of every machine; no task sorts more than these of a machine once it has seen them."""
    newest = "row_number() OVER (PARTITION BY machine ORDER BY event_time DESC, event_id DESC)"
    return stored.withColumn("_back", F.expr(newest)).where(F.col("_back") < n).drop("_back")


def rolling_stream(
    df: DataFrame, metrics: Sequence[str] = ROLLING_METRICS, n: int = ROLLING_N, stored: DataFrame | None = None, ttl_ms: int | None = None
) -> DataFrame:
    """Streaming counterpart of the batch rolling features; start it inside ``rocksdb_state``.

    ``stored`` (machine, event_time, event_id and the metrics) seeds the state when the stream first starts: the first streamed reading of a
    machine then has a full window. ``ttl_ms`` bounds the state of machines that fell silent, by the clock; such a query never
    runs out of batches, so it wants a processing-time trigger rather than ``availableNow``.
    """
    kept = ["machine", "event_time", "event_id", *metrics]
    initial = None
    if stored is not None:  # one row per machine, of at most n - 1 readings
        initial = last_readings(stored.select(*kept), n).groupBy("machine").agg(F.collect_list(F.struct(*kept[1:])).alias("stored")).groupBy("machine")
    return (
        df.select(*kept)
        .groupBy("machine")
        .transformWithState(
            RollingHistory(metrics, n, ttl_ms),
            outputStructType=output_schema(metrics),
            outputMode="Append",
            timeMode="ProcessingTime" if ttl_ms else "None",
            initialState=initial,
        )
    )
