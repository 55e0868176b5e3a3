"""Online baselines: the moments of every micro-batch, merged level by level behind a snapshot pointer.

A batch adds one file of moments. When a level holds ``fan`` files they become one file of the next level, so ``b`` batches leave
some ``fan * log(b)`` files. A snapshot lists the files that count and the batches they hold; it is written to one of a few slots in turn
and readers take the newest, so a read opens only the slots and the listed files. A batch that a snapshot already holds is not added again,
and an update that fails before its snapshot changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.timefeat import add_window
from fleetpulse.operators.baselines import merge_cells, moment_cells
from fleetpulse.schemas import STD_FLOOR
from fleetpulse.sources.commits import streaming_query

FAN = 8
SLOTS = 8
SNAPSHOT = "query string, version bigint, entries array<struct<id:string,level:int,first:bigint,last:bigint,as_of:double>>"
CELL = ["machine", "type", "window"]


@dataclass(frozen=True)
class Entry:
    """One file of moments: its level, the batches it holds and the newest event time among them (seconds)."""

    id: str
    level: int
    first: int
    last: int
    as_of: float


def snapshots(spark: SparkSession, root: str) -> dict[str, tuple[int, list[Entry]]]:
    """Newest version and its entries of every query."""
    try:
        rows = spark.read.schema(SNAPSHOT).option("recursiveFileLookup", True).parquet(f"{root}/snapshots").groupBy("query").agg(F.max(F.struct("version", "entries")).alias("s")).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return {r["query"]: (r["s"]["version"], [Entry(**e.asDict()) for e in r["s"]["entries"]]) for r in rows}  # one row per query


def faded(cells: DataFrame, metrics: Sequence[str], factor: float) -> DataFrame:
    """Moments whose counts weigh ``factor``."""
    if factor == 1.0:
        return cells
    return cells.withColumns({c: F.col(c) * F.lit(factor) for c in ("n", *[f"{m}_n" for m in metrics])})


def merged(spark: SparkSession, root: str, entries: Sequence[Entry], metrics: Sequence[str], half_life: float | None) -> DataFrame:
    """Moments of some entries as of the newest of them; with ``half_life`` (seconds) older counts fade."""
    newest = max(e.as_of for e in entries)
    weight = lambda e: 1.0 if half_life is None else 0.5 ** ((newest - e.as_of) / half_life)
    if half_life is None:
        cells = spark.read.parquet(*[f"{root}/moments/{e.id}" for e in entries])
    else:
        cells = reduce(DataFrame.unionByName, [faded(spark.read.parquet(f"{root}/moments/{e.id}"), metrics, weight(e)) for e in entries])
    return merge_cells(cells, CELL, metrics)


def update_body(
    root: str, metrics: Sequence[str], name: str | None = None, half_life: float | None = None, fan: int = FAN, ts: str = "timestamp"
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body; batches are keyed by ``name`` (by default the streaming query's id) and count once."""

    def write(cells: DataFrame, level: int, first: int, last: int, as_of: float) -> Entry:
        entry = Entry(uuid.uuid4().hex, level, first, last, as_of)
        cells.coalesce(1).write.parquet(f"{root}/moments/{entry.id}")  # one row per machine, type and window
        return entry

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = name or streaming_query(spark) or "online"
        version, entries = snapshots(spark, root).get(query, (0, []))
        if any(e.first <= batch_id <= e.last for e in entries):
            return
        newest = batch.agg(F.max(F.col(ts).cast("timestamp")).cast("double")).first()[0]
        if newest is None:
            return
        entries = [*entries, write(moment_cells(add_window(batch, ts), metrics), 0, batch_id, batch_id, newest)]
        level = 0
        while len(full := [e for e in entries if e.level == level]) >= fan:
            whole = write(merged(spark, root, full, metrics, half_life), level + 1, full[0].first, full[-1].last, max(e.as_of for e in full))
            entries = [e for e in entries if e.level != level] + [whole]
            level += 1
        row = (query, version + 1, [asdict(e) for e in entries])
        spark.createDataFrame([row], SNAPSHOT).coalesce(1).write.mode("overwrite").parquet(f"{root}/snapshots/{query}-{(version + 1) % SLOTS}")

    return body


def current_baselines(
    spark: SparkSession, root: str, metrics: Sequence[str], floor: float = STD_FLOOR, half_life: float | None = None
) -> DataFrame:
    """Machine-and-window baselines of everything seen so far, by all queries that update ``root``."""
    entries = [e for _, found in snapshots(spark, root).values() for e in found]
    if not entries:
        raise ValueError(f"no moments below {root}")
    cells = merged(spark, root, entries, metrics, half_life)
    stats = []
    for m in metrics:
        stats += [F.col(f"{m}_m").alias(f"{m}_mean"), F.greatest(F.sqrt(f"{m}_v"), F.lit(floor)).alias(f"{m}_std")]
    return cells.select(*CELL, "n", *stats)
