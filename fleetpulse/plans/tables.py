"""Written tables and size-checked broadcast joins."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast side never exceeds this many rows, nor this many bytes by the widths of its columns.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 128 << 20
# Bytes counted for a value of a type of no fixed width, and elements of an array or a map.
TEXT_BYTES, ELEMENTS = 40, 16


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where none is named, a folder below the session's warehouse; off local mode that must not be a ``file:`` path.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not sc.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{warehouse}/fleetpulse-scratch"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table.

    Cuts lineage in a way that survives lost executors, and gives Catalyst the real size.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join on ``keys`` in which nulls match nulls; the keys of ``left`` are kept."""
    if not keys:
        return left.join(right, F.lit(True), how)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def width_of(kind: T.DataType) -> int:
    """Bytes a value of a type is counted as."""
    if isinstance(kind, T.StructType):
        return 8 + sum(width_of(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 8 + ELEMENTS * width_of(kind.elementType)
    if isinstance(kind, T.MapType):
        return 8 + ELEMENTS * (width_of(kind.keyType) + width_of(kind.valueType))
    return TEXT_BYTES if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def fits_broadcast(rows: int, schema: T.StructType, max_rows: int = BROADCAST_ROWS) -> bool:
    return rows <= max_rows and rows * width_of(schema) <= BROADCAST_BYTES


def broadcast_if_small(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the written ``table`` is within the bounds.

    The count reads Parquet footers. Beyond the bounds the join is left to Catalyst: a shuffle join
    whose hot keys adaptive execution splits.
    """
    return F.broadcast(table) if fits_broadcast(table.count(), table.schema, max_rows) else table


def few_rows(df: DataFrame, max_rows: int = 1_000) -> DataFrame:
    """Evaluate a table expected to be tiny, once, for use as a join side."""
    return few_or_none(df, max_rows, keep_empty=True)


def few_or_none(df: DataFrame, max_rows: int = 1_000, keep_empty: bool = False) -> DataFrame | None:
    """Like ``few_rows``, None when there are no rows.

    Within ``max_rows`` the rows become a local, broadcast table; more of them are written and checked like
    any other table.
    """
    rows = df.limit(max_rows + 1).collect()
    if not rows and not keep_empty:
        return None
    if len(rows) <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return broadcast_if_small(materialize(df, "few"))
