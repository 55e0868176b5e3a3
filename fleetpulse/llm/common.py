"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.plans.tables import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows of a written table that share a run: hot keys spread over runs, whatever their content.
RUN_ROWS = 4096


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def with_runs(df: DataFrame, runs: int, tag: str, out: str = "_run") -> DataFrame:
    """Write ``df`` and give each row a run from 0 to ``runs - 1``.

    Runs follow the place of a row in the written files, so they are even for any content, and equal
    on every re-read.
    """
    return placed(materialize(df, tag), runs, out).drop("_file", "_line")


def placed(written: DataFrame, runs: int, out: str = "_run") -> DataFrame:
    """Add a row's run and its place in the written files, (_file, _line), which names it uniquely."""
    place = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / RUN_ROWS))
    return written.select(
        "*",
        F.pmod(place, F.lit(runs)).cast("int").alias(out),
        F.xxhash64("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_line"),
    )


def attach(rows: DataFrame, table: DataFrame, key: Sequence[str], run: str = "_run") -> DataFrame:
    """Left join ``table`` (one row per ``key``) to ``rows``, in two steps.

    The key's row first travels to each (key, run) that occurs, then to the rows of that run: rows with a
    hot key are spread over as many tasks as there are runs. Keys must not be null.
    """
    pieces = rows.select(*key, run).distinct()
    return rows.join(pieces.join(table, list(key)), [*key, run], "left")
