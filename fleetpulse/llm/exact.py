"""Exact deduplication by a tree-merge of sorted digest runs.

Every row of a written table belongs to one of ``runs`` runs. A run is sorted by digest and reduced to
one entry per digest: the best row and the number of rows. In each round the runs of ``fan`` neighbours
meet and are merged in the same way, until one run, spread over all tasks by digest, is left. The
winners then travel back to the runs and from there to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import attach, with_runs
from fleetpulse.plans.tables import materialize

RUNS = 512
FAN = 8
KEY = ["_digest", "_length", "_check"]


def normalised(text: Column) -> Column:
    """Text without space, tab, line feed, vertical tab, form feed and carriage return; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digest of the normalised text, with its length and a second hash that verify equal digests."""
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    plain = plain.withColumn("_norm", normalised(F.col("_text")))
    return plain.select(
        "_id",
        F.coalesce(F.length("_text"), F.lit(0)).alias("_points"),
        F.unhex(F.sha2("_norm", 256)).alias("_digest"),
        F.octet_length("_norm").alias("_length"),
        F.xxhash64("_norm").alias("_check"),
    )


def _merge(entries: DataFrame, level: Column) -> DataFrame:
    """One entry per (run, digest): the most code points, then the smallest id (null ids last)."""
    return entries.groupBy(level.alias("_level"), *KEY).agg(
        F.min("_best").alias("_best"), F.sum("_count").alias("_count")
    )


def tree_merge(rows: DataFrame, runs: int = RUNS, fan: int = FAN) -> DataFrame:
    """One row per digest with ``_best`` (negated code points, id is null, id) and ``_count``."""
    best = F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"), F.col("_id").alias("id"))
    entries = _merge(rows.select("_run", *KEY, best.alias("_best"), F.lit(1).cast("bigint").alias("_count")), F.col("_run"))
    while runs > 1:
        runs = -(-runs // fan)
        entries = _merge(entries, F.floor(F.col("_level") / fan).cast("int") if runs > 1 else F.lit(0))
    return entries.drop("_level")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """One row per row of ``docs``: id, kept id, group size, kept, sha256 of the normalised text.

    Texts are equal when identical without white space; null counts as empty. The row with the most code
    points stays, then the smallest id. Rows with a null id lose to others of equal length; where rows repeat with
    the kept id and length, each of them is marked as kept. Other columns of ``docs`` are not read.
    """
    rows = with_runs(digests(docs, id_col, text_col), runs, "digests")
    winners = materialize(tree_merge(rows, runs), "winners")
    found = attach(rows, winners, KEY)
    best = F.col("_best")
    return found.select(
        F.col("_id").alias(id_col),
        best["id"].alias("keep_id"),
        F.col("_count").alias("group_size"),
        (F.col("_id").eqNullSafe(best["id"]) & (F.col("_points") == -best["p"])).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
