"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair draws a uniform number from an md5 digest; the shard with the smallest
``-ln(u) / weight`` takes the key. A shard's share follows its weight, and one more shard only takes
keys to itself. The assignment is a per-row expression: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a shard that one task numbers, on average.
SLOT_ROWS = 65_536
EXPLODE_ROWS = 65_536


def _races(key: str, weights: Sequence[float]) -> Column:
    """Array of (finishing time, shard), one entry for each shard."""
    digests = -(-len(weights) // 4)
    name = f"coalesce(CAST(`{key}` AS STRING), 'null')"
    pieces = F.expr(
        f"regexp_extract_all(concat_ws('', transform(sequence(0, {digests - 1}), "
        f"g -> md5(concat({name}, '|', CAST(g AS STRING))))), '.{{8}}', 0)"
    )
    costs = F.array(*[F.lit(1.0 / w) for w in weights])
    draw = lambda x: (F.conv(x, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    timed = F.zip_with(F.slice(pieces, 1, len(weights)), costs, lambda x, c: -F.log(draw(x)) * c)
    return F.transform(timed, lambda t, s: F.struct(t.alias("t"), s.alias("s")))


def assign_shards(
    docs: DataFrame,
    key: str = "doc_id",
    weights: Sequence[float] | int = 40,
    added_weight: float | None = None,
    out: str = "shard",
    grown: str = "grown_shard",
) -> DataFrame:
    """Add ``out``, the shard of each row, and with ``added_weight`` the shard if one more is added.

    ``weights`` gives each shard's weight, or the number of shards of weight 1. Rows with one key share
    a shard; null keys count as one key. Columns named ``out`` or ``grown`` are replaced, an empty table
    stays empty.
    """
    weights = [1.0] * weights if isinstance(weights, int) else [float(w) for w in weights]
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    every = [*weights, *([float(added_weight)] if added_weight else [])]
    raced = docs.withColumn("_races", _races(key, every))
    raced = raced.withColumn(out, F.array_min(F.slice("_races", 1, len(weights)))["s"].cast("int"))
    if added_weight:
        raced = raced.withColumn(grown, F.array_min("_races")["s"].cast("int"))
    return raced.drop("_races")


def number_slots(rows: DataFrame, shard: str, out: str = "slot") -> DataFrame:
    """Add a gapless number from 0 within each shard, in the order of a digest of the row.

    Equal rows are counted first and numbered as one range. Distinct rows are cut into digest prefixes;
    each row is ranked within its prefix and moved up by the rows of smaller prefixes, so that no task
    holds a whole shard.
    """
    names = [c for c in rows.columns if c != out]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names if c != shard])
    grouped = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).withColumn("_digest", F.md5(text))
    grouped = grouped.withColumn("_prefix", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int"))
    by = [shard, "_prefix"]
    below = Window.partitionBy(shard).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.groupBy(*by).agg(F.sum("_n").alias("_c"))
    starts = starts.select(*by, F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by).orderBy("_digest", *[c for c in names if c != shard])
    ranked = grouped.join(starts, by).withColumn(
        "_first", F.col("_start") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    )
    blocks = ranked.select(
        *names, "_n", "_first",
        F.explode(F.expr(f"sequence(0L, CAST((_n - 1) DIV {EXPLODE_ROWS} AS BIGINT))")).alias("_block"),
    )
    last = f"least(_n, (_block + 1) * {EXPLODE_ROWS}) - 1"
    return blocks.select(
        *names, F.explode(F.expr(f"sequence(_first + _block * {EXPLODE_ROWS}, _first + {last})")).alias(out)
    )


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Size, checksum, shard, slot and grown shard of every document (one row per row of ``docs``).

    A null text counts as no bytes. Repeated rows each get a slot of their own.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    return number_slots(assign_shards(sized, weights=shards, added_weight=1.0), "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
