"""Ordered per-key windows that stay parallel when one key holds much of the data.

A plain ``partitionBy(key)`` window puts a whole key into one task. Here a key with more than
``chunk_rows`` rows is cut into time slices; what a slice needs from earlier ones (the last few rows,
or a running total) is carried over through a small table of slices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.plans.prefix import global_index
from fleetpulse.plans.tables import few_or_none, null_safe_join

CHUNK_ROWS = 2_000_000
CHUNK = "_chunk"
# Slices are this much finer than the average rate asks for, so that a burst of up to this factor still
# fits a slice. Adaptive execution merges slices that turn out small.
OVERSPLIT = 8


def seconds_of(df: DataFrame, ts: str) -> Column:
    """Position of ``ts`` on a monotone axis of seconds, independent of the session time zone."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampNTZType):
        days = F.unix_date(F.to_date(ts)).cast("double")
        return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(ts) / F.lit(1e6)
    if isinstance(kind, T.DateType):
        return F.unix_date(ts).cast("double")
    return F.col(ts).cast("double")


def assign_chunks(
    df: DataFrame, by: Sequence[str], ts: str, chunk_rows: int | None
) -> tuple[DataFrame, bool]:
    """Add ``_chunk``: 0 for ordinary keys, a time slice number for keys above ``chunk_rows``.

    Equal timestamps always share a slice, so slices follow the time order. The table of hot keys has
    at most rows / chunk_rows entries and is broadcast only within the checked bound.
    """
    if not chunk_rows:
        return df.withColumn(CHUNK, F.lit(0).cast("bigint")), False
    pos = seconds_of(df, ts)
    hot = few_or_none(
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
        .where((F.col("_n") > chunk_rows) & (F.col("_hi") > F.col("_lo")))
    )
    if hot is None:
        return df.withColumn(CHUNK, F.lit(0).cast("bigint")), False
    pieces = F.ceil(F.col("_n") * OVERSPLIT / F.lit(chunk_rows))
    share = (pos - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    chunk = F.least(F.floor(share * pieces), pieces - 1)
    out = null_safe_join(df, hot, list(by), "left").withColumn(
        CHUNK, F.coalesce(chunk, F.lit(0)).cast("bigint")
    )
    return out.drop("_n", "_lo", "_hi"), True


def with_lookback(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    lookback: int,
    compute: Callable[[DataFrame, list[str]], DataFrame],
    chunk_rows: int | None = CHUNK_ROWS,
    inputs: Sequence[str] | None = None,
) -> DataFrame:
    """Run ``compute(df, partition_columns)``, whose windows look at most ``lookback`` rows back.

    With hot keys, every slice is given the last ``lookback`` rows before it and drops them afterwards.
    ``inputs`` names the columns the windows read, so that carried rows stay narrow.
    """
    sliced, split = assign_chunks(df, by, order[0], chunk_rows)
    return lookback_on(sliced, split, by, order, lookback, compute, inputs).drop(CHUNK)


def lookback_on(sliced, split, by, order, lookback, compute, inputs=None) -> DataFrame:
    """``with_lookback`` over rows that already have their slice."""
    by, order = list(by), list(order)
    parts = [*by, CHUNK]
    if not split:
        return compute(sliced, parts)

    carried = list(dict.fromkeys([*by, *order, *(inputs or [c for c in sliced.columns if c != CHUNK])]))
    backwards = Window.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        sliced.select(*carried, CHUNK)
        .withColumn("_rn", F.row_number().over(backwards))
        .where(F.col("_rn") <= lookback)
        .groupBy(*parts)
        .agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in carried if c not in order]))).alias("_tail"))
    )
    # Every slice in the table is non-empty, so `lookback` earlier slices always suffice.
    before = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(-lookback, -1)
    flat = F.flatten(F.collect_list("_tail").over(before))
    carry = (
        tails.withColumn("_all", flat)
        .withColumn("_keep", F.greatest(F.size("_all") - lookback, F.lit(0)))
        .select(CHUNK, F.explode(F.expr("slice(_all, _keep + 1, greatest(size(_all), 1))")).alias("_row"))
        .select(CHUNK, "_row.*", F.lit(True).alias("_carried"))
    )
    both = sliced.withColumn("_carried", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    return compute(both, parts).where(~F.col("_carried")).drop("_carried")


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``."""
    sliced, split = assign_chunks(df, by, order[0], chunk_rows)
    return running_sum_on(sliced, split, by, order, value, out).drop(CHUNK)


def running_sum_on(sliced, split, by, order, value, out) -> DataFrame:
    """``running_sum`` over rows that already have their slice."""
    by = list(by)
    parts = [*by, CHUNK]
    upto = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn(out, F.sum(value).over(upto))
    if not split:
        return local
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        sliced.groupBy(*parts)
        .agg(F.sum(value).alias("_total"))
        .select(*parts, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    )
    return null_safe_join(local, totals, parts, "left").withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def row_index(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str,
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """1-based position of every row within its key."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(ones, by, order, "_one", out, chunk_rows).drop("_one")


def rank_within(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    out: str,
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """1-based rank within each group for any ordering.

    A window when every group fits one task. Otherwise the rows are range-sorted on (group, order), so a
    hot group spreads, and a row's rank is its overall position less that of its group's first row.
    """
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if not chunk_rows or sizes.where(F.col("_n") > chunk_rows).isEmpty():
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    placed = global_index(df, [*by, *order], "_pos")
    first = placed.groupBy(*by).agg(F.min("_pos").alias("_first"))
    return null_safe_join(placed, first, by).withColumn(out, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")
