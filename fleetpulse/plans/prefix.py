"""Cumulative counts over ordered values without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.plans.tables import few_rows, materialize, null_safe_join


def value_bucket(value: Column) -> Column:
    """Monotone bucket number of a double: logarithmic in size, mirrored for negatives.

    65,536 buckets per factor e: a bucket holds a few millionths of a spread-out score's values, and the
    table of buckets stays at a few million rows whatever the data.
    """
    size = F.log(F.greatest(F.abs(value), F.lit(1e-12))) + F.lit(27.7)
    return F.floor(F.signum(value) * size * F.lit(65536.0)).cast("bigint")


def is_number(value: str) -> Column:
    """Neither NULL nor NaN: a NaN has no rank."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def cumulative_counts(
    df: DataFrame, by: Sequence[str], value: str, sums: dict[str, Column]
) -> DataFrame:
    """One row per (by, distinct value) with each sum and its total over smaller values (``<name>_below``).

    Rows collapse to distinct values map-side first, then a running total inside value buckets is
    shifted by the totals of lower buckets, so no task ever orders a whole group.
    """
    by = list(by)
    per_value = (
        df.groupBy(*by, value)
        .agg(*[c.cast("bigint").alias(n) if n else c for n, c in sums.items()])
        .withColumn("_bucket", value_bucket(F.col(value)))
    )
    keys = [*by, "_bucket"]
    lower = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = per_value.groupBy(*keys).agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    buckets = buckets.select(
        *keys, *[F.coalesce(F.sum(f"_{n}").over(lower), F.lit(0)).alias(f"_{n}_off") for n in sums]
    )
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return null_safe_join(per_value, buckets, keys).select(
        *by,
        value,
        *sums,
        *[
            (F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_{n}_off")).alias(f"{n}_below")
            for n in sums
        ],
    )


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Linearly interpolated percentiles per group, exact, for groups of any size.

    A row counts as often as its ``weight`` says.
    """
    by = list(by)
    times = F.sum(weight) if weight else F.count(F.lit(1))
    ranked = cumulative_counts(df.where(is_number(value)), by, value, {"cnt": times})
    totals = ranked.groupBy(*by).agg(F.sum("cnt").alias("_n"))
    if by:
        ranked = null_safe_join(ranked, totals, by)
    else:
        ranked = ranked.crossJoin(F.broadcast(totals))  # one row
    aggs, out = [], []
    for name, q in qs.items():
        pos = f"((_n - 1) * {float(q)!r}D)"
        at = lambda i: f"max(CASE WHEN cnt_below <= {i} AND {i} < cnt_below + cnt THEN `{value}` END)"
        aggs += [
            F.expr(f"{at(f'floor({pos})')} AS `_{name}_lo`"),
            F.expr(f"{at(f'ceil({pos})')} AS `_{name}_hi`"),
            F.expr(f"max({pos} - floor({pos})) AS `_{name}_w`"),
        ]
        out.append(f"`_{name}_lo` + (`_{name}_hi` - `_{name}_lo`) * `_{name}_w` AS `{name}`")
    return ranked.groupBy(*by).agg(*aggs).selectExpr(*[f"`{b}`" for b in by], *out)


def order_statistics(df: DataFrame, by: Sequence[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Values at 0-based sorted positions; each pick is an expression over the group size ``n``."""
    by = list(by)
    ranked = cumulative_counts(df.where(is_number(value)), by, value, {"cnt": F.count(F.lit(1))})
    totals = ranked.groupBy(*by).agg(F.sum("cnt").alias("n"))
    ranked = null_safe_join(ranked, totals, by) if by else ranked.crossJoin(F.broadcast(totals))
    inside = lambda i: (F.col("cnt_below") <= i) & (i < F.col("cnt_below") + F.col("cnt"))
    return ranked.groupBy(*by, "n").agg(
        *[F.max(F.when(inside(i), F.col(value))).alias(name) for name, i in picks.items()]
    )


def mark_smallest(
    df: DataFrame,
    strata: Sequence[str],
    quota: Column,
    key: Sequence[str],
    seed: int,
    out: str = "in_sample",
) -> DataFrame:
    """Flag exactly ``quota`` rows per stratum: those with the smallest ``md5(seed|key)``."""
    text = ", ".join(f"CAST(`{k}` AS STRING)" for k in key)
    hashed = df.selectExpr("*", f"md5(concat_ws('|', '{seed}', {text})) AS _hash")
    return mark_first(hashed, strata, quota, ["_hash", *key], "substring(_hash, 1, 4)", out).drop("_hash")


def mark_first(
    df: DataFrame, strata: Sequence[str], quota: Column, order: Sequence[str], bucket: str, out: str
) -> DataFrame:
    """Flag exactly the first ``quota`` rows of every stratum in ``order``.

    ``quota`` is an expression over the stratum size ``n``; ``bucket`` is a coarse SQL expression that
    grows with ``order``. Counts per bucket locate the one in which each stratum's quota is reached;
    ranking only the rows of that bucket gives the last row that belongs. Every row is then decided by
    comparing itself with it: the flagged data is never shuffled.
    """
    strata, order = list(strata), list(order)
    group = ", ".join(f"`{s}`" for s in strata) or "0"
    keys = ", ".join(f"`{k}`" for k in order)
    on = lambda left, right, how: null_safe_join(left, right, strata, how)
    bucketed = df.selectExpr("*", f"{bucket} AS _bucket")
    cut = (
        bucketed.groupBy(*strata, "_bucket")
        .agg(F.expr("count(1) AS _c"))
        .selectExpr(
            "*",
            f"sum(_c) OVER (PARTITION BY {group}) AS n",
            f"sum(_c) OVER (PARTITION BY {group} ORDER BY _bucket) AS _upto",
        )
        .withColumn("_quota", F.least(quota.cast("bigint"), F.col("n")))
        .where("_upto >= _quota AND _upto - _c < _quota")
        .selectExpr(*[f"`{s}`" for s in strata], "_bucket AS _cut", "_quota - (_upto - _c) AS _need")
    )
    last = (
        on(bucketed, few_rows(cut), "inner")
        .where("_bucket = _cut")
        .selectExpr("*", f"row_number() OVER (PARTITION BY {group} ORDER BY {keys}) AS _rank")
        .where("_rank = _need")
        .selectExpr(*[f"`{s}`" for s in strata], f"struct({keys}) AS _last")
    )
    names = [f"`{c}`" for c in df.columns]
    return on(df, few_rows(last), "left").selectExpr(*names, f"coalesce(struct({keys}) <= _last, false) AS `{out}`")


def global_index(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """1-based position in a total order: range-sorted once, then offset per sorted partition.

    ``order`` should be unique; the sort samples its ranges on the whole key, so a hot leading value
    still spreads.
    """
    placed = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_mid", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    )
    # One row per partition of the sort: bounded by spark.sql.shuffle.partitions.
    local = F.col("_mid") - F.shiftleft(F.col("_part"), 33)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_off") + local + 1).cast("bigint"))
        .drop("_mid", "_part", "_off")
    )
