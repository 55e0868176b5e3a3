"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times its documents are repeated so that the mixture meets the
target weights. Each document inverts the Poisson distribution of its source at a uniform number drawn
from a digest of its key, is exploded by that count, and all copies are shuffled by a digest of
(key, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.plans.tables import broadcast_if_small, materialize

# Share of a source in the mixture without explicit weights: its size to this power.
TEMPERATURE = 0.7
UNKNOWN = "(none)"
# A 52-bit uniform number never exceeds the sum of the terms within 12 deviations and 60 above the mean.
DRAW_BITS = 52


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, temperature: float = TEMPERATURE
) -> DataFrame:
    """One row per source: bytes, target share and mean repetition rate.

    The mixture holds ``budget`` bytes (default: as many as ``docs``). With ``weights``, other
    sources get rate 0; without, shares follow bytes ** temperature. Null sources count as one source,
    empty documents as one byte.
    """
    size = F.greatest(F.octet_length(F.coalesce(F.col("text"), F.lit(""))), F.lit(1)).cast("bigint")
    source = F.coalesce(F.col("source").cast("string"), F.lit(UNKNOWN))
    sizes = docs.select(source.alias("_source"), size.alias("_bytes")).groupBy("_source").agg(F.sum("_bytes").alias("_bytes"))
    if weights is None:
        share = F.pow(F.col("_bytes").cast("double"), F.lit(float(temperature)))
    else:
        if min(weights.values(), default=0.0) < 0:
            raise ValueError("weights must not be negative")
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("_source") == name, F.lit(float(w))).otherwise(share)
    everything = Window.partitionBy(F.lit(0))  # one row per source
    total = F.lit(float(budget)) if budget is not None else F.sum("_bytes").over(everything).cast("double")
    shares = sizes.withColumn("_share", share)
    mass = F.sum("_share").over(everything)
    shares = shares.withColumn("_share", F.when(mass > 0, F.col("_share") / mass).otherwise(0.0)).withColumn("_total", total)
    return shares.select("_source", "_bytes", "_share", (F.col("_share") * F.col("_total") / F.col("_bytes")).alias("_rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """Adds ``_steps``: the cumulative Poisson probabilities of each source, from 0 repetitions on."""
    terms = rates.select(
        "_source", "_rate", F.explode(F.expr("sequence(0, CAST(ceil(_rate + 12 * sqrt(_rate) + 60) AS INT))")).alias("_k")
    )
    upto = Window.partitionBy("_source").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.log(F.greatest("_k", F.lit(1)).cast("double"))).over(upto)
    logp = F.when(F.col("_rate") > 0, F.col("_k") * F.log("_rate") - F.col("_rate") - log_factorial).otherwise(
        F.when(F.col("_k") == 0, F.lit(0.0)).otherwise(F.lit(-1e9))
    )
    cumulated = terms.withColumn("_p", F.exp(logp)).withColumn("_upto", F.sum("_p").over(upto))
    return cumulated.groupBy("_source").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_k", "_upto"))), lambda x: x["_upto"]).alias("_steps")
    )


def draw(seed: int, key: Column) -> Column:
    """Uniform number in (0, 1) from a digest of the seed and the key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, DRAW_BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**DRAW_BITS))


def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget: float | None = None,
    temperature: float = TEMPERATURE,
    seed: int = 17,
    key: str = "doc_id",
    copy: str = "copy",
    order: str = "mix_key",
) -> DataFrame:
    """The mixture: each row as often as its draw says, with its copy number from 1, in shuffled order.

    Equal keys (null is one key) of one source draw equal counts; repeated rows are replicated one by one.
    Every column of ``docs`` is kept, but for any named ``copy`` or ``order``, which are replaced.
    """
    rates = materialize(source_rates(docs, weights, budget, temperature), "rates")
    steps = broadcast_if_small(materialize(poisson_steps(rates), "poisson"))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    names = [c for c in docs.columns if c not in (copy, order)]
    counted = (
        docs.select(*names)
        .withColumn("_source", F.coalesce(F.col("source").cast("string"), F.lit(UNKNOWN)))
        .join(steps, "_source")
        .withColumn("_u", draw(seed, name))
        .withColumn("_times", F.expr("size(filter(_steps, x -> x <= _u))"))
        .where("_times > 0")
    )
    copies = counted.select(*names, F.explode(F.expr("sequence(1, _times)")).alias(copy))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), name, F.lit("|"), F.col(copy).cast("string")))
    keyed = copies.withColumn(order, digest)
    return keyed.repartition(order).sortWithinPartitions(order)
