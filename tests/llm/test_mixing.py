import hashlib
import math
from collections import Counter

import pytest
from helpers import clashing, docs, empty

from fleetpulse.llm import mixing


def uniform(key, seed=17):
    return (int(hashlib.md5(f"{seed}|{'null' if key is None else key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def poisson(u, rate):
    k, upto = 0, math.exp(-rate)
    while u >= upto and k < 10_000:
        k += 1
        upto += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else 0.0
    return k


def rates(df, weights=None, budget=None):
    return {r["_source"]: r["_rate"] for r in mixing.source_rates(df, weights, budget).collect()}


def test_counts_invert_the_distribution(spark):
    df = spark.range(900).selectExpr("id AS doc_id", "repeat('w', 40) AS text", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 30 = 1 THEN 'b' ELSE NULL END AS source")
    weights = {"a": 0.2, "b": 0.5, mixing.UNKNOWN: 0.3}
    rate = rates(df, weights)
    got = Counter(r["doc_id"] for r in mixing.replicate(df, weights).collect())
    for r in df.collect():
        assert got[r["doc_id"]] == poisson(uniform(r["doc_id"]), rate[r["source"] or mixing.UNKNOWN])
    sums = Counter()
    for r in df.collect():
        sums[r["source"]] += got[r["doc_id"]]
    assert sums["b"] / sum(sums.values()) == pytest.approx(0.5, abs=0.1)
    assert sum(sums.values()) == pytest.approx(900, rel=0.1)


def test_copies_are_numbered_and_shuffled_for_any_partitioning(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    one = sorted(map(tuple, mixing.replicate(df).collect()), key=repr)
    assert one == sorted(map(tuple, mixing.replicate(df.repartition(7)).collect()), key=repr)
    copies = {}
    for r in mixing.replicate(df).collect():
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    order = [r["mix_key"] for r in mixing.replicate(df).coalesce(1).collect()]
    assert len(set(order)) == len(order)


def test_absent_sources_high_rates_and_odd_rows(spark):
    df = clashing(docs(spark, ["a", None, "", "b" * 50000, "c", "c"]), "copy", "_rate", "_source", "mix_key")
    got = mixing.replicate(df, {"src0": 1.0}, budget=3e6).collect()
    assert {r["source"] for r in got} == {"src0"} and got[0].asDict().keys() == {*df.columns}
    repeated = mixing.replicate(df.unionByName(df)).collect()
    assert len(repeated) == 2 * len(mixing.replicate(df).collect())


def test_zero_weights_and_no_rows(spark):
    assert mixing.replicate(docs(spark, ["a", "b"]), {"src0": 0.0}).count() == 0
    assert mixing.replicate(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.replicate(empty(spark), {"x": -1.0})
