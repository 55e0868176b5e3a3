import hashlib
import math
import zlib

import pytest
from helpers import clashing, docs, empty

from fleetpulse.llm import sharding


def brute(key, weights):
    times = []
    for s, w in enumerate(weights):
        digest = hashlib.md5(f"{'null' if key is None else key}|{s // 4}".encode()).hexdigest()
        u = (int(digest[s % 4 * 8 : s % 4 * 8 + 8], 16) + 0.5) / 2**32
        times.append((-math.log(u) / w, s))
    return min(times)[1]


def test_shards_follow_the_weights_and_few_rows_move(spark):
    weights = [1.0, 2.0, 3.0, 4.0]
    rows = sharding.assign_shards(spark.range(4000).withColumnRenamed("id", "doc_id"), weights=weights, added_weight=2.0).collect()
    assert all(r["shard"] == brute(r["doc_id"], weights) and r["grown_shard"] == brute(r["doc_id"], [*weights, 2.0]) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    for s, w in enumerate(weights):
        assert sum(r["shard"] == s for r in rows) / 4000 == pytest.approx(w / 10, abs=0.03)


def test_report(spark):
    texts = ["a", None, "", "é" * 3, "long " * 40000, "a", "a"] + ["x"] * 300
    df = docs(spark, texts)
    df = clashing(df.unionByName(df.where("doc_id < 3")).unionByName(df.where("doc_id = 5").withColumn("doc_id", df.doc_id * None)), "shard", "slot", "size", "_n")
    got = sharding.shard_report(df).collect()
    assert len(got) == df.count()
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "a"
        data = (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert (r["shard"], r["grown_shard"]) == (brute(r["doc_id"], [1.0] * 40), brute(r["doc_id"], [1.0] * 41))
    for s in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_many_equal_rows_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EXPLODE_ROWS", 7)
    df = spark.range(100).selectExpr("id % 2 AS doc_id", "'t' AS text")
    got = sharding.shard_report(df).collect()
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_empty_table_and_bad_weights(spark):
    assert sharding.shard_report(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(empty(spark), weights=[1.0, 0.0])
