import hashlib
import re

import pytest
from helpers import clashing, docs, empty

from fleetpulse.llm import exact


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        size, _, best = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))
        kept = i == best and len(t or "") == -size
        out.append((i, best, len(groups[norm]), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("runs", [512, 3, 1])
def test_groups(spark, runs):
    texts = [None, "", "  ", "a b", "ab", "a  b", "a b", "é", "É", "x " * 50000, "x" * 50000, "ab"] + ["same text"] * 40
    df = docs(spark, texts)
    df = df.unionByName(df.where("doc_id IN (3, 5)")).unionByName(spark.createDataFrame([(None, "ab", "en", "s", 2), (None, "only null", "en", "s", 2)], df.schema))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = exact.exact_groups(clashing(df, "_digest", "_run", "kept", "_id"), runs=runs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_real_documents_and_empty_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted((tuple(r) for r in exact.exact_groups(df).collect()), key=repr) == brute(rows)
    assert exact.exact_groups(empty(spark)).count() == 0
