import numpy as np
import pytest
import xxhash
from helpers import clashing, components, docs, empty

from fleetpulse.llm import graph, simhash


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check(spark, texts, **kw):
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs(spark, texts), **kw).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = components(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_edge_texts(spark):
    check(spark, [None, "", " \t", "One", "one", "a b", "a b c", "A  B\nC", "é É x", "a b c d " * 30000, "w " * 400])


def test_real_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in simhash.simhash_components(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert all(got[r["doc_id"]]["component_id"] == rows[w]["doc_id"] for r, w in zip(rows, want))


def test_empty_table_and_clashing_columns(spark):
    assert simhash.simhash_components(empty(spark)).count() == 0
    df = clashing(docs(spark, ["a b c", "a b c"]), "_fp", "_run", "_id", "fingerprint", "component_id")
    assert {tuple(r)[2] for r in simhash.simhash_components(df).collect()} == {0}


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "q"), (5, "a b"), (5, "a b")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] is None, r["component_id"] is None) for r in simhash.simhash_components(df).collect())
    assert got == [(False, False), (False, False), (True, False), (True, True)]


@pytest.mark.parametrize("radius", [2, 3])
def test_split_shards_find_every_link(spark, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 900)] ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64)
    )
    fps = np.unique(np.concatenate([base, near]))
    nodes = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(fps.view(np.int64))], "_id bigint, _fp bigint")
    shards = simhash.vantage_shards(nodes, radius, cap=100)
    assert shards.select("_leaf").distinct().count() > 4
    found = graph.components(simhash.hamming_links(nodes, radius, cap=100)).collect()
    root = {r["node"]["id"]: r["root"]["id"] for r in found}
    want = components(len(fps), lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j])) <= radius)
    assert [root.get(i, i) for i in range(len(fps))] == want


def test_tree_nodes_prune_and_dense_groups_stay_whole():
    rng = np.random.default_rng(5)
    spread = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    dense = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 60, (2500, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64))
    fps = np.unique(np.concatenate([spread, dense]))
    groups = simhash.vp_links(fps, 2)
    parent = list(range(len(fps)))
    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for r, members in groups:
        for m in members:
            a, b = top(r), top(int(m))
            parent[max(a, b)] = min(a, b)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    for i, j in np.argwhere(np.triu(near, 1)):
        assert top(int(i)) == top(int(j))


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(500, 500)]
    found = graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    root = {r["node"]: r["root"] for r in found}
    assert root == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 300)}}


def kept_by_brute_force(texts):
    fps = [brute_fingerprint(t) for t in texts]
    group = components(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    return sorted(i for i, g in enumerate(group) if i == g)


def near_texts(seed=8):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(40):
        words = [f"w{rng.integers(4000)}" for _ in range(int(rng.integers(20, 900)))]
        texts.append(" ".join(words))
        for _ in range(int(rng.integers(0, 5))):
            edited = list(words)
            edited[int(rng.integers(len(words)))] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(edited if rng.random() < 0.7 else words))
    return texts + ["one two", "One two", "", None, " ", "one two three four five six"]


def test_one_row_of_each_component_stays(spark):
    texts = near_texts()
    df = docs(spark, texts)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = kept_by_brute_force(texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == want and len(want) < len(texts) - 20


def test_near_duplicates_of_repeated_rows_nulls_and_no_rows(spark):
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0
    rows = [(None, "a b c d e f", "x")] * 3 + [(4, "A b c d e f", None)] * 2 + [(5, "other words here", None)] * 2 + [(None, "third", "y")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _key string")
    kept = simhash.drop_near_duplicates(df)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert kept.columns == df.columns and got == [(4, "A b c d e f"), (5, "other words here"), (None, "third")]
