import random

import pytest
from helpers import clashing, docs, empty

from fleetpulse.llm import decontam

ITEM_SCHEMA = "item_id bigint, text string"


def best_match(item, text):
    """Fewest edits of the whole item against any part of the text, by plain dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def plain(text):
    return " ".join(text.lower().split())


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("qrstuvw")
        elif kind == 1:
            chars.insert(at, rng.choice("qrstuvw"))
        else:
            del chars[at]
    return "".join(chars)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    items = [words(rng, rng.randint(5, 30)) for _ in range(8)]
    texts = []
    for k in range(60):
        item = rng.choice(items)
        middle = edited(rng, item, rng.randint(0, len(item) // 6)) if k % 3 else words(rng, 10)
        texts.append(words(rng, rng.randint(0, 40)) + " " + middle + "  " + words(rng, 9))
    got = decontam.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), ITEM_SCHEMA)).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
    index = decontam.Index(list(range(8)), items)
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            edits = best_match(plain(item), plain(text))
            if edits <= index.budget[i]:
                want[d, i] = edits
    assert got == want
    assert len(want) > 20


def test_case_space_and_spans(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank"
    text = "É start. THE  quick\nbrown fox jumps over the lazy dog near the river BANK and on"
    (row,) = decontam.leaks(docs(spark, [text]), spark.createDataFrame([(7, item)], ITEM_SCHEMA)).collect()
    assert (row["item_id"], row["edits"]) == (7, 0)
    assert plain(row["passage"]) == plain(item) and text[row["start"] : row["end"]] == row["passage"]


@pytest.mark.parametrize("text", [None, "", " ", "x", "aaaaaaaa" * 2000, "ab cd " * 100000])
def test_odd_texts(spark, text):
    items = spark.createDataFrame([(1, "aaaaaaaaaaaaaaaaaaaaaab"), (2, None), (3, "short"), (4, "")], ITEM_SCHEMA)
    assert decontam.leaks(docs(spark, [text]), items).where("item_id > 1").count() == 0
    assert decontam.drop_leaking(docs(spark, [text, "clean words here"]), items).count() >= 1


def test_empty_tables_and_clashing_columns(spark):
    item = "one passage of a benchmark that is long enough"
    items = spark.createDataFrame([(1, item)], ITEM_SCHEMA)
    assert decontam.leaks(empty(spark), items).count() == 0
    assert decontam.leaks(docs(spark, [item]), spark.createDataFrame([], ITEM_SCHEMA)).count() == 0
    df = clashing(docs(spark, [item, "clean", item]), "item_id", "start", "edits")
    assert decontam.leaks(df, items).count() == 2
    kept = decontam.drop_leaking(df, items)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_blocks_and_chunks_find_the_same(spark, sf, monkeypatch):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontam.leaks(d, b).collect()))
    assert want
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 3000)
    assert sorted(map(tuple, decontam.leaks(d, b).collect())) == want
    index = decontam.Index([r["item_id"] for r in b.collect()], [r["text"] for r in b.collect()])
    texts = [r["text"] for r in d.collect()]
    whole = [decontam.find_leaks(index, t) for t in texts]
    monkeypatch.setattr(decontam, "CHUNK", 700)
    assert [decontam.find_leaks(index, t) for t in texts] == whole
