import numpy as np
from helpers import clashing, docs, empty, fold

from fleetpulse.llm import langid


def brute(text, prototypes):
    """Prediction from one vector per letter and n-gram, without any caching."""
    v = langid.Vectors()
    clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    clean = f" {' '.join(clean.split())} " if clean.strip() else ""
    total = np.zeros(v.dimensions)
    for i in range(len(clean) - 2):
        gram = np.ones(v.dimensions)
        for place in range(3):
            c = clean[i + place]
            gram = gram * np.roll(v.letter(0 if c == " " else ord(c) + 1).astype(float), 2 - place)
        total += gram
    if not np.any(total):
        return "und", 0.0
    cosines = {k: float(p @ total / np.linalg.norm(p) / np.linalg.norm(total)) for k, p in sorted(prototypes.items())}
    best = max(cosines, key=cosines.get)
    return best, min(1.0, max(0.0, cosines[best]))


def test_held_out_accuracy_and_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(table).collect()}
    rows = table.collect()
    prototypes = langid.collect_prototypes(langid.fit_prototypes(langid.training_rows(table)))
    held = [r for r in rows if fold(r["doc_id"], 5) == 0]
    assert all(got[r["doc_id"]]["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    for r in rows[:40]:
        label, score = brute(r["text"], prototypes)
        assert got[r["doc_id"]]["lang_pred"] == label and abs(got[r["doc_id"]]["score"] - score) < 1e-5


def test_prototypes_are_sums_for_any_partitioning(spark, sf):
    table = langid.training_rows(spark.read.parquet(f"{sf}/documents.parquet"))
    a = langid.collect_prototypes(langid.fit_prototypes(table))
    b = langid.collect_prototypes(langid.fit_prototypes(table.repartition(7)))
    assert all(np.array_equal(a[k], b[k]) for k in a) and a.keys() == b.keys()


def test_odd_texts(spark):
    texts = ["the cat and the dog", None, "", "123 !?", "The Dog", "le chat et le chien", "中文" * 60000, "a"]
    df = clashing(docs(spark, texts), "score", "lang_pred", "held_out")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, "abc", None), (None, "x", None)], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(df).collect()} == {"und"}
    assert langid.identify(empty(spark)).count() == 0


def test_chunks_count_the_same_grams(monkeypatch):
    text = "The quick, brown fox.  Élan vital? " * 50
    want = langid.gram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    got = langid.gram_counts(text)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_rejection_keeps_columns(spark):
    prototypes = langid.collect_prototypes(langid.fit_prototypes(docs(spark, ["the cat and the dog"] * 3)))
    df = docs(spark, ["the dog", None, "42", "the cat and"])
    kept = langid.keep_known(df, prototypes)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3]
