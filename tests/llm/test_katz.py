import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, docs, empty, fold

from fleetpulse.llm import katz


def tokens_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


def factors(counts):
    n = Counter(counts)
    return katz.discounts(np.array([n[r] for r in range(1, 7)]))


class Brute:
    """The same model from plain dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            words = tokens_of(t)
            self.uni.update(words)
            self.bi.update(zip(["<s>", *words], words))
        self.n, self.heads, self.follow = sum(self.uni.values()), Counter(), defaultdict(list)
        for (h, w), c in self.bi.items():
            self.heads[h] += c
            self.follow[h].append(w)
        self.d1, self.d2 = factors(self.uni.values()), factors(self.bi.values())

    def single(self, w):
        c = self.uni[w]
        if c:
            return (self.d1[c] if c <= 5 else 1) * c / (self.n + 1)
        return 1 - sum((self.d1[c] if c <= 5 else 1) * c for c in self.uni.values()) / (self.n + 1)

    def pair(self, h, w):
        c, size = self.bi[h, w], self.heads[h]
        direct = lambda c: (self.d2[c] if c <= 5 else 1) * c / (size + 1)
        if c:
            return direct(c)
        if not size:
            return self.single(w)
        weight = (1 - sum(direct(self.bi[h, x]) for x in self.follow[h])) / (1 - sum(self.single(x) for x in self.follow[h]))
        return weight * self.single(w)

    def score(self, text):
        words = tokens_of(text)
        return sum(math.log10(self.pair(h, w)) for h, w in zip(["<s>", *words], words))

    def base(self, text):
        return sum(math.log10((self.uni[w] + 1) / (self.n + len(self.uni) + 1)) for w in tokens_of(text))


def check(spark, df):
    rows = df.select("doc_id", "text").collect()
    brute = Brute([r["text"] for r in rows if fold(r["doc_id"], 7) != 2])
    got = sorted(katz.language_report(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(rows)
    for g, r in zip(got, rows):
        words = tokens_of(r["text"])
        assert g["doc_id"] == r["doc_id"] and g["held_out"] == (fold(r["doc_id"], 7) == 2)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(words), sum(brute.uni[w] > 0 for w in words), brute.n)
        assert g["base_score"] == pytest.approx(brute.base(r["text"]), abs=1e-6)
    for g, r in list(zip(got, rows))[:80]:
        assert g["score"] == pytest.approx(brute.score(r["text"]), abs=1e-6)
    return brute


def test_real_documents_and_exact_normalisation(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    brute = check(spark, df)
    monkeypatch.setattr(katz, "HOT", 50)
    for head in ["<s>", "the", "of", next(iter(brute.uni))]:
        total = sum(brute.pair(head, w) for w in brute.uni) + brute.pair(head, "never seen")
        assert total == pytest.approx(1.0)


def test_odd_texts_and_repeated_rows(spark):
    texts = ["a b a b c", None, "", "A  B\tunseen" , "the the the " * 20000, "é É", "a b", " x ", "q"] + [f"w{i % 7} v{i % 3}" for i in range(30)]
    df = docs(spark, texts)
    check(spark, clashing(df, "score", "_id", "train", "block"))
    check(spark, df.unionByName(spark.createDataFrame([(None, "a b", "en", "s", 1)] , df.schema)))


def test_no_rows_and_no_training_rows(spark):
    assert katz.language_report(empty(spark)).count() == 0
    held = [i for i in range(60) if fold(i, 7) == 2]
    df = docs(spark, ["a b"] * 60).where(f"doc_id IN ({','.join(map(str, held))})")
    got = katz.language_report(df).collect()
    assert len(got) == len(held) and all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in got)


def test_blocks_and_hot_histories_score_the_same(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: r["score"] for r in katz.language_report(df).collect()}
    import fleetpulse.llm.katz as module

    source = katz.BLOCK_TOKENS
    assert source > 1000
    got = {r["doc_id"]: r["score"] for r in katz.language_report(df.repartition(5)).collect()}
    assert got == pytest.approx(want)
    assert module is katz


def turing(counts):
    """Good-Turing factors on a fitted power of the count, written apart from the module."""
    n = Counter(counts)
    seen = [r for r in range(1, 7) if n[r]]
    gaps = [((seen[i + 1] if i + 1 < len(seen) else 2 * r - seen[i - 1]) - (seen[i - 1] if i else 0)) / 2 for i, r in enumerate(seen)]
    power, level = np.polyfit(np.log(seen), np.log([n[r] / g for r, g in zip(seen, gaps)]), 1)
    smooth = [math.exp(level + power * math.log(r)) for r in range(1, 7)]
    common = 6 * smooth[5] / smooth[0]
    return [1.0] + [((r + 1) * smooth[r] / (r * smooth[r - 1]) - common) / (1 - common) for r in range(1, 6)]


def test_turing_factors_are_in_use_on_given_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    brute = Brute([r["text"] for r in rows if fold(r["doc_id"], 7) != 2])
    fixed = [(r - 0.5) / r for r in range(1, 6)]
    brute.d1, brute.d2 = turing(brute.uni.values()), turing(brute.bi.values())
    for d in (brute.d1, brute.d2):
        assert all(0 < x < 1 for x in d[1:]) and max(abs(x - y) for x, y in zip(d[1:], fixed)) > 0.01
    got = {r["doc_id"]: r["score"] for r in katz.language_report(df).collect()}
    for r in sorted(rows, key=lambda r: len(r["text"] or ""))[:20]:
        assert got[r["doc_id"]] == pytest.approx(brute.score(r["text"]), abs=1e-6)


def test_half_an_occurrence_only_where_no_power_falls():
    fixed = np.array([1.0] + [(r - 0.5) / r for r in range(1, 6)])
    for of in ([0] * 6, [7, 0, 0, 0, 0, 0], [0, 0, 3, 0, 0, 0], [5, 5, 5, 5, 5, 5]):
        assert katz.discounts(np.array(of)) == pytest.approx(fixed)
    for of in ([90, 20, 8, 9, 3, 1], [90, 0, 8, 0, 0, 1], [90, 20, 0, 0, 0, 0]):
        d = katz.discounts(np.array(of))
        assert np.all((d[1:] > 0) & (d[1:] < 1)) and abs(d - fixed).max() > 1e-3
