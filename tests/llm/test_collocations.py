import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, empty

from fleetpulse.llm import collocations

UPPER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def brute(rows, least=30, cover=80, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                covered |= {q for q in (p[i : i + n] for i in range(len(p) - n + 1)) if 100 * a >= cover * f[q]}
        kept = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found(table, **options):
    return sorted(tuple(r) for r in collocations.collocations(table, **options).collect())


SCHEMA = "doc_id bigint, text string, lang string"


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "hall", "a", "é", "日本", "x-ray", "b c", "St", "d\x0be"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts.append(rng.choice(["new york city hall", "New York", "the of", rng.choice(words), rng.choice(words)]))
            parts.append(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ! "]))
        out.append((i, "".join(parts), rng.choice(["en", "en", "fr", None, "und", ""])))
    return [*out, (900, None, "en"), (901, "", None), (902, "...,,, \n", "fr"), (None, "new york city hall", "xx")]


@pytest.mark.parametrize("sample,least,top", [(1, 12, 15), (3, 2, 2000), (1000, 2, 2000)])
def test_against_brute_force_whatever_the_sample(spark, sample, least, top):
    rows = corpus(1)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute([r[1:] for r in rows], least=least, top=top)
    assert len(want) > 20 and found(table, sample=sample, least=least, top=top) == want


def test_border_failures_add_passes_until_closed(spark, monkeypatch):
    rows = [(i, "alpha beta gamma delta" if i % 4 else "other words here", "en") for i in range(80)]
    table = spark.createDataFrame(rows, SCHEMA)
    passes = []
    for name in ("count_keys", "count_exactly"):
        count = getattr(collocations, name)
        monkeypatch.setattr(collocations, name, lambda *a, name=name, count=count: passes.append(name) or count(*a))
    got = found(table, sample=10**9)  # nothing is drawn, nothing proposed
    assert got == brute([r[1:] for r in rows]) and len(got) > 0
    # the empty sample, the full pass (pairs), then one pass each for triples (pairs again, exactly) and quadruples
    assert passes == ["count_keys"] * 2 + ["count_exactly"] * 2


def test_chunks_and_segments_lose_and_repeat_nothing(spark, monkeypatch):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "be", "c", "delta,", "ee"]) for _ in range(3000))
    texts = [long, "w" * 500 + " alpha be " * 40 + "w" * 500, long[:777], "be c", "y" * 300 + ". " + "z" * 300]
    tokens = collocations.Tokens()
    whole = [np.concatenate(x) for x in zip(*[tokens.words(*s)[:2] for s in tokens.segments([t.encode() for t in texts], ["en"] * 5)])]
    monkeypatch.setattr(collocations, "SEGMENT", 200)
    small = collocations.Tokens()
    segments = list(small.segments([t.encode() for t in texts], ["en"] * 5))
    cut = [small.words(*s) for s in segments]
    spelled = [s[0][b:e] for s, c in zip(segments, cut) for b, e in zip(c[3], c[4])]
    assert spelled == [w.encode() for t in texts for p in pieces(t) for w in p]
    assert np.concatenate([c[1] for c in cut]).tolist() == whole[1].tolist()
    assert np.concatenate([c[0] for c in cut]).tolist() == whole[0].tolist()  # also beside words longer than a segment
    counts = Counter()
    kept, left = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut])
    every = np.full(1 << 10, 255, dtype=np.uint8)
    total = Counter()
    for columns, keys, times in collocations.reachable(kept, left, len(kept), every, None, 4):
        assert len(set(keys.tolist())) == len(keys)
        total.update(dict(zip(zip(*columns), times.tolist())))
    for start in range(0, len(kept), 50):
        stop = min(len(kept), start + 53)
        owned = 50 if start + 50 < len(kept) else stop - start
        for columns, _, times in collocations.reachable(kept[start:stop], left[start:stop], owned, every, None, 4):
            counts.update(dict(zip(zip(*columns), times.tolist())))
    assert counts == total


def test_keys_that_meet_never_count_too_little(monkeypatch):
    monkeypatch.setattr(collocations, "KEY_BITS", 4)  # 16 keys for all phrases of a length
    rng = np.random.default_rng(2)
    words, pieces = rng.integers(1, 12, 3000).astype(np.uint64), np.sort(rng.integers(0, 300, 3000))
    every = np.full(1 << 10, 255, dtype=np.uint8)
    by_key, exact = Counter(), []
    for columns, keys, times in collocations.reachable(words, pieces, len(words), every, None, 4):
        for key, n in zip(keys.tolist(), times.tolist()):
            by_key[key] += n
        exact += list(zip(keys.tolist(), times.tolist()))
        assert {k >> 4 for k in keys.tolist()} == {len(columns)}
    assert len(by_key) <= 48 and all(by_key[k] >= n for k, n in exact)


def test_counts_are_exact_beyond_64_bit_products(spark):
    big = 3_000_000_000_000
    rows = [(1, 0, 0, 0, big), (2, 0, 0, 0, big * 5), (1, 2, 0, 0, big), (2, 3, 0, 0, 40), (3, 0, 0, 0, 50), (1, 2, 3, 0, 40)]
    counts = spark.createDataFrame(rows, "w1 bigint, w2 bigint, w3 bigint, w4 bigint, times bigint")
    got = sorted(tuple(r) for r in collocations.scored(counts).collect())
    pair = 2_000_000 * big // (big * 6)
    assert got == [(1, 2, 0, 0, big, big, big * 5, pair), (1, 2, 3, 0, 40, big, 40, 2_000_000 * 40 // (big + 40))]


def test_odd_rows_clashing_columns_and_no_rows(spark):
    rows = [(None, "a b c", None)] * 40 + [(1, None, None), (2, "", "en")]
    table = clashing(spark.createDataFrame(rows, SCHEMA), "w1", "times", "_text", "_lang", "rank", "phrase", "n")
    assert found(table) == [("und", 1, "a b c", 40, 40, 40, 120, 1_000_000)]
    assert collocations.collocations(empty(spark)).count() == 0


def test_real_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.text, r.lang) for r in table.collect()])
    assert len(want) > 40 and found(table) == want


def test_words_of_frequent_phrases_are_read_once(spark, monkeypatch):
    rng = random.Random(3)
    names = [f"t{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(names) for _ in range(60)), "en") for i in range(150)]
    every = spark.sparkContext.broadcast(np.full(1 << 10, 255, dtype=np.uint8))
    texts = collocations.texts_of(spark.createDataFrame(rows, SCHEMA).repartition(8), "text", "lang")  # a frequent phrase meets all
    keys = collocations.materialize(collocations.count_keys(texts, every, None, 4))
    spots = collocations.fitted_spots(keys)
    made = collocations.count_exactly(texts, every, every, every, spots, 4, False)
    rows_out, phrases = made.agg({"key": "count"}).first()[0], keys.count()
    sums = []
    monkeypatch.setattr(collocations.F, "sum", lambda c: sums.append(c) or collocations.F.count(c))  # rows of each phrase before they are added up
    times = collocations.count_exactly(texts, every, every, every, spots, 4, False).agg({"times": "sum"}).first()[0]
    assert rows_out == phrases and phrases <= times <= 1.1 * phrases and sums == ["times"]


def test_few_failures_end_with_the_second_pass(spark, monkeypatch):
    """The sample misses a phrase of four words; its triples and the whole are counted together."""
    rng = random.Random(5)
    names = [f"t{i}" for i in range(9)]
    rows = [(i, " ".join(rng.choice(names) for _ in range(400)) if i < 60 else "alpha beta gamma delta", "en") for i in range(100)]
    passes, count, propose = [], collocations.count_exactly, collocations.propose
    monkeypatch.setattr(collocations, "count_exactly", lambda *a: passes.append(1) or count(*a))
    blind = lambda sample, *rest: propose(sample.where("CAST(_text AS STRING) NOT LIKE '%alpha%'"), *rest)
    monkeypatch.setattr(collocations, "propose", blind)
    got = found(spark.createDataFrame(rows, SCHEMA), sample=2)
    assert got == brute([r[1:] for r in rows]) and "alpha beta gamma delta" in [r[2] for r in got] and len(passes) == 1


def test_words_are_counted_in_chunks(monkeypatch, spark):
    """However much text an Arrow batch holds, no more than CHUNK words and a segment are counted at once."""
    monkeypatch.setattr(collocations, "CHUNK", 100)
    texts = spark.createDataFrame([(bytearray(b"the of a the b " * 40_000), "en")] * 3, "_text binary, _lang string").coalesce(1)
    assert sorted(r.times for r in collocations.count_words(texts).collect()) == [120_000] * 3 + [240_000]
    monkeypatch.setattr(collocations.F, "sum", lambda c: collocations.F.max(c))  # of the rows that are added up
    assert max(r.times for r in collocations.count_words(texts).collect()) <= 80_000
