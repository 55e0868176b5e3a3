import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import clashing, docs, empty

from fleetpulse.llm import keyfilter, repeats


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256, spans) of every text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
    return out


def found(table, **options):
    rows = repeats.repeated_spans(table, **options).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(s) for s in r.spans]) for r in rows}


def corpus(seed, alphabet, passages=6, n=60):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [noise(rng.randint(15, 90)) for _ in range(passages)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(noise(rng.randint(0, 40)))
            p = rng.choice(shared)
            cut = sorted((rng.randint(0, len(p)), rng.randint(0, len(p)))) if rng.random() < 0.5 else (0, len(p))
            parts.append(p[cut[0] : cut[1]])
        texts.append("".join(parts))
    return [*texts, texts[3], texts[3], None, ""]


@pytest.mark.parametrize("seed,alphabet,length,group", [(1, "abcdefgh ", 20, 2048), (2, "ab", 24, 1), (3, "aé日", 30, 3), (4, "abcdefghijklmnop", 9, 2048)])
def test_against_brute_force(spark, seed, alphabet, length, group):
    texts = corpus(seed, alphabet)
    assert found(docs(spark, texts), length=length, group=group) == dict(enumerate(brute(texts, length)))


def test_periodic_and_constant_texts_and_overlaps(spark):
    texts = ["a" * 500, "a" * 21, "a" * 20, "ab" * 300, "abc" * 7 + "x", "x" + "abc" * 7, "q" * 19, "-" * 3000 + "end"]
    assert found(docs(spark, texts), length=20) == dict(enumerate(brute(texts, 20)))


def test_common_passage_with_different_surroundings(spark):
    rng = random.Random(5)
    noise = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    core = noise(41)
    texts = [noise(rng.randint(10, 60)) + core[rng.randint(0, 2) : 41 - rng.randint(0, 2)] + noise(rng.randint(10, 60)) for _ in range(150)]
    want = dict(enumerate(brute(texts, 40)))
    assert any(w[1] for w in want.values()) and any(not w[1] for w in want.values())
    for group in (2048, 20):
        assert found(docs(spark, texts), length=40, group=group) == want


def test_every_window_has_one_trigger_that_equal_windows_share():
    rng = random.Random(6)
    for length in (9, 20, 33, 400):
        raw = bytes(rng.choice(b"abc") for _ in range(3000))
        at, first, last = repeats.anchors(raw, length)
        starts = [s for f, t in zip(first, last) for s in range(f, t + 1)]
        assert starts == list(range(len(raw) - length + 1))
        inner = raw[1000 : 1000 + length]
        owner = lambda text, p: next(a - p for a, f, t in zip(*repeats.anchors(text, length)) if f <= p <= t)
        assert owner(raw, 1000) == owner(inner, 0) == owner(b"zz" + inner + b"yyy", 2)


def test_long_texts_are_parsed_in_segments(monkeypatch):
    raw = bytes(random.Random(7).choices(b"abcdef", k=5000))
    whole = repeats.triggers(raw, 131)
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    assert repeats.triggers(raw, 131).tolist() == whole.tolist()
    assert np.diff(whole).max() <= 131


def test_production_length_on_real_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    assert found(table) == dict(zip([r[0] for r in rows], brute([r[1] for r in rows], 400)))


def test_odd_rows_repeated_rows_clashing_columns_and_no_rows(spark):
    text = "".join(random.Random(8).choices("abcdefgh", k=60))
    rows = [(None, text), (None, text), (1, None), (1, ""), (2, text[:30]), (3, "zz")]
    table = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"), "u1", "key", "ctx", "_text", "n_bytes", "_run", "spans")
    got = sorted((str(r.doc_id), r.n_removed) for r in repeats.repeats_report(table, length=25).collect())
    assert got == sorted([("None", 60), ("None", 60), ("1", 0), ("1", 0), ("2", 30), ("3", 0)])
    assert repeats.repeats_report(empty(spark)).count() == 0


def test_filter_never_loses_a_key_and_stays_small(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key")
    held = keyfilter.fit(keys, bits=1 << 16).value
    values = np.array([r.key for r in keys.collect()])
    assert len(held) == 1 << 13 and keyfilter.may_hold(held, values).all()
    others = np.array([r.key for r in spark.range(10000, 20000).selectExpr("xxhash64(id) AS key").collect()])
    assert keyfilter.may_hold(held, others).mean() < 0.1
