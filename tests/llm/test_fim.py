import hashlib
import re

import pytest
from helpers import clashing, docs, empty

from fleetpulse.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def key(row):
    return str(row)


TEXTS = [
    None, "", " ", "\t\n ", "one", " one", "one ", "a b", "tail space  ", "ends<P>here", "<S>", "<M> x", "é ü x  y z",
    "emoji \U0001f600 \U0001f600\U0001f601 end", "a\x1cb\x1dc d", "x" * 300_000, "long word " + "y" * 150_000 + " z", "\r\n".join(["line of words"] * 9000),
    *[f"word{i} and more text {i}  with  gaps " * (i % 5 + 1) for i in range(60)],
]


def test_outputs_against_brute_force_and_exact_round_trip(spark, monkeypatch):
    table = docs(spark, TEXTS)
    want = sorted((brute(i, t) for i, t in enumerate(TEXTS)), key=key)
    found = fim.fill_in_middle(table).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key) == want
    assert {r.doc_id: r.restored for r in found} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.form for r in found} == {"plain", "spm", "psm"}
    digests = {r.doc_id: (r.output_sha256, r.restored_sha256) for r in fim.fim_report(table).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert digests == {w[0]: (sha(w[5]), sha(TEXTS[w[0]] or "")) for w in want}


def test_small_pieces_end_at_units_and_give_the_same_result(monkeypatch):
    monkeypatch.setattr(fim, "PIECE_BYTES", 7)
    raw = "to be or not  tobeornottobe end \n".encode()
    ends = fim.unit_ends(raw)
    parts = list(fim.unit_pieces(raw, ends, 0, len(raw)))
    assert b"".join(parts) == raw and max(map(len, parts)) <= 7
    assert parts[0] == b"to be" and parts[1] == b" or not"


@pytest.mark.parametrize("rate,spm", [(100, 0), (100, 100), (0, 50)])
def test_rates_are_parameters(spark, rate, spm):
    texts = [f"some words here {i} and there" for i in range(40)]
    found = fim.fill_in_middle(docs(spark, texts), fim=rate, spm=spm).collect()
    assert {r.form for r in found} == {"plain" if rate == 0 else "psm" if spm == 0 else "spm"}
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key) == sorted(
        (brute(i, t, rate, spm) for i, t in enumerate(texts)), key=key
    )


def test_null_ids_repeated_rows_clashing_columns_and_no_rows(spark):
    rows = [(None, "same text here", "a"), (None, "same text here", "b"), (5, "same text here", "c"), (5, "same text here", "c"), (5, None, "d"), (None, None, "e")] * 30
    table = spark.createDataFrame(rows, "doc_id int, text string, _row string").repartition(3)
    table = clashing(table, "_place", "_piece", "_id", "n", "form", "output", "_text", "_digest")
    found = fim.fill_in_middle(table)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=key)
    assert got == sorted((brute(i, t) for i, t, _ in rows), key=key)
    assert fim.fim_report(empty(spark)).count() == 0


def test_whole_query_restores_every_text(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    found = fim.fill_in_middle(table, fim=100).collect()
    assert {r.doc_id: r.restored for r in found} == texts
    plan = fim.fim_report(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2
