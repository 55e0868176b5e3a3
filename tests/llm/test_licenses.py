import re

import pytest
from helpers import clashing, docs, empty

from fleetpulse.llm import licenses


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text):
    words = words_of(text)
    hits = sorted(
        (i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
    )
    labels = {label for _, label in hits}
    best = 1.0 if hits else 0.0
    for at in range(-licenses.STRIDE, len(words), licenses.STRIDE):
        block = set(words[max(0, at) : at + 2 * licenses.STRIDE])
        for label, template in licenses.TEMPLATES:
            tokens = set(template.split())
            share = len(tokens & block) / len(tokens)
            if share >= licenses.CONTAINMENT - 1e-12:
                labels.add(label)
                best = max(best, share)
    return (
        len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None,
        ",".join(sorted({k for _, k in hits})), ",".join(sorted(labels)), best,
    )


def check(spark, df):
    text = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_report(df).collect()}
    for name, row in got.items():
        want = brute(text[name])
        assert row[:6] == want[:6] and row[6] == pytest.approx(want[6]), (text[name], row, want)
    return got


def test_real_documents(spark, sf):
    got = check(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    assert len(got) == 200 and any(r[4] for r in got.values())


def test_odd_texts(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are PERMITTED"
    texts = [
        None, "", "  ...  ", "MIT License", "mit-license MIT\nLICENSE apache license, gnu general public license", "É mit license ñ",
        "x " * 31 + bsd, "x " * 40000 + bsd + " y" * 100, "Licensed under CC BY-NC 4.0.", "licensed under CC BY 4.0", "license mit gnu general public",
        " ".join(f"pad{i} {w}" for i, w in enumerate(bsd.split())), bsd.replace("forms", "shapes"), bsd.replace("forms", "shapes").replace("binary", "two"),
    ]
    got = check(spark, clashing(docs(spark, texts), "hits", "matches", "n_words", "_line", "token"))
    assert got[6][5] == "bsd" and got[7][5] == "bsd" and got[8][5] == "cc-by,cc-by-nc" and got[12][5] == "bsd" and got[13][5] == ""


def test_empty_table_and_repeated_rows(spark):
    assert licenses.license_report(empty(spark)).count() == 0
    df = docs(spark, ["released under the mit license"])
    assert [r["labels"] for r in licenses.license_report(df.unionByName(df)).collect()] == ["mit", "mit"]
