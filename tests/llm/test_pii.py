import hashlib
import re

from helpers import clashing, docs, empty

from fleetpulse.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = []
    for rank, kind in enumerate(PATTERNS):
        for m in re.finditer(PATTERNS[kind], text or "", re.ASCII):
            if good(kind, m[0]):
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def check(spark, df):
    text = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in pii.personal_report(df).collect()}
    for name, r in got.items():
        want = brute(text[name])
        names = [f"{k}:{s}:{e}" for s, _, k, e in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest(), (text[name][:200], names, r)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x == k for _, _, x, _ in want) for k in PATTERNS]
        assert set(names) <= set(r["spans"].split(",")) or not names
        assert 0 <= r["max_score"] <= 1
    return got


def test_real_documents(spark, sf):
    assert len(check(spark, spark.read.parquet(f"{sf}/documents.parquet"))) == 200


def test_odd_texts(spark):
    texts = [
        None, "", "a@b.c_d@e.f a@b a@b. @x.y", "é x.y@z-1.co.uk, +1 (555) 123-4567.", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.0", "000000000000255.1.1.001",
        "4111 1111 1111 1111", "4111-1111-1111-1112 5500000000000004", "0" * 14, "12345678901234567890", "9" * 30000, "a" * 30000, "a." * 20000 + "@x.y",
        "x@" + "y." * 20000 + "z", "+12 3456789012345678", "+1 -- 2", "++123456789012", "1 " * 5000, "call +49 30 1234567 now 10.0.0.1",
        "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001 and GB82WEST12345698765432",
    ]
    got = check(spark, clashing(docs(spark, texts), "spans", "_spans", "score"))
    assert got[20]["n_iban"] == 2 and "iban:5:32" in got[20]["spans"]


def test_context_words_move_the_score(spark):
    df = docs(spark, ["server ip 10.0.0.1", "so then 10.0.0.1", "release version 10.0.0.1"])
    first, second, third = [r["max_score"] for r in pii.personal_report(df).orderBy("doc_id").collect()]
    assert first > second > third


def test_empty_table_and_repeated_rows(spark):
    assert pii.personal_report(empty(spark)).count() == 0
    df = docs(spark, ["a@b.cd"])
    assert pii.personal_report(df.unionByName(df)).count() == 2
