"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a column expression. A pattern's matches and the pieces between them give the places: a match starts
after all earlier pieces and matches. The patterns are linear in the text: a match may only start where
a run of its first characters starts, or right after the last match, which finds the same matches as trying
every place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base kinds in their order, then the kinds this method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban",)
KINDS = BASE + ADDED
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
# Texts without this character hold no span of the kind.
NEEDS = {"email": "@", "phone": "+"}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
# Words within CONTEXT code points before a span that speak for its kind.
WORDS = {
    "email": "mail|e-mail|contact",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
}
AGAINST = "version|order|invoice|isbn|serial|id"
CONTEXT = 40
BONUS, MALUS = 0.1, 0.2
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,text:string,score:double>>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, text) of all leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    sizes = F.zip_with(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("text"))
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("CAST(array() AS array<struct<start:bigint,text:string>>)").alias("spans"))
    return F.aggregate(
        sizes,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["text"])).alias("at"),
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["text"].alias("text")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).otherwise(d.cast("int")))
    return F.aggregate(F.filter(places, lambda d: d.isNotNull()), F.lit(0).cast("bigint"), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters as 10 to 35, is 1 modulo 97."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(digit(c) > 9, a * 100 + digit(c)).otherwise(a * 10 + digit(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: step(a, c).cast("bigint")) == 1


def confirmed(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(text, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(text, " ", ""))
    return F.lit(True)


def scored(kind: str, text: Column, start: Column) -> Column:
    """Score of a span from its kind and the words before it, from 0 to 1."""
    first = F.greatest(start - CONTEXT, F.lit(0))
    before = F.lower(F.substring(text, (first + 1).cast("int"), (start - first).cast("int")))
    word = lambda words: before.rlike(rf"(^|[^a-z])({words})([^a-z]|$)")
    adjusted = F.lit(SCORES[kind]) + F.when(word(WORDS[kind]), BONUS).otherwise(0.0) - F.when(word(AGAINST), MALUS).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), adjusted))


def spans_of(kind: str, text: Column) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: confirmed(kind, m["text"]))
    spans = F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            F.lit(kind).alias("kind"),
            (m["start"] + F.length(m["text"])).alias("end"),
            m["text"].alias("text"),
            scored(kind, text, m["start"]).alias("score"),
        ),
    )
    test = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(test & text.rlike(PATTERNS[kind]), spans).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def find_personal(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: all spans with start, kind, end (exclusive, code points), text and score, by start and kind.

    Null texts count as empty and have no spans. A column named ``out`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, F.sort_array(F.concat(*[spans_of(k, text) for k in KINDS])))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans of every row of ``docs``."""
    rows = find_personal(docs.select("doc_id", "text"), out="_spans").select("doc_id", "_spans")
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    return rows.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
        count("iban"),
        F.coalesce(F.array_max(F.transform("_spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
