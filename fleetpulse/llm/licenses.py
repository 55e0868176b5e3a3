"""License scans: consecutive phrases, and an exact set-similarity join of text blocks with license templates.

The join orders the templates' tokens by how many documents hold them. A block that holds enough of a template must
hold one of its rarest tokens (prefix), have enough tokens (length), and have enough tokens left at and after
the first shared one (position); blocks that pass are compared token by token. Only documents with a
prefix token are cut into blocks: overlapping windows of words, so that any passage of half a window lies
whole in one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import ascii_lower, placed
from fleetpulse.plans.tables import materialize

# Phrases of the base labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Notices of common licenses.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINMENT = 0.9
STRIDE = 32
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUNS = 256


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; digits, a-z and everything beyond ASCII make words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_order(words: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The templates' tokens, rarest first by the number of documents that hold them; ties by name."""
    held = words.select(F.explode(F.array_intersect("_words", _literals(vocabulary))).alias("token"))
    # One row per token of the templates.
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def _places(words: str, phrase: str) -> Column:
    parts = phrase.split()

    def at(word, i):
        hit = word == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == part)
        return F.when(hit, i.cast("bigint"))

    return F.filter(F.transform(words, at), lambda i: i.isNotNull())


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
    stride: int = STRIDE,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, phrase hits (label, word), and template matches.

    ``matches`` has each (label, template, block, containment) with at least ``containment`` of the template's tokens
    in a window of ``2 * stride`` words. Templates have at most ``stride`` words. Null and empty texts have no words;
    repeated rows are each reported; other columns of ``docs`` are not read.
    """
    sets = [(label, i, sorted(set(text.split()))) for i, (label, text) in enumerate(templates)]
    if max((len(t.split()) for _, t in templates), default=0) > stride:
        raise ValueError("a template is longer than a stride")
    vocabulary = sorted({t for _, _, tokens in sets for t in tokens})
    words = docs.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_words"))
    rank = {t: i for i, t in enumerate(token_order(words, vocabulary))} if vocabulary else {}
    needed = lambda tokens: math.ceil(containment * len(tokens) - 1e-9)
    rows, prefixes = [], set()
    for label, number, tokens in sets:
        ordered = sorted(tokens, key=rank.get)
        for position, token in enumerate(ordered[: len(ordered) - needed(ordered) + 1]):
            rows.append((token, label, number, position, ordered, needed(ordered)))
            prefixes.add(token)
    index = docs.sparkSession.createDataFrame(
        rows, "token string, label string, template int, position int, tokens array<string>, needed int"
    )
    starts = sorted({p.split()[0] for _, p in phrases})
    named = lambda label: lambda i: F.struct(i.alias("word"), F.lit(label).alias("label"))
    hits = F.concat(*[F.transform(_places("_words", p), named(label)) for label, p in phrases])
    none = F.expr("CAST(array() AS array<struct<word:bigint,label:string>>)")
    known = F.filter(
        F.transform("_words", lambda w, i: F.struct(w.alias("token"), i.alias("at"))), lambda x: F.array_contains(_literals(vocabulary), x["token"])
    )
    scanned = words.select(
        "_id",
        F.size("_words").cast("bigint").alias("_n"),
        F.when(F.arrays_overlap("_words", _literals(starts)), F.sort_array(hits)).otherwise(none).alias("_hits"),
        F.when(F.arrays_overlap("_words", _literals(sorted(prefixes))), known).alias("_known"),
    )
    scanned = placed(materialize(scanned, "licenses"), RUNS)
    key = ["_file", "_line"]
    at = F.floor(F.col("_k.at") / stride)
    blocks = (
        scanned.where(F.col("_known").isNotNull())
        .select(*key, F.explode("_known").alias("_k"))
        .select(*key, F.col("_k.token").alias("token"), F.explode(F.array(at, at - 1)).alias("block"))
        .groupBy(*key, "block")
        .agg(F.collect_set("token").alias("held"))
    )
    # The index has at most as many rows as the templates have tokens.
    candidates = (
        blocks.select(*key, "block", "held", F.explode("held").alias("token"))
        .join(F.broadcast(index), "token")
        .where((F.size("held") >= F.col("needed")) & (F.size("tokens") - F.col("position") >= F.col("needed")))
        .withColumn("first", F.row_number().over(Window.partitionBy(*key, "block", "template").orderBy("position")))
        .where("first = 1")
    )
    shared = F.size(F.array_intersect("held", "tokens"))
    found = candidates.where(shared >= F.col("needed")).select(
        *key, F.struct("label", "template", F.greatest("block", F.lit(0)).alias("block"), (shared / F.size("tokens")).alias("containment")).alias("match")
    )
    found = found.groupBy(*key).agg(F.sort_array(F.collect_set("match")).alias("matches"))
    return scanned.join(found, key, "left").select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_words"),
        F.col("_hits").alias("hits"),
        F.coalesce("matches", F.expr("CAST(array() AS array<struct<label:string,template:int,block:bigint,containment:double>>)")).alias("matches"),
    )


def license_report(docs: DataFrame) -> DataFrame:
    """Word and phrase counts, labels and score (largest containment; 1 where a phrase stands) of every row."""
    base = F.transform("hits", lambda h: h["label"])
    names = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_base"),
        F.array_min(F.transform("hits", lambda h: h["word"])).alias("first_word"),
        F.array_max(F.transform("hits", lambda h: h["word"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("hits") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
        .alias("score"),
    )
