"""Fixtures and brute-force versions for the corpus operators."""

import zlib

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, extra=""):
    """Documents 0.. with the given texts; ``extra`` adds columns with clashing names."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def clashing(df, *names):
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


def fold(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def components(n, linked):
    """Smallest index reachable for each of n nodes; ``linked(i, j)`` tells direct links."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
