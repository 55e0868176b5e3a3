"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; an n-gram binds the permuted vectors of its letters by
multiplication, a text bundles its n-grams by addition, and a language is the bundle of its training texts.
A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import fold

DIMENSIONS = 1024
N = 3
SEED = 29
UNKNOWN = "und"
# Letters are coded as their code point plus one, so that 0 marks a space between words.
CODE_BITS = 21
CACHE = 40_000
CHUNK = 1 << 20
TRAIN_ROWS = 512
# A text whose best cosine is below this has no language the model knows: texts of unknown letters have
# cosines of about 1 / sqrt(DIMENSIONS) = 0.03 by chance.
LEAST_COSINE = 0.05


class Vectors:
    """N-gram vectors, made from the seed on first use; the cache is bounded."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.letters: dict[int, np.ndarray] = {}
        # Sorted codes and their rows of the table; code 0, which no n-gram has, keeps them non-empty.
        self.codes, self.rows = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.table = np.zeros((1, dimensions), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= CACHE:
                self.letters.clear()
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = bits * 2 - 1
        return self.letters[code]

    def gram(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, dtype=np.int8)
        for place in range(self.n):
            letter = self.letter(code >> (CODE_BITS * (self.n - 1 - place)) & ((1 << CODE_BITS) - 1))
            out = out * np.roll(letter, self.n - 1 - place)
        return out

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """One row per n-gram code; ``codes`` are sorted and distinct."""
        at = np.searchsorted(self.codes, codes)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == codes
        if not known.all():
            fresh = codes[~known]
            if len(self.codes) + len(fresh) > CACHE:
                self.codes, self.rows, self.table, fresh = self.codes[:1], self.rows[:1], self.table[:1], codes
            if len(fresh) > CACHE:
                return np.stack([self.gram(c) for c in fresh.tolist()])
            self.table = np.concatenate([self.table, np.stack([self.gram(c) for c in fresh.tolist()])])
            where = np.searchsorted(self.codes, fresh)
            self.rows = np.insert(self.rows, where, np.arange(len(self.table) - len(fresh), len(self.table)))
            self.codes = np.insert(self.codes, where, fresh)
            at = np.searchsorted(self.codes, codes)
        return self.table[self.rows[at]]


_LETTER = None


def letter_table() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def gram_counts(text: str | None, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of the lower-cased text and their counts; runs of other characters are one space."""
    codes, total = [], []
    text = (text or "").lower()
    tail = np.zeros(1, dtype=np.int64)
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        letters = np.concatenate([tail, np.where(letter_table()[points], points + 1, 0)])
        last = at + CHUNK >= len(text)
        letters = np.append(letters, 0) if last else letters
        keep = np.append(True, (letters[1:] != 0) | (letters[:-1] != 0))
        letters = letters[keep]
        tail = letters[-(n - 1) :] if n > 1 else letters[:0]
        if len(letters) < n:
            continue
        grams = np.zeros(len(letters) - n + 1, dtype=np.int64)
        for place in range(n):
            grams = (grams << CODE_BITS) | letters[place : len(letters) - n + 1 + place]
        some, many = np.unique(grams, return_counts=True)
        codes.append(some)
        total.append(many)
    if not codes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    some, where = np.unique(np.concatenate(codes), return_inverse=True)
    many = np.bincount(where, weights=np.concatenate(total)).astype(np.int64)
    known = some != 0
    return some[known], many[known]


def bundle(vectors: Vectors, codes: np.ndarray, counts: np.ndarray, kind=np.float32) -> np.ndarray:
    """Sum of the vectors of n-grams, each as often as counted; exact for whole numbers that ``kind`` holds."""
    out = np.zeros(vectors.dimensions)
    for at in range(0, len(codes), CACHE):
        out += counts[at : at + CACHE].astype(kind) @ vectors.matrix(codes[at : at + CACHE]).astype(kind)
    return out


def fit_prototypes(labelled: DataFrame, text: str = "text", label: str = "lang", dimensions: int = DIMENSIONS, n: int = N) -> DataFrame:
    """(label, vector): the bundle of all texts of each label. Rows with a null label or text are left out.

    Tasks bundle their own texts, so that only one vector per task and label is shuffled. The sums are of whole
    numbers and do not depend on the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(dimensions, n), {}
        for batch in batches:
            for at in range(0, len(batch), TRAIN_ROWS):
                part = batch.slice(at, TRAIN_ROWS)
                names = np.array(part.column(0).to_pylist(), dtype=object)
                for name in sorted(set(names)):
                    grams = [gram_counts(part.column(1)[int(i)].as_py(), n) for i in np.flatnonzero(names == name)]
                    codes, where = np.unique(np.concatenate([g[0] for g in grams]), return_inverse=True)
                    counts = np.bincount(where, weights=np.concatenate([g[1] for g in grams]), minlength=len(codes))
                    sums[name] = sums.get(name, np.zeros(dimensions)) + bundle(vectors, codes, counts, np.float64)
        names = [k for k in sums for _ in range(dimensions)]
        places = np.tile(np.arange(dimensions, dtype=np.int32), len(sums))
        values = np.concatenate([*sums.values(), np.zeros(0)]).round().astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(values, pa.int64())], ["label", "place", "value"]
        )

    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).dropna()
    parts = rows.mapInArrow(run, "label string, place int, value bigint")
    sums = parts.groupBy("label", "place").agg(F.sum("value").alias("value"))
    return sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector"))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", out: str = "lang_pred", score: str = "score", n: int = N) -> DataFrame:
    """Add the language with the largest cosine and that cosine (0 if negative) to every row.

    ``und`` and 0 for null, empty and letterless texts, and wherever no prototype is known. Ties go to the
    first label in order. Columns named ``out`` or ``score`` are replaced.
    """
    labels = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in labels], dtype=float) if labels else np.zeros((0, 1))
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms > 0, norms, 1.0)
    names = [c for c in docs.columns if c not in (out, score)]
    dimensions = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(dimensions, n)
        at = names.index(text)
        for batch in batches:
            found, cosines = [], []
            for value in batch.column(at):
                sums = bundle(vectors, *gram_counts(value.as_py(), n))
                size = np.linalg.norm(sums)
                cosine = matrix @ sums / size if size > 0 and labels else np.zeros(0)
                best = int(np.argmax(cosine)) if len(cosine) else -1
                found.append(labels[best] if best >= 0 else UNKNOWN)
                cosines.append(min(1.0, max(0.0, float(cosine[best]))) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(cosines, pa.float64())], [*names, out, score]
            )

    kept = docs.select(*names)
    schema = kept.limit(0).withColumn(out, F.lit("")).withColumn(score, F.lit(0.0)).schema
    return kept.mapInArrow(run, schema)


def collect_prototypes(table: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes as arrays: one vector of fixed length for each label."""
    return {r["label"]: np.array(r["vector"], dtype=float) for r in table.collect()}


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents outside the held-out fold whose language is given."""
    return docs.where((fold("doc_id", 5) != 0) & F.col("lang").isNotNull())


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; learned from its training rows."""
    prototypes = collect_prototypes(fit_prototypes(training_rows(docs)))
    held = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return predict(held, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float = LEAST_COSINE) -> DataFrame:
    """Rows of ``docs``, same columns, whose text has letters and a cosine of at least ``least``."""
    names = docs.columns
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    return predict(plain, prototypes).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
