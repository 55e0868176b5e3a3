"""Phrase collocations by Toivonen's sampling: propose on a sample, count exactly on everything, expand until closed.

A phrase can only be frequent if the phrases without its first and without its last word are. Words are counted first. Phrases
of frequent words that are frequent in a sample, at a lowered threshold, are proposed; the full pass counts exactly every
phrase whose two parts are frequent words or proposed, that is the proposed phrases and their negative border, by 60-bit keys,
and keeps one document bucket each phrase occurs in. A border phrase that turns out to be frequent is a failure: it
becomes a generator and a further pass counts what is newly in reach, until no pass finds a failure. That pass also reads the
words of the frequent keys, only from documents of the bucket kept. Generators reach
the tasks as a filter of bounded size that only ever lets too many phrases be counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import keyfilter
from fleetpulse.llm.common import attach
from fleetpulse.plans.tables import materialize

WIDEST = 4
LEAST = 30
COVER = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
# Every SAMPLE-th document by hash; a phrase is proposed at SLACK of the share of LEAST that falls to the sample.
SAMPLE = 8
SLACK = 0.6
SEGMENT = 1 << 19
CHUNK = 1 << 18
BATCH = 1 << 16
RANKS = 21  # a chunk has fewer than 2 ** RANKS words
KEY_BITS = 60
BUCKETS = 1 << 16
# With at least so many generators to a failure the sample is done, and what failures of a full pass bring into reach counts as
# frequent: the next pass is the last.
FEW = 8
RUNS = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t" + BREAKS, bytes(range(97, 123)) + b" " + b"." * len(BREAKS))
WORDS = [f"w{i}" for i in range(1, WIDEST + 1)]


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def phrase_keys(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of each phrase given as columns of word numbers, below its length: phrases of different lengths never share one."""
    key = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        key = mixed(key * BASE + column)
    return ((key >> np.uint64(64 - KEY_BITS)) | np.uint64(len(columns) << KEY_BITS)).view(np.int64)


class Tokens:
    """Words of a stream of texts as 64-bit numbers that hold for one language, with piece and language of each."""

    def __init__(self):
        self.grow(SEGMENT)
        self.langs, self.names, self.piece, self.buckets = {}, [], 0, []

    def grow(self, size: int) -> None:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        self.powers, self.inverse = (np.cumprod(np.full(size, x, dtype=np.uint64)) for x in (BASE, inverse))

    def lang(self, name: str) -> int:
        if name not in self.langs:
            self.langs[name] = len(self.names)
            self.names.append(name)
        return self.langs[name]

    def lang_hash(self) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(x.encode(), 5) | 1 for x in self.names], dtype=np.uint64)

    def segments(self, texts: Iterable[bytes], langs: Iterable[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """(bytes, starts of documents, their languages) of about SEGMENT bytes; texts are only cut where a word starts or ends.

        While a segment is given, ``buckets`` has a number below BUCKETS for each of its documents, which depends on the text alone.
        """
        parts, at, starts, kinds, buckets = [], 0, [], [], []
        for text, name in zip(texts, langs):
            raw, lang, begin = text.translate(FOLD) + b".", self.lang(name), 0
            bucket = xxhash.xxh3_64_intdigest(text) % BUCKETS
            while begin < len(raw):
                end = min(len(raw), begin + SEGMENT - at)
                if end < len(raw):
                    stop = max(raw.rfind(b" ", begin, end), raw.rfind(b".", begin, end))
                    if stop < begin and at:  # no place to cut: start the next segment here
                        end = begin
                    elif stop < begin:  # one word longer than a segment
                        blank, dot = raw.find(b" ", end), raw.find(b".", end)
                        end = min(x for x in (blank, dot) if x >= 0) + 1
                    else:
                        end = stop + 1
                if end > begin:
                    starts.append(at)
                    kinds.append(lang)
                    buckets.append(bucket)
                    parts.append(raw[begin:end])
                    at += end - begin
                    begin = end
                if begin < len(raw):
                    self.buckets = buckets
                    yield b"".join(parts), np.array(starts), np.array(kinds)
                    parts, at, starts, kinds, buckets = [], 0, [], [], []
        if parts:
            self.buckets = buckets
            yield b"".join(parts), np.array(starts), np.array(kinds)

    def words(self, segment: bytes, starts: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(number, piece, language, start, end) of each word of a segment."""
        codes = np.frombuffer(segment, dtype=np.uint8)
        breaks = codes == 46
        inside = np.concatenate([[False], ~breaks & (codes != 32), [False]])
        begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        upto = np.cumsum(breaks)
        pieces = self.piece + upto[begin]
        self.piece += int(upto[-1])
        lang = kinds[np.searchsorted(starts, begin, "right") - 1]
        if len(codes) > len(self.powers):  # holds a word longer than a segment
            self.grow(len(codes))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[: len(codes)])])
        number = (sums[end] - sums[begin]) * self.inverse[begin]
        seed = self.lang_hash()[lang] if len(begin) else np.zeros(0, dtype=np.uint64)
        number = mixed(mixed(number + (end - begin).astype(np.uint64)) * BASE + seed)
        return np.where(number == 0, np.uint64(1), number), pieces, lang, begin, end


def spot_keys(keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Hash of a phrase's key and a document bucket."""
    return mixed(keys.view(np.uint64) * BASE + buckets.astype(np.uint64)).view(np.int64)


def levels(
    words: np.ndarray, pieces: np.ndarray, now: np.ndarray, before: np.ndarray | None, widest: int, trusting: bool = False
) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(word columns, keys, counted, where each occurs, which of them that is, first place) of the phrases of a length in reach of ``now``.

    A phrase of two words or more is in reach of a filter if both its parts are in reach and may be held by it; single words
    always are. Phrases in reach of ``before`` are counted: an earlier pass has seen them. ``trusting`` takes those that are
    not for held.
    """
    holds = lambda held, keys: np.zeros(len(keys), dtype=bool) if held is None else keyfilter.may_hold(held, keys)
    unique, rank = np.unique(words, return_inverse=True)
    keys = phrase_keys([unique])
    new, old = holds(now, keys)[rank], holds(before, keys)[rank]
    word_rank, phrase_rank = rank.astype(np.int64), rank.astype(np.int64)
    for n in range(2, widest + 1):
        if len(words) < n:
            return
        both = new[:-1] & new[1:] & (pieces[: 1 - n] == pieces[n - 1 :])
        at = np.flatnonzero(both)
        unique, first, rank = np.unique((phrase_rank[at] << RANKS) | word_rank[at + n - 1], return_index=True, return_inverse=True)
        begin = at[first]
        columns = [words[begin + j] for j in range(n)]
        keys, counted = phrase_keys(columns), old[begin] & old[begin + 1]
        yield columns, keys, counted, at, rank, begin
        if n == widest:
            return
        phrase_rank = np.zeros(len(both), dtype=np.int64)
        phrase_rank[at] = rank
        held = holds(now, keys)
        new, old = np.zeros(len(both), dtype=bool), np.zeros(len(both), dtype=bool)
        new[at] = (held | ~counted if trusting else held)[rank]
        old[at] = (holds(before, keys) & counted)[rank]


def reachable(
    words: np.ndarray, pieces: np.ndarray, owned: int, now: np.ndarray, before: np.ndarray | None, widest: int, trusting: bool = False
) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(word columns, keys, times) of the phrases that start before ``owned`` and come into reach with the filter ``now``."""
    for columns, keys, counted, at, rank, _ in levels(words, pieces, now, before, widest, trusting):
        times = np.bincount(rank[at < owned], minlength=len(keys))
        given = (times > 0) & ~counted
        yield [c[given] for c in columns], keys[given], times[given]


def texts_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(text.alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("_lang"))


def raw_texts(batch: pa.RecordBatch) -> tuple[Iterator[bytes], list[str]]:
    return (x.as_buffer().to_pybytes() for x in batch.column(0)), batch.column(1).to_pylist()


def in_batches(results: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``results`` in batches of at most BATCH rows."""
    for batch in results:
        for lo in range(0, len(batch), BATCH):
            yield batch.slice(lo, BATCH)


def in_chunks(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work`` (words, pieces, buckets, owned) over chunks of words; the last words of a chunk go on to the next one, which counts the
    phrases that start with them."""
    tokens, chunk, size = Tokens(), [], 0
    for batch in batches:
        for segment, starts, kinds in tokens.segments(*raw_texts(batch)):
            number, pieces, _, begin, _ = tokens.words(segment, starts, kinds)
            buckets = np.array(tokens.buckets, dtype=np.int32)[np.searchsorted(starts, begin, "right") - 1]
            chunk.append((number, pieces, buckets))
            size += len(number)
            if size >= CHUNK:
                joined = [np.concatenate(x) for x in zip(*chunk)]
                owned = max(0, size - WIDEST + 1)
                chunk, size = [tuple(x[owned:] for x in joined)], size - owned
                yield from in_batches(work(*joined, owned))
    if size:
        yield from in_batches(work(*(np.concatenate(x) for x in zip(*chunk)), size))


def count_words(texts: DataFrame) -> DataFrame:
    """(w1 .. w4, lang, times) of all words; w2 to w4 are 0, lang is the hash of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, chunk, size = Tokens(), [], 0

        def counted() -> pa.RecordBatch:
            number, lang = (np.concatenate(x) for x in zip(*chunk))
            unique, first, times = np.unique(number, return_index=True, return_counts=True)
            hashed = tokens.lang_hash()[lang[first]] if len(unique) else unique
            return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(hashed.view(np.int64)), pa.array(times)], ["w1", "lang", "times"])

        for batch in batches:
            for segment in tokens.segments(*raw_texts(batch)):
                number, _, lang, _, _ = tokens.words(*segment)
                chunk.append((number, lang))
                size += len(number)
                if size >= CHUNK:
                    yield counted()
                    chunk, size = [], 0
        if chunk:
            yield counted()

    rows = texts.mapInArrow(lambda batches: in_batches(run(batches)), "w1 bigint, lang bigint, times bigint")
    counted = rows.groupBy("w1").agg(F.min("lang").alias("lang"), F.sum("times").alias("times"))
    return counted.select("w1", *[F.lit(0).cast("bigint").alias(w) for w in WORDS[1:]], "lang", "times")


def count_keys(texts: DataFrame, now: Broadcast, before: Broadcast | None, widest: int) -> DataFrame:
    """(key, times, bucket) of the phrases that come into reach with ``now``; the bucket is that of a document each occurs in.
    A row is half of the phrase itself."""

    def work(words: np.ndarray, pieces: np.ndarray, buckets: np.ndarray, owned: int) -> Iterator[pa.RecordBatch]:
        for _, keys, counted, at, rank, first in levels(words, pieces, now.value, before.value if before else None, widest):
            times = np.bincount(rank[at < owned], minlength=len(keys))
            given = (times > 0) & ~counted
            yield pa.RecordBatch.from_arrays([pa.array(keys[given]), pa.array(times[given]), pa.array(buckets[first[given]])], ["key", "times", "bucket"])

    rows = texts.mapInArrow(lambda batches: in_chunks(batches, work), "key bigint, times bigint, bucket int")
    return rows.groupBy("key").agg(F.sum("times").alias("times"), F.min("bucket").alias("bucket"))


def count_exactly(
    texts: DataFrame, now: Broadcast, before: Broadcast, again: Broadcast | None, spots: Broadcast | None, widest: int, trusting: bool
) -> DataFrame:
    """(key, w1 .. w4, times): occurrences of the phrases that come into reach with ``now``, told apart by their words. Phrases
    counted before that ``again`` may hold are given with 0 times, from documents of a bucket that ``spots`` may hold."""

    def work(words: np.ndarray, pieces: np.ndarray, buckets: np.ndarray, owned: int) -> Iterator[pa.RecordBatch]:
        for columns, keys, counted, at, rank, _ in levels(words, pieces, now.value, before.value, widest, trusting):
            times = np.bincount(rank[at < owned], minlength=len(keys))
            given = (times > 0) & ~counted
            if again:
                wanted = np.flatnonzero((counted & keyfilter.may_hold(again.value, keys))[rank] & (at < owned))
                wanted = wanted[keyfilter.may_hold(spots.value, spot_keys(keys[rank[wanted]], buckets[at[wanted]]))]
                given[rank[wanted]] = True
            times[counted] = 0
            filled = [c[given].view(np.int64) for c in columns] + [np.zeros(int(given.sum()), dtype=np.int64)] * (WIDEST - len(columns))
            yield pa.RecordBatch.from_arrays([pa.array(keys[given]), *map(pa.array, filled), pa.array(times[given])], ["key", *WORDS, "times"])

    rows = texts.mapInArrow(lambda batches: in_chunks(batches, work), ", ".join(f"{w} bigint" for w in ["key", *WORDS, "times"]))
    return rows.groupBy(*WORDS).agg(F.first("key").alias("key"), F.sum("times").alias("times"))


def word_keys(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(phrase_keys([batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]))], ["key"])

    return words.select("w1").mapInArrow(run, "key bigint")


def failures(frequent: DataFrame, held: Broadcast) -> DataFrame:
    """Frequent keys that are no generators yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~keyfilter.may_hold(held.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return frequent.mapInArrow(run, "key bigint")


def new_generators(frequent: DataFrame, now: Broadcast, widest: int, tag: str) -> DataFrame:
    """Written keys of the border failures of a pass: frequent phrases that can be parts of others and were no generators."""
    return materialize(failures(frequent.select("key").where(F.shiftright("key", KEY_BITS) < widest), now), f"{tag}-failures")


def fitted(keys: DataFrame) -> Broadcast:
    """Filter over a written table of keys, as large as their number asks for."""
    return keyfilter.fit(keys, keyfilter.bits_for(keys.count()))


def fitted_spots(frequent: DataFrame) -> Broadcast:
    """Filter over the keys of ``frequent`` with the bucket of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, buckets = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(spot_keys(keys, buckets))], ["key"])

    return keyfilter.fit(frequent.select("key", "bucket").mapInArrow(run, "key bigint"), keyfilter.bits_for(frequent.count()))


def propose(sample: DataFrame, least: int, words: DataFrame, tag: str = "proposed") -> DataFrame:
    """Keys of the phrases of up to WIDEST - 1 words that the sample proposes, level by level from the given words."""
    widest, before, now, generators = WIDEST - 1, None, fitted(words), words
    while True:
        frequent = materialize(count_keys(sample, now, before, widest).where(F.col("times") >= least).select("key"), tag)
        failed = new_generators(frequent, now, widest, tag)
        generators = generators.unionByName(frequent)
        if before:
            before.destroy()
        if failed.count() * FEW <= generators.count():  # what the sample misses fails in the full pass
            now.destroy()
            return generators
        before, now = now, fitted(generators)


def mine(texts: DataFrame, least: int, generators: DataFrame, tag: str = "phrases") -> DataFrame:
    """(w1 .. w4, times) of all phrases of 2 to WIDEST words that occur ``least`` times.

    The first full pass counts keys of what the generators reach. The second reads the words of what reached the threshold, and counts
    what the failures of the first bring into reach; further passes only count that, until one finds no failure. All pairs of
    frequent words are in reach of the first pass, so with few failures the second takes all it newly reaches for frequent, and
    whatever can hold a failure of its own is counted with it.
    """
    # All filters of generators have one size: a stranger that one lets pass stays in reach of the next.
    bits = keyfilter.bits_for(generators.count())
    start = keyfilter.fit(generators, bits)
    frequent = materialize(count_keys(texts, start, None, WIDEST).where(F.col("times") >= least), tag)
    again, spots, before, found = fitted(frequent.select("key")), fitted_spots(frequent), start, None
    failed = new_generators(frequent, start, WIDEST, tag)
    while True:
        trusting = failed.count() * FEW <= generators.count()
        generators = generators.unionByName(failed)
        now = keyfilter.fit(generators, bits)
        read = materialize(count_exactly(texts, now, before, again, spots, WIDEST, trusting).where((F.col("times") >= least) | (F.col("times") == 0)), tag)
        exact = read.where(F.col("times") > 0)
        if found is None:  # keys that only a filter let through are not among the frequent ones
            known = read.where(F.col("times") == 0).drop("times").join(frequent.select("key", "times"), "key")
            found = known.select(*exact.columns).unionByName(exact)
        else:
            found = found.unionByName(exact)
        before.destroy()
        if again:
            again.destroy()
            spots.destroy()
        failed = None if trusting else new_generators(exact, now, WIDEST, tag)
        if trusting or failed.isEmpty():
            now.destroy()
            return materialize(found.drop("key"), tag)
        before, again, spots = now, None, None


def part(first: int, last: int) -> list[Column]:
    """Word columns of the part from word ``first`` to ``last``, counted from 1."""
    return [F.col(WORDS[i - 1]) if i <= last else F.lit(0).cast("bigint") for i in range(first, first + WIDEST)]


def scored(counts: DataFrame) -> DataFrame:
    """(w1 .. w4, a, l, r, score) of every candidate that is not covered by a longer one."""
    run = F.pmod(F.xxhash64(*WORDS), F.lit(RUNS)).cast("int").alias("_run")
    candidates = counts.where("w2 != 0").withColumnRenamed("times", "a")
    named = lambda prefix, columns: [c.alias(f"{prefix}{w}") for c, w in zip(columns, WORDS)]
    cuts, inner = [], []
    for n in range(2, WIDEST + 1):
        exact = candidates.where(F.col(WORDS[n - 1]) != 0)
        exact = exact.where(F.col(WORDS[n]) == 0) if n < WIDEST else exact
        for k in range(1, n):
            cuts.append(exact.select(*WORDS, "a", F.lit(k).alias("k"), run, *named("l", part(1, k)), *named("r", part(k + 1, n))))
        for size in range(2, n):
            inner += [exact.select(*[c.alias(w) for c, w in zip(part(i, i + size - 1), WORDS)], F.col("a").alias("around")) for i in range(1, n - size + 2)]
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    rows = union(cuts)
    for side in "lr":
        table = counts.select(*[F.col(w).alias(f"{side}{w}") for w in WORDS], F.col("times").alias(side))
        rows = attach(rows, table, [f"{side}{w}" for w in WORDS])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr(f"CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = rows.select(*WORDS, "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy(*WORDS, "a").agg(F.min("cut").alias("cut"))
    around = union(inner).groupBy(*WORDS).agg(F.max("around").alias("around"))
    kept = best.join(around, WORDS, "left").where(F.col("around").isNull() | (wide("around") * 100 < wide("a") * COVER))
    return kept.select(*WORDS, "a", "cut.l", "cut.r", "cut.score")


def word_names(texts: DataFrame, wanted: Broadcast) -> DataFrame:
    """(w, lang, word, words): the spelling of words that may be wanted; and rows without w with the number of words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, totals = Tokens(), set(), {}
        for batch in batches:
            for segment, starts, kinds in tokens.segments(*raw_texts(batch)):
                number, _, lang, begin, end = tokens.words(segment, starts, kinds)
                for i, n in zip(*(x.tolist() for x in np.unique(lang, return_counts=True))):
                    totals[i] = totals.get(i, 0) + n
                unique, first = np.unique(number, return_index=True)
                hit = first[keyfilter.may_hold(wanted.value, unique.view(np.int64))].tolist()
                hit = [i for i in hit if int(number[i]) not in seen]
                seen.update(int(number[i]) for i in hit)
                words = [segment[begin[i] : end[i]] for i in hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number[hit].view(np.int64)),
                        pa.array([tokens.names[lang[i]] for i in hit], pa.string()),
                        pa.array(words, pa.binary()),
                        pa.nulls(len(hit), pa.int64()),
                    ],
                    ["w", "lang", "word", "words"],
                )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(totals), pa.int64()), pa.array([tokens.names[i] for i in totals], pa.string()), pa.nulls(len(totals), pa.binary()), pa.array(list(totals.values()), pa.int64())],
            ["w", "lang", "word", "words"],
        )

    return texts.mapInArrow(run, "w bigint, lang string, word binary, words bigint")


def collocations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, cover: int = COVER, top: int = TOP, sample: int = SAMPLE
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to 4 words of each language.

    A-Z is lower-cased, texts are split into pieces at punctuation and line ends, and words at spaces and tabs. Everything is
    counted exactly and per language; null languages are ``und``, null and empty texts have no words. Phrases occur ``least`` times
    or more; one inside a longer phrase that occurs in at least ``cover`` percent of its places is dropped. Repeated rows
    count as often as they occur; ids only choose the sample and may be null. Words are told apart by 64-bit hashes, phrases by
    60-bit hashes of these.
    """
    texts = texts_of(docs, text_col, lang_col)
    drawn = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(sample)) == 0)
    lowered = max(2, int(SLACK * least / sample))
    words = materialize(count_words(texts).where(F.col("times") >= least), "frequent-words")
    generators = materialize(word_keys(words), "word-keys")
    if sample > 1:
        generators = propose(texts_of(drawn, text_col, lang_col), lowered, generators)
    counts = words.drop("lang").unionByName(mine(texts, least, generators))
    kept = materialize(scored(counts), "scored")
    dealt = kept.withColumn("_run", F.pmod(F.xxhash64(*WORDS), F.lit(RUNS)).cast("int"))
    spoken = attach(dealt, words.select("w1", F.col("lang").alias("_lang")), ["w1"])
    # Ties of score and occurrences at the last place stay until the phrases are spelled.
    strong = spoken.withColumn("place", F.expr("rank() OVER (PARTITION BY _lang ORDER BY score DESC, a DESC)")).where(F.col("place") <= top)
    strong = materialize(strong.drop("place", "_run", "_lang"), "strong")
    wanted = keyfilter.fit(strong.select(F.explode(F.array(*WORDS)).alias("w")).where("w != 0").distinct(), keyfilter.bits_for(WIDEST * strong.count()))
    names = materialize(word_names(texts, wanted), "names")
    wanted.destroy()
    totals = names.where("w IS NULL").groupBy("lang").agg(F.sum("words").alias("n"))
    spelling = materialize(names.where("w IS NOT NULL").groupBy("w").agg(F.min("lang").alias("lang"), F.min("word").cast("string").alias("word")), "spelling")
    strong = strong.join(spelling.select(F.col("w").alias("w1"), "lang"), "w1")
    for w in WORDS:
        spelled = spelling.select(F.col("w").alias(w), F.col("word").alias(f"_{w}"))
        strong = strong.join(spelled, w, "left")
    phrase = F.concat_ws(" ", *[f"_{w}" for w in WORDS]).alias("phrase")
    rows = strong.select("lang", phrase, "a", "l", "r", "score").join(totals, "lang")
    ranked = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)").cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
