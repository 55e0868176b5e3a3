"""Katz backoff language model over words.

Bigram and unigram counts are Good-Turing discounted; the mass that discounting frees is given to unseen words
in proportion to the unigram model, with backoff weights that make every history sum to one.

A text's tokens are kept in blocks of some million tokens. A block asks for the counts of its distinct words, then of
its distinct pairs: requests are dealt to buckets by hash, a bucket merges the training counts of all blocks
and answers each request in its own order. So only distinct words and pairs of a block are shuffled, as
packed arrays, and a document never is. A frequent history (at least one training token in HOT) is dealt by
pair, its sums are added up over the buckets.
"""

from __future__ import annotations

import gc
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import fold
from fleetpulse.plans.tables import materialize

BLOCK_TOKENS = 3_000_000
BUCKET_TOKENS = 2_000_000
# Counts up to this are discounted.
LAST = 5
# At most so many histories hold more than one training token in HOT.
HOT = 4096
# Words hold no space, so that these are no words.
END, START, UNKNOWN = (xxhash.xxh64_intdigest(x) for x in (b" end", b" start", b" unknown"))


class Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def packed(values: np.ndarray) -> bytes:
    """Little-endian bytes, those of equal weight together, compressed."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return zlib.compress(flat.T.tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def packed_sums(sums: np.ndarray) -> bytes:
    """Rows of LAST + 1 whole numbers and a probability, column by column."""
    return packed(np.concatenate([sums[:, :-1].T.astype(np.uint64).reshape(-1), np.ascontiguousarray(sums[:, -1]).view(np.uint64)]))


def unpacked_sums(data: bytes) -> np.ndarray:
    columns = unpacked(data, np.uint64).reshape(LAST + 2, -1)
    return np.concatenate([columns[:-1].astype(float), columns[-1:].view(np.float64)]).T


BLOCK = "block bigint, tokens bigint, ids binary, known binary, train binary, lens binary, vocab binary, body binary"


def make_blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """One row per block of documents: ids, training flags, lengths, sorted word hashes and word numbers."""

    def block(number: int, rows: list, numbers: Numbers, bodies: list) -> list:
        words = np.array([xxhash.xxh64_intdigest(w) if w else END for w in numbers], dtype=np.uint64)
        order = np.argsort(words)
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        body = rank[np.concatenate(bodies)]
        ids, flags, lens = ([r[k] for r in rows] for k in range(3))
        known = np.array([i is not None for i in ids], dtype=np.uint8)
        ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        return [
            number, len(body), packed(ids), packed(known), packed(np.array(flags, dtype=np.uint8)),
            packed(np.array(lens, dtype=np.uint32)), packed(words[order]), packed(body),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, rows, numbers, bodies, size = (task.partitionId() if task else 0) << 24, [], Numbers(), [], 0
        types = [pa.int64(), pa.int64()] + [pa.binary()] * 6
        names = [c.split()[0] for c in BLOCK.split(", ")]
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(block(number, rows, numbers, bodies), types)], names)
        for batch in batches:
            for name, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = text.as_buffer().to_pybytes().lower().split() if text.is_valid else []
                words.append(b"")
                bodies.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
                rows.append((name, flag, len(words)))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield emit()
                    number, rows, numbers, bodies, size = number + 1, [], Numbers(), [], 0
        if rows:
            yield emit()

    plain = docs.select(F.col(id_col).cast("bigint"), train.alias("train"), F.col(text_col).cast("binary"))
    return plain.mapInArrow(run, BLOCK)


def range_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash; grows with it."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def slices(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values."""
    edges = np.flatnonzero(np.diff(buckets)) + 1
    for start, end in zip(np.append(0, edges), np.append(edges, len(buckets))):
        if end > start:
            yield int(buckets[start]), slice(int(start), int(end))


def slope(of: np.ndarray) -> float:
    """Slope of the log-linear fit of simple Good-Turing; an empty count is shared out by its neighbours. NaN below two counts."""
    r = np.flatnonzero(of > 0) + 1
    if len(r) < 2:
        return np.nan
    before = np.append(0, r[:-1])
    after = np.append(r[1:], 2 * r[-1] - before[-1])
    x, y = np.log(r), np.log(2 * of[r - 1] / (after - before))
    x = x - x.mean()
    return float(x @ y / (x @ x))


def discounts(of: np.ndarray) -> np.ndarray:
    """Good-Turing discount of counts 0 to LAST from the numbers of things seen 1 to LAST + 1 times.

    The numbers are smoothed by a power of the count, of which only the slope matters: with a slope below -1 every factor
    lies in (0, 1). Where there is none (things of a single count or none at all, or numbers that fall no faster than
    1 / count), half an occurrence is taken off.
    """
    r = np.arange(1, LAST + 1)
    power = slope(np.asarray(of, dtype=float)) + 1
    if not power < 0:
        return np.append(1.0, (r - 0.5) / r)
    common = (LAST + 1.0) ** power
    return np.append(1.0, (((r + 1) / r) ** power - common) / (1 - common))


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return np.where(counts <= LAST, factors[np.minimum(counts, LAST)], 1.0) * counts


def count_stats(counts: np.ndarray) -> np.ndarray:
    """Things seen 1 to LAST + 1 times, sum of the counts above LAST, things seen, sum."""
    small = np.bincount(np.minimum(counts, LAST + 2), minlength=LAST + 3)[1 : LAST + 2]
    return np.array([*small, counts[counts > LAST].sum(), (counts > 0).sum(), counts.sum()], dtype=float)


REQUEST = "bucket bigint, block bigint, keys binary, sizes binary, words binary, uses binary, codes binary, counts binary"
ANSWER = "block bigint, bucket bigint, kind int, counts binary, sums binary, stats array<double>"
MODEL = -1


def word_requests(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                vocab, body = unpacked(row.vocab, np.uint64), unpacked(row.body, np.uint32)
                flags = np.repeat(unpacked(row.train, np.uint8), unpacked(row.lens, np.uint32))
                counts = np.bincount(body[flags > 0], minlength=len(vocab)).astype(np.uint32)
                for bucket, part in slices(range_bucket(vocab, buckets)):
                    out.append((bucket, row.block, packed(vocab[part]), None, None, None, None, packed(counts[part])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REQUEST.split(", ")])

    return blocks.select("block", "train", "lens", "vocab", "body").mapInPandas(run, REQUEST)


def answer_words(frame: pd.DataFrame) -> pd.DataFrame:
    """Training count of every word asked for; statistics of the bucket's words."""
    keys = [unpacked(k, np.uint64) for k in frame["keys"]]
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([unpacked(c, np.uint32) for c in frame["counts"]])).astype(np.int64)
    bucket, ends = int(frame["bucket"].iloc[0]), np.cumsum([len(k) for k in keys])
    out = [
        (block, bucket, 1, packed(counts[where[end - len(k) : end]]), None, None)
        for block, k, end in zip(frame["block"], keys, ends)
    ]
    out.append((MODEL, bucket, 1, None, None, count_stats(counts).tolist()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])


class Block:
    """Tokens and distinct pairs of a block, in the order in which pairs are asked for."""

    def __init__(self, row, answers: pd.DataFrame, model: dict):
        self.row = row
        self.lens = unpacked(row.lens, np.uint32).astype(np.int64)
        vocab, body = unpacked(row.vocab, np.uint64), unpacked(row.body, np.uint32).astype(np.int32)
        own = answers[answers["kind"] == 1].sort_values("bucket")
        self.counts = np.concatenate([unpacked(c, np.int64) for c in own["counts"]])
        self.flags = np.repeat(unpacked(row.train, np.uint8), self.lens)
        size = len(vocab)
        # After the words: the start of a text, and every unknown word.
        self.hashes = np.append(vocab, np.array([START, UNKNOWN], dtype=np.uint64))
        self.uses = np.append(self.counts, [model["texts"], 0])
        self.body = body
        heads = np.append(np.int32(size), body[:-1])
        heads[np.cumsum(self.lens)[:-1]] = size
        self.known = self.uses[heads] > 0
        self.heads, self.words = heads, np.where(self.counts[body] > 0, body, np.int32(size + 1))
        pairs, self.where = np.unique(heads[self.known].astype(np.int64) * (size + 2) + self.words[self.known], return_inverse=True)
        self.where = self.where.astype(np.int32)
        trained = np.bincount(self.where, weights=self.flags[self.known], minlength=len(pairs)).astype(np.uint32)
        head, word = pairs // (size + 2), pairs % (size + 2)
        hot = self.uses[head] * HOT > model["total"]
        bucket = range_bucket(np.where(hot, mixed(self.hashes[head], self.hashes[word]), self.hashes[head]), model["buckets"])
        self.order = np.argsort(bucket, kind="stable")
        self.bucket, self.head, self.word = bucket[self.order], head[self.order], word[self.order]
        self.trained, self.hot = trained[self.order], hot[self.order]

    def parts(self) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """(bucket, pairs, heads, run lengths) of each bucket."""
        for bucket, part in slices(self.bucket):
            head = self.head[part]
            starts = np.append(0, np.flatnonzero(np.diff(head)) + 1)
            yield bucket, part, head[starts], np.diff(np.append(starts, len(head)))


def pair_requests(blocks: DataFrame, answers: DataFrame, model: dict) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            block = Block(row, right, model)
            for bucket, part, heads, sizes in block.parts():
                # Each word once, and its number in each pair; the top bit of a run marks a frequent history.
                words, codes = np.unique(block.word[part], return_inverse=True)
                hot = block.hot[part][np.cumsum(sizes) - sizes]
                out.append((
                    bucket, row.block, packed(block.hashes[heads]), packed((sizes + (hot.astype(np.int64) << 31)).astype(np.uint32)),
                    packed(block.hashes[words]), packed(block.uses[words].astype(np.int64)), packed(codes.astype(np.uint32)), packed(block.trained[part]),
                ))
        return pd.DataFrame(out, columns=[c.split()[0] for c in REQUEST.split(", ")])

    return blocks.groupBy("block").cogroup(answers.where("kind = 1 AND block >= 0").groupBy("block")).applyInPandas(run, REQUEST)


def answer_pairs(frame: pd.DataFrame, model: dict) -> pd.DataFrame:
    """Training count of every pair asked for, sums over the seen words of each history, statistics."""
    heads = [unpacked(k, np.uint64) for k in frame["keys"]]
    runs = [unpacked(s, np.uint32).astype(np.int64) for s in frame["sizes"]]
    sizes = [s & ((1 << 31) - 1) for s in runs]
    head = np.concatenate([np.repeat(h, s) for h, s in zip(heads, sizes)])
    codes = [unpacked(c, np.uint32) for c in frame["codes"]]
    word = np.concatenate([unpacked(w, np.uint64)[c] for w, c in zip(frame["words"], codes)])
    uses = np.concatenate([unpacked(u, np.int64)[c] for u, c in zip(frame["uses"], codes)])
    hot = np.concatenate([np.repeat(s >> 31, n) for s, n in zip(runs, sizes)])
    order = np.lexsort((word, head))
    sh, sw = head[order], word[order]
    first = np.append(True, (sh[1:] != sh[:-1]) | (sw[1:] != sw[:-1]))
    starts = np.flatnonzero(first)
    trained = np.concatenate([unpacked(c, np.uint32) for c in frame["counts"]]).astype(np.int64)
    counts = np.add.reduceat(trained[order], starts)
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.cumsum(first) - 1
    # Sums of each history: words seen 1 to LAST times, counts above, unigram probability.
    names, at = np.unique(sh[starts], return_inverse=True)
    chance = discounted(uses[order][starts], model["word_factors"]) / (model["total"] + 1)
    columns = [(counts == r).astype(float) for r in range(1, LAST + 1)]
    columns += [np.where(counts > LAST, counts, 0).astype(float), np.where(counts > 0, chance, 0.0)]
    sums = np.stack([np.bincount(at, weights=c, minlength=len(names)) for c in columns], axis=1)
    busy = np.zeros(len(names), dtype=bool)
    busy[at[hot[order][starts] > 0]] = True
    bucket, ends, out = int(frame["bucket"].iloc[0]), np.cumsum([int(s.sum()) for s in sizes]), []
    for block, h, s, end in zip(frame["block"], heads, sizes, ends):
        found = sums[np.searchsorted(names, h)]
        out.append((block, bucket, 2, packed(counts[where[end - int(s.sum()) : end]]), packed_sums(found), None))
    out.append((MODEL, bucket, 2, None, None, count_stats(counts).tolist()))
    for name, values in zip(names[busy].view(np.int64).tolist(), sums[busy].tolist()):
        out.append((MODEL, name, 3, None, None, values))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])


SCORE = "_id bigint, _train boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score_blocks(blocks: DataFrame, answers: DataFrame, model: dict) -> DataFrame:
    """Scores of every document from the answers to its block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            block = Block(row, right, model)
            found = {r.bucket: r for r in right[right["kind"] == 2].itertuples()}
            counts = np.zeros(len(block.order), dtype=np.int64)
            sums = np.zeros((len(block.uses), LAST + 2))
            for bucket, part, heads, _ in block.parts():
                counts[part] = unpacked(found[bucket].counts, np.int64)
                sums[heads] = unpacked_sums(found[bucket].sums)
            hashes = block.hashes.view(np.int64)
            for head in np.unique(block.head[block.hot]).tolist():
                sums[head] = model["hot"][int(hashes[head])]
            taken = sums[:, :LAST] @ (model["pair_factors"][1:] * np.arange(1, LAST + 1)) + sums[:, LAST]
            left_over = 1 - taken / (block.uses + 1)
            with np.errstate(divide="ignore"):
                chance = discounted(block.uses, model["word_factors"]) / (model["total"] + 1)
                chance[-1] = model["unknown"]
                single = np.log10(chance)
                weight = np.log10(left_over / (1 - sums[:, LAST + 1]))
                direct = np.log10(discounted(counts, model["pair_factors"]) / (block.uses[block.head] + 1))
            pairs = np.empty(len(counts))
            pairs[block.order] = np.where(counts > 0, direct, weight[block.head] + single[block.word])
            tokens = single[block.words]
            tokens[block.known] = pairs[block.where]
            starts = np.cumsum(block.lens) - block.lens
            base = np.log10((block.counts + 1) / (model["total"] + model["words"] + 1))
            known = unpacked(row.known, np.uint8)
            ids = unpacked(row.ids, np.int64)
            out.append(pd.DataFrame({
                "_id": pd.array(np.where(known > 0, ids, 0), dtype="Int64").copy(),
                "_train": unpacked(row.train, np.uint8) > 0,
                "n_tokens": block.lens,
                "n_known": np.add.reduceat((block.counts[block.body] > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base[block.body], starts),
                "score": np.add.reduceat(tokens, starts),
            }))
            out[-1].loc[known == 0, "_id"] = pd.NA
        return pd.concat(out)

    return blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInPandas(run, SCORE)


def added(answers: DataFrame, kind: int) -> np.ndarray:
    """Statistics of all buckets together."""
    rows = answers.where(f"kind = {kind} AND block = {MODEL}")
    sums = rows.select(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(LAST + 4)]).first()
    return np.array([x or 0.0 for x in sums])


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _train, n_tokens, n_known, base_score, score, train_tokens) of every row of ``docs``.

    The model learns from rows where ``train`` holds. A-Z is lower-cased, white space separates words, and every text
    ends with one end token; null is empty. Words not seen in training are one unknown word; with no training row
    its probability is 1. Repeated rows count and are scored each. Ids are integers. Other columns are not read.
    """
    blocks = materialize(make_blocks(docs, id_col, text_col, train), "blocks")
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    buckets = max(8, int(tokens) // BUCKET_TOKENS)
    words = materialize(word_requests(blocks, buckets).groupBy("bucket").applyInPandas(answer_words, ANSWER), "words")
    stats = added(words, 1)
    release_shuffles(blocks)
    factors = discounts(stats[: LAST + 1])
    total = int(stats[-1])
    used = float((factors[1:] * np.arange(1, LAST + 1)) @ stats[:LAST] + stats[LAST + 1])
    ends = trained_texts(blocks)
    model = {"buckets": buckets, "texts": ends, "total": total, "words": int(stats[-2]), "word_factors": factors, "unknown": 1 - used / (total + 1)}
    answer = lambda frame: answer_pairs(frame, model)
    pairs = materialize(pair_requests(blocks, words, model).groupBy("bucket").applyInPandas(answer, ANSWER), "pairs")
    hot = pairs.where(f"kind = 3 AND block = {MODEL}").groupBy("bucket").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(LAST + 2)])
    # At most HOT histories hold more than one training token in HOT.
    model |= {"pair_factors": discounts(added(pairs, 2)[: LAST + 1]), "hot": {r[0]: np.array(r[1:]) for r in hot.collect()}}
    release_shuffles(blocks)
    scores = score_blocks(blocks, words.unionByName(pairs), model)
    return scores.withColumn("train_tokens", F.lit(total).cast("bigint"))


def release_shuffles(df: DataFrame) -> None:
    """Lets Spark remove the shuffle files of finished jobs, which it does when the driver collects its garbage."""
    for _ in range(2):  # what the first round frees holds further plans
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def trained_texts(blocks: DataFrame) -> int:
    """Number of training texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"n": [int(unpacked(t, np.uint8).sum()) for t in frame["train"]]}, dtype="int64")

    return int(blocks.select("train").mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def language_report(docs: DataFrame) -> DataFrame:
    """Scores of all rows; rows whose crc32(doc_id) modulo 7 is 2 are held out of the training."""
    scored = score_texts(docs, fold("doc_id", 7) != 2)
    return scored.select(
        F.col("_id").alias("doc_id"), (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
