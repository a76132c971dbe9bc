"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of the bigram and the unigram; the
unigram is smoothed by half a count, which leaves room for unknown words. Mixture weights depend on
how often the context was seen (buckets of powers of two) and are learned by
expectation-maximisation on deleted counts: each training token is predicted from the counts
without itself. EM runs on a histogram of all training tokens over (context bucket, bigram estimate,
unigram estimate) cells, whose size is bounded by the grid and whose counts grow with the corpus.

Counting is exact, over all training texts, in exchanges by bucket (see chunks). Tokens are lower-cased
(A-Z) words and an end per text. The context of a text's first token is the end mark.

Nulls: a null text is empty and has its end alone; a null doc_id is in the training part. Repeated
rows count as often as they occur. Without training texts all counts are 0 and every token has the
base's probability. Ties can't occur: counts and scores don't depend on any order. Empty table: no rows. Extra columns
are ignored, whatever their names. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, common, words

#: The end token's hash.
END = np.array([0xE1D0000000000001], words.U)
#: Buckets of context counts: 0, 1, 2-3, 4-7, and so on up to this many.
CONTEXTS = 24
#: Cells per power of two of an estimate in the histogram for EM; powers covered.
CELLS, POWERS = 4, 48
EM_STEPS = 60
FOLDS, HELD_FOLD = 5, 1


def training(ids: list) -> np.ndarray:
    """True for texts that are learned from: crc32 of the id as text, mod 5, is not 1."""
    return np.array([i is None or zlib.crc32(str(i).encode()) % FOLDS != HELD_FOLD for i in ids], bool)


class Tokens:
    """Token stream of a chunk: words and ends of all its texts, with contexts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        w = chunks.split_chunk(data, offs, lower=True)
        n = len(w.first) - 1
        self.first = w.first + np.arange(n + 1)  # each text has one token more
        self.key = np.insert(w.hashes, w.first[1:], END[0])
        before = np.empty_like(self.key)
        before[1:] = self.key[:-1]
        before[self.first[:-1]] = END[0]
        self.context = before
        self.pair = words.mix(before * words._NEXT + self.key)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of both orders in order, and where each token finds its unigram and bigram there."""
        return np.unique(self.key, return_inverse=True), np.unique(self.pair, return_inverse=True)


def _keys_of(row: dict):
    """A chunk's tokens and pairs with their counts in its training texts."""
    _, ids, data, offs = chunks.rows_of(row)
    t = Tokens(data, offs)
    learn = np.repeat(training(ids), np.diff(t.first))
    for order, (keys, at) in enumerate(t.keys(), 1):
        yield order, keys, np.bincount(at[learn], minlength=len(keys))


@dataclass
class Sizes:
    tokens: int
    types: int

    def base(self, count: np.ndarray, less: int = 0) -> np.ndarray:
        return (count + 0.5 - less) / (self.tokens - less + 0.5 * (self.types + 1))


class Counted:
    """A chunk's tokens with their counts over all training texts."""

    def __init__(self, row: dict, replies: list[dict]):
        self.chunk, self.ids, data, offs = chunks.rows_of(row)
        self.tokens = Tokens(data, offs)
        found = []
        for order, (keys, at) in enumerate(self.tokens.keys(), 1):
            counts = chunks.sums_of(replies, order)
            assert len(counts) == len(keys), "a sum is missing"
            found.append((keys, counts.astype(np.int64), at))
        (keys, counts, at), (_, pairs, pair_at) = found
        self.word = counts[at]
        self.pair = pairs[pair_at]
        # A context is a token of the chunk, or the end mark, which every chunk has.
        self.context = counts[np.minimum(np.searchsorted(keys, self.tokens.context), max(0, len(keys) - 1))] if len(keys) else counts
        self.learn = training(self.ids)


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, CONTEXTS - 1), 0)


HISTOGRAM = {"cell": pa.int64(), "n": pa.float64(), "two": pa.float64(), "one": pa.float64()}


def _cells(c: Counted, sizes: Sizes):
    """Deleted estimates of the training tokens, by cell: number, sum of bigram and of unigram estimates."""
    learn = np.repeat(c.learn, np.diff(c.tokens.first))
    context, pair, word = c.context[learn] - 1, c.pair[learn] - 1, c.word[learn]
    two = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    one = sizes.base(word, 1)
    step = lambda p: np.where(p > 0, 1 + np.clip((-np.log2(np.maximum(p, 1e-300)) * CELLS).astype(np.int64), 0, CELLS * POWERS - 1), 0)
    width = CELLS * POWERS + 1
    cell = (context_bucket(context) * width + step(two)) * width + step(one)
    own, at = np.unique(cell, return_inverse=True)
    return {"cell": own, "n": np.bincount(at, minlength=len(own)).astype(float), "two": np.bincount(at, weights=two, minlength=len(own)), "one": np.bincount(at, weights=one, minlength=len(own))}


def mixture(cells: list[tuple]) -> np.ndarray:
    """EM: the weight of the bigram for each context bucket."""
    weight = np.zeros(CONTEXTS)
    if not cells:
        return weight
    cell, n, two, one = (np.array(x, float) for x in zip(*cells, strict=True))
    bucket = cell.astype(np.int64) // (CELLS * POWERS + 1) ** 2
    two, one = two / n, one / n
    weight[1:] = 0.5
    total = np.bincount(bucket, weights=n, minlength=CONTEXTS)
    for _ in range(EM_STEPS):
        a = weight[bucket] * two
        share = np.divide(a, a + (1 - weight[bucket]) * one, out=np.zeros_like(a), where=a > 0)
        weight = np.divide(np.bincount(bucket, weights=n * share, minlength=CONTEXTS), total, out=np.zeros(CONTEXTS), where=total > 0)
    weight[0] = 0
    for k in range(2, CONTEXTS):  # a bucket without deleted counts takes its neighbour's weight
        if total[k] == 0:
            weight[k] = weight[k - 1]
    return np.minimum(weight, 0.999999)


SCORES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _scores(c: Counted, sizes: Sizes, weight: np.ndarray) -> dict:
    one = sizes.base(c.word)
    w = weight[context_bucket(c.context)]
    two = np.where(c.context > 0, c.pair / np.maximum(c.context, 1), 0.0)
    at = c.tokens.first[:-1]
    add = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]
    return {
        "doc_id": c.ids, "held_out": ~c.learn, "n_tokens": np.diff(c.tokens.first), "n_known": add((c.word > 0).astype(np.int64)), "train_tokens": np.full(len(at), sizes.tokens),
        "base_score": add(np.log10(one)), "score": add(np.log10(w * two + (1 - w) * one)),
    }


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learn from the training part of docs, score all of them."""
    packed = chunks.pack(spark, docs)
    replies, last = chunks.exchange(spark, packed, _keys_of, chunks.bucket_count(packed), name="lm-counts")
    sums = last.where("kind = 1").agg(F.sum("total"), F.sum("types")).first()
    sizes = Sizes(int(sums[0] or 0), int(sums[1] or 0))
    answered = replies.groupBy("sender")

    def joined(make, schema):
        def run(own: pa.Table, got: pa.Table) -> pa.Table:
            found = got.to_pylist()
            out = [chunks.batch(make(Counted(r, found)), schema) for r in own.to_pylist()]
            common.release()
            return pa.Table.from_batches(out, pa.schema(list(schema.items())))

        return packed.groupBy("chunk").cogroup(answered).applyInArrow(run, chunks.ddl(schema))

    cells = joined(lambda c: _cells(c, sizes), HISTOGRAM).groupBy("cell").agg(F.sum("n"), F.sum("two"), F.sum("one")) if sizes.tokens else None
    weight = mixture(sorted(tuple(r) for r in cells.collect())) if cells is not None else np.zeros(CONTEXTS)
    return joined(lambda c: _scores(c, sizes, weight), SCORES)


def log10_base(count: int, tokens: int, types: int) -> float:
    """The base's logarithm for one token, as the contract has it."""
    return math.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))
