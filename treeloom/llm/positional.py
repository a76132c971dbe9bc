"""Benchmark decontamination over a distributed positional inverted index.

`build_index` stores, per segment of the corpus, the word positions of every term (postings) as one
ascending list of (term, position): a term's list is a run of it, sorted by position. The index knows no
benchmark; it is written once and answers any number of them. `match` answers phrases against it: the
lists of a phrase's terms are intersected from the rarest term of the segment on, each shifted by the term's
place in the phrase, for all phrases of a block at once; what is left after the last list is an exact
occurrence. With `slop`, places where all terms of a phrase lie, as often as it has them, within a span of its length and
`slop` more words, in any order, are found the same way: from the rarest term's places by the neighbourhood of the
other lists. The benchmark is read block by block, each of bounded size, and a block is dropped when it has been answered.

Nulls: a null text has no words; a null doc_id stays null in the results; a benchmark row with a
null text or id is no item. Repeated documents are each reported; items with equal ids count once. Ties of
rarity go to the earlier term of the phrase. Texts of any length are read whole. Empty tables:
no items give no hits, no documents give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: Words of a window.
WINDOW = 10
#: A segment is closed at about so many bytes of text.
SEGMENT_BYTES = 12 << 20
#: Benchmark words held by a task at once; a larger benchmark is looked up in several blocks.
BLOCK_WORDS = 2_000_000
#: Words more than its length that a phrase's terms may spread over to be near.
SLOP = 2
#: Places looked at together.
BATCH_PLACES = 1 << 20

SEGMENT = "segment bigint, ids array<bigint>, first binary, terms binary, postings binary"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
FOUND = "rid bigint, doc_id bigint, n_words bigint, spans array<struct<start: bigint, stop: bigint>>, items array<bigint>, near array<bigint>"


class Phrases:
    """A block of the benchmark, (item id, text) in order of id: windows of term numbers, all of it bounded by BLOCK_WORDS."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        raw = [t.encode() for _, t in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in raw], dtype=np.int64)]).astype(np.int64)
        w = words.split(data, offs, words.ALNUM, lower=True)
        self.vocabulary = np.unique(w.hashes)
        term = np.searchsorted(self.vocabulary, w.hashes).astype(np.int64)
        self.items = [i for i, _ in items]
        by_length: dict[int, list] = {}
        for k in range(len(items)):
            a, b = w.first[k], w.first[k + 1]
            n = min(window, b - a)
            if n:
                rows = np.lib.stride_tricks.sliding_window_view(term[a:b], n)
                by_length.setdefault(int(n), []).append((np.full(len(rows), k), rows))
        #: Per length of window: the item's place and the term numbers of each window.
        self.windows = [(n, np.concatenate([x[0] for x in v]), np.concatenate([x[1] for x in v])) for n, v in sorted(by_length.items())]


def phrase_blocks(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The benchmark as blocks of bounded size, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // (block_words * 6)))
    items = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    for k in range(n):
        rows = [(r.i, r.t) for r in items.where(F.col("block") == k).toLocalIterator()]
        if rows:
            yield Phrases(sorted(rows), window)


def build_index(spark: SparkSession, docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """docs: doc_id, text. One row per segment with the postings of all its terms, written to the shared folder."""
    common.prepare(spark)

    def build(batches):
        base, k = TaskContext.get().partitionId() << 16, 0
        ids, hashes, firsts, size, n = [], [], [np.zeros(1, np.int64)], 0, 0

        def segment():
            nonlocal k
            terms, rank = np.unique(np.concatenate(hashes), return_inverse=True)
            postings = rank.astype(np.uint64) << words.U(32) | np.arange(len(rank), dtype=np.uint64)
            postings.sort()
            row = pa.RecordBatch.from_arrays(
                [pa.array([base + k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (common.pack_sorted(np.concatenate(firsts).astype(np.uint64)), common.pack_sorted(terms), common.pack_sorted(postings)))],
                names=["segment", "ids", "first", "terms", "postings"],
            )
            del terms, rank, postings
            common.release()
            k += 1
            return row

        for batch in batches:
            bytes_, at = common.text_bytes(batch.column(1))
            own = batch.column(0).to_pylist()
            for i, j, b, o in common.pieces(bytes_, at, segment_bytes // 4):
                w = words.split(b, o, words.ALNUM, lower=True)
                ids += own[i:j]
                hashes.append(w.hashes)
                firsts.append(w.first[1:] + n)
                n += len(w.hashes)
                size += len(b)
                if size >= segment_bytes:
                    yield segment()
                    ids, hashes, firsts, size, n = [], [], [np.zeros(1, np.int64)], 0, 0
        if ids:
            yield segment()

    index = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, SEGMENT)
    return common.materialize(spark, index, "positional-index")


class Segment:
    """Postings of one segment, and the lists of a block's terms in it."""

    def __init__(self, row: dict, block: Phrases):
        self.ids = row["ids"]
        self.first = common.unpack_sorted(row["first"]).astype(np.int64)
        self.postings = common.unpack_sorted(row["postings"])
        terms = common.unpack_sorted(row["terms"])
        k = np.minimum(np.searchsorted(terms, block.vocabulary), max(0, len(terms) - 1))
        there = terms[k] == block.vocabulary if len(terms) else np.zeros(len(k), bool)
        self.key = k.astype(np.uint64) << words.U(32)
        self.begin = np.searchsorted(self.postings, self.key)
        self.size = np.where(there, np.searchsorted(self.postings, self.key + words.U(1 << 32)) - self.begin, 0)

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def at_least(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where in the postings a term's entries from a place on begin."""
        return np.searchsorted(self.postings, self.key[term] + np.maximum(place, 0).astype(np.uint64))

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a term stands at a place."""
        key = self.key[term] + np.maximum(place, 0).astype(np.uint64)
        look = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
        return (place >= 0) & (self.postings[look] == key)

    def rare_places(self, rows: np.ndarray):
        """Of windows whose terms all occur: batches of (window, columns from the rarest term on, place of the rarest term)."""
        freq = self.size[rows]
        alive = np.flatnonzero(freq.min(axis=1) > 0)
        if not len(alive):
            return
        order = np.argsort(freq[alive], axis=1, kind="stable")
        rare = rows[alive, order[:, 0]]
        count = self.size[rare]
        ends = np.cumsum(count)
        low = 0
        while low < len(alive):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BATCH_PLACES, "right")))
            n = count[low:high]
            which = np.repeat(np.arange(low, high), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.begin[rare[which]]
            yield alive[which], order[which], (self.postings[at] & words.U(0xFFFFFFFF)).astype(np.int64)
            low = high

    def exact(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and first places of all their occurrences: lists are intersected from the rarest term on."""
        n, found = rows.shape[1], []
        for window, order, place in self.rare_places(rows):
            start = place - order[:, 0]
            for j in range(1, n):
                column = order[:, j]
                on = self.has(rows[window, column], start + column)
                window, order, start = window[on], order[on], start[on]
            inside = (start >= 0) & (start + n <= self.first[self.text_of(np.maximum(start, 0)) + 1])
            found.append((window[inside], start[inside]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *[f[k] for f in found]]) for k in (0, 1))

    def near(self, rows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and places of their rarest term in spans that hold all terms, as often as the window does."""
        n, found = rows.shape[1], []
        span = n + slop
        need = (rows[:, :, None] == rows[:, None, :]).sum(axis=2)
        for window, order, place in self.rare_places(rows):
            text = self.text_of(place)
            low, high = np.maximum(self.first[text], place - span + 1), np.minimum(self.first[text + 1], place + span)
            for j in range(1, n):
                term = rows[window, order[:, j]]
                on = self.at_least(term, high) > self.at_least(term, low)
                window, order, place, low, high = window[on], order[on], place[on], low[on], high[on]
            fits = np.zeros(len(window), bool)
            for back in range(span):
                todo = np.flatnonzero(~fits & (place - back >= low))
                start = place[todo] - back
                stop = np.minimum(start + span, high[todo])
                for j in range(n):
                    term = rows[window[todo], j]
                    on = self.at_least(term, stop) - self.at_least(term, start) >= need[window[todo], j]
                    todo, start, stop = todo[on], start[on], stop[on]
                fits[todo] = True
            found.append((window[fits], place[fits]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *[f[k] for f in found]]) for k in (0, 1))


def _pairs(text: np.ndarray, item: np.ndarray, names: list[int], n: int) -> list[list[int]]:
    """Distinct item ids of each text."""
    out: list[list[int]] = [[] for _ in range(n)]
    own = np.unique(text * (len(names) + 1) + item)
    for t, i in zip((own // (len(names) + 1)).tolist(), (own % (len(names) + 1)).tolist(), strict=True):
        if not out[t] or out[t][-1] != names[i]:  # equal ids stand side by side
            out[t].append(names[i])
    return out


def match(spark: SparkSession, index: DataFrame, block: Phrases, slop: int | None = None) -> DataFrame:
    """Per document of the index: spans of words inside an occurrence of a window, items with occurring windows, and with slop items with near ones."""
    shared = spark.sparkContext.broadcast(block)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                phrases = shared.value
                seg = Segment(row, phrases)
                total, n = int(seg.first[-1]), len(seg.ids)
                edge = np.zeros(total + 1, np.int64)
                hit, close = [(np.zeros(0, np.int64),) * 2], [(np.zeros(0, np.int64),) * 2]
                for length, item, rows in phrases.windows if total else ():
                    window, start = seg.exact(rows)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + length, -1)
                    hit.append((seg.text_of(start), item[window]))
                    if slop is not None:
                        window, place = seg.near(rows, slop)
                        close.append((seg.text_of(place), item[window]))
                covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                border = np.zeros(total + 1, bool)
                border[seg.first] = True
                # A span ends where coverage does, and at the end of its text.
                opens = np.flatnonzero(covered[1:-1] & (~covered[:-2] | border[:-1])) if total else np.zeros(0, np.int64)
                closes = np.flatnonzero(covered[1:-1] & (~covered[2:] | border[1:])) + 1 if total else np.zeros(0, np.int64)
                at = np.searchsorted(opens, seg.first)
                first = np.repeat(seg.first[:-1], np.diff(at))
                spans = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(opens - first, pa.int64()), pa.array(closes - first, pa.int64())], ["start", "stop"]))
                items, near = (_pairs(*(np.concatenate([f[k] for f in x]) for k in (0, 1)), phrases.items, n) for x in (hit, close))
                common.release()
                yield pa.RecordBatch.from_arrays(
                    [pa.array((row["segment"] << 32) + np.arange(n), pa.int64()), pa.array(seg.ids, pa.int64()), pa.array(np.diff(seg.first)), spans, pa.array(items, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))],
                    names=["rid", "doc_id", "n_words", "spans", "items", "near"],
                )

    return index.mapInArrow(run, FOUND)


def covered_words(spans: str) -> Column:
    """Words inside spans, sorted by start; those inside several count once."""
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end"))
    zero = F.lit(0).cast("long")
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("n"), zero.alias("end")), step, lambda a: a["n"])


def search(spark: SparkSession, index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, near for every document of an index.

    A benchmark of several blocks is answered block by block; what a block finds is written, and the blocks' finds are
    put together by document.
    """
    blocks = phrase_blocks(spark, benchmark, window, block_words)
    block, parts = next(blocks, None), []
    while block is not None:
        after = next(blocks, None)
        found = match(spark, index, block, slop)
        parts.append(common.materialize(spark, found, "hits-of-block") if after is not None or parts else found)
        block = after
    if not parts:
        parts.append(match(spark, index, Phrases([], window), slop))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if len(parts) > 1:
        joined = lambda c: F.flatten(F.collect_list(c)).alias(c)
        merged = found.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), joined("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        found = merged
    return found.select("doc_id", "n_words", covered_words("spans").alias("n_hit"), "spans", "items", "near")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items and near (arrays of item ids) for every document."""
    return search(spark, build_index(spark, docs), benchmark, window, slop)


def digest(items: list[int]) -> str:
    """Hash of item ids sorted as strings."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, slop: int | None = SLOP) -> DataFrame:
    """The digest form: counts, a hash of the items' ids, and the number of items with near windows."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return decontaminate(spark, docs, benchmark, slop=slop).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near_items")
    )
