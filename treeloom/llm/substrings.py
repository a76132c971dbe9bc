"""Removal of repeated passages, by a compressed FM-index per shard.

A window of WINDOW words is repeated if the same words start earlier: in a document with a smaller
id, or earlier in the same one. Words covered by a repeated window are removed.

Windows are dealt to shards by content, so that equal windows meet: a window's anchor is the least
hash among its runs of ANCHOR words. Windows in a row with the same anchor travel together as one
segment. An exchange of anchors (see chunks) first tells which anchors occur again at all;
the others can't hold a repeated window and send nothing. Windows of very frequent anchors travel one
by one under their own hash, so that no shard grows with a hot passage. Equal segments of a chunk
are sent once, their later copies are repeated by definition.

A shard indexes its segments in order of document and place and streams them through the index:
backward search over the wavelet matrix gives matching statistics, for each word the longest run
that ends there and occurs at least twice. Where they reach the window's length, the interval
names the window: of the streamed windows with one interval the first is kept, the others are
repeated. The shards' windows, the intervals above the threshold, go back to their chunks.

Nulls: a null text has no words; a null doc_id counts as larger than any other. Rows with equal ids
count in order of their place in the table. Texts with fewer words lose nothing. Ties of anchors
don't matter: equal windows have equal anchors. Texts of any length are read whole. Empty table: no
rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, common, words
from .fm_index import FMIndex

WINDOW, ANCHOR = 20, 8
#: Anchors with more runs than this are dealt window by window.
HOT_RUNS = 256
#: Bytes of text per shard, before anchors without another occurrence are left out.
SHARD_BYTES = 3 << 20
_LAST = np.iinfo(np.int64).max


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive hashes."""
    out, width = h, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < n:
        out = np.minimum(out[: len(out) - (n - width)], out[n - width :])
    return out


class Runs:
    """Windows of a chunk, grouped into runs with one anchor."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int, anchor: int):
        self.words = w = chunks.split_chunk(data, offs, lower=False)
        n = len(w.hashes) - window + 1
        if n <= 0:
            self.start = self.size = np.zeros(0, np.int64)
            self.anchor, self.places = np.zeros(0, words.U), np.zeros(0, np.int64)
            return
        valid = np.flatnonzero(w.left()[:n] >= window)
        grams, reach = words.windows(w.hashes, anchor), window - anchor
        anchors = _least(grams, reach + 1)[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (np.diff(valid) != 1) | (anchors[1:] != anchors[:-1])
        at = np.flatnonzero(new)
        self.start, self.size, self.anchor = valid[at], np.diff(np.append(at, len(valid))), anchors[at]
        close = np.zeros(len(grams), bool)
        for d in range(1, reach + 1):
            close[:-d] |= grams[:-d] == grams[d:]
        close = np.concatenate([[0], np.cumsum(close)])
        #: 2 where a run may hold its anchor at several places: a long run, or one with a gram that returns soon.
        self.places = 1 + ((self.size > reach + 1) | (close[np.minimum(self.start + self.size + reach, len(grams))] > close[self.start]))


SEGMENT = {"bucket": pa.int64(), "chunk": pa.int64(), "data": pa.binary(), "text": pa.binary()}
REMOVED = {"chunk": pa.int64(), "data": pa.binary()}
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
KEPT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "spans": SPANS}


def _short(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Keys for counting; the least hashes are small, so they are mixed first."""
    return chunks.short_keys(words.mix(anchors), buckets)[0]


def _keys_of(buckets: int, window: int, anchor: int):
    """A chunk's anchors and the places that each has there."""

    def run(row: dict):
        _, _, data, offs = chunks.rows_of(row)
        r = Runs(data, offs, window, anchor)
        keys, at = np.unique(_short(r.anchor, buckets), return_inverse=True)
        yield 1, keys, np.bincount(at, weights=r.places, minlength=len(keys))

    return run


def _segments(buckets: int, shards: int, window: int, anchor: int, hot: int):
    """Segments of shared anchors by bucket; what repeats inside the chunk goes straight to the end (negative bucket)."""

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in SEGMENT}
        found = got.to_pylist()
        for row in own.to_pylist():
            chunk, ids, data, offs = chunks.rows_of(row)
            r = Runs(data, offs, window, anchor)
            if not len(r.start):
                continue
            short = _short(r.anchor, buckets)
            keys = np.unique(short)
            places = chunks.sums_of(found, 1)
            assert len(places) == len(keys), "a sum is missing"
            kind = (1 * (places > 1) + (places > hot))[np.searchsorted(keys, short)]
            h, first = r.words.hashes, r.words.first
            whole = words.windows(h, window)
            power, inverse = words._power_tables(len(whole))
            total = np.empty(len(whole) + 1, words.U)
            total[0] = 0
            np.cumsum(whole * power[: len(whole)], out=total[1:])
            shared, frequent = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
            size = r.size[frequent]
            single = np.arange(size.sum()) + np.repeat(r.start[frequent] - (np.cumsum(size) - size), size)
            start = np.concatenate([r.start[shared], single])
            size = np.concatenate([r.size[shared], np.ones(len(single), np.int64)])
            route = np.concatenate([r.anchor[shared], whole[single]])
            same = words.mix((total[start + size] - total[start]) * inverse[start] + size.astype(words.U))
            text = np.searchsorted(first, start, "right") - 1
            order_id = np.array([_LAST if i is None else i for i in ids], np.int64)
            order = np.lexsort((start, text, order_id[text], same))
            again = np.zeros(len(order), bool)
            again[1:] = same[order][1:] == same[order][:-1]
            late = order[again]
            if len(late):
                out["bucket"].append(-1 - chunk)
                out["chunk"].append(chunk)
                out["data"].append(common.blob(np.column_stack([text[late], start[late] - first[text[late]], size[late]]).astype(np.uint32)))
                out["text"].append(b"")
            raw = data.tobytes()
            keep = order[~again]
            bucket = chunks.bucket_of(words.mix(route[keep]), shards)
            by = np.argsort(bucket, kind="stable")
            keep, bucket = keep[by], bucket[by]
            for a, z in chunks.runs_of(bucket):
                k = keep[a:z]
                begins, ends = r.words.starts[start[k]].tolist(), r.words.ends[start[k] + size[k] + window - 2].tolist()
                head = np.column_stack([order_id[text[k]], text[k], start[k] - first[text[k]], size[k]])
                out["bucket"].append(int(bucket[a]))
                out["chunk"].append(chunk)
                out["data"].append(common.squeeze(head))
                # The words themselves compress better than numbers or hashes of them would.
                out["text"].append(common.squeeze(np.frombuffer(b" ".join([raw[i:j] for i, j in zip(begins, ends, strict=True)]), np.uint8)))
        common.release()
        return pa.Table.from_batches([chunks.batch(out, SEGMENT)])

    return run


def _shard(window: int):
    """The windows of a shard that occur earlier, as runs per chunk."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["bucket"] < 0:
            return pa.Table.from_batches([chunks.batch({k: [r[k] for r in rows] for k in REMOVED}, REMOVED)])
        heads, texts, chunk_of = [], [], []
        for r in rows:
            data = common.expand(r["text"], np.uint8)
            head = common.expand(r["data"], np.int64).reshape(-1, 4)
            heads.append(head)
            texts.append(words.split(data, np.array([0, len(data)])).hashes)
            chunk_of.append(np.full(len(head), r["chunk"]))
        head, flat, chunk_of = np.concatenate(heads), np.concatenate(texts), np.concatenate(chunk_of)
        length = head[:, 3] + window - 1
        begin = np.cumsum(length) - length
        # In order of document id, row and place, so that a smaller position in the text is an earlier window.
        order = np.lexsort((head[:, 2], head[:, 1], chunk_of, head[:, 0]))
        head, chunk_of, length, begin = head[order], chunk_of[order], length[order], begin[order]
        vocabulary, codes = np.unique(flat, return_inverse=True)
        place = np.cumsum(length + 1) - (length + 1)  # a separator after each segment
        text = np.zeros(int((length + 1).sum()), np.int64)
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        text[np.repeat(place, length) + inside] = codes[np.repeat(begin, length) + inside] + 1
        index = FMIndex(text, len(vocabulary) + 1, window, least=2)
        size = head[:, 3]
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ends = np.repeat(place, size) + offset + window
        matched, low, _ = index.matching_statistics(text, ends, window, least=2)
        # Windows above the threshold; one interval holds all occurrences of a window, in the order of streaming.
        full = np.flatnonzero(matched == window)
        _, first, name = np.unique(low[full], return_index=True, return_inverse=True)
        late = full[first[name] < np.arange(len(full))]
        del index, text, low
        segment = np.repeat(np.arange(len(size)), size)[late]
        start = head[segment, 2] + offset[late]
        new = np.ones(len(late), bool)
        new[1:] = (np.diff(segment) != 0) | (np.diff(start) != 1)
        at = np.flatnonzero(new)
        runs = np.column_stack([head[segment[at], 1], start[at], np.diff(np.append(at, len(late)))]).astype(np.uint32)
        owner = chunk_of[segment[at]]
        own = np.unique(owner)
        common.release()
        return pa.Table.from_batches([chunks.batch({"chunk": own, "data": [common.blob(runs[owner == c]) for c in own]}, REMOVED)])

    return run


def _kept(window: int):
    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in KEPT}
        runs = np.concatenate([np.zeros((0, 3), np.uint32), *[np.frombuffer(d, np.uint32).reshape(-1, 3) for d in got.column("data").to_pylist()]]).astype(np.int64)
        for row in own.to_pylist():
            _, ids, data, offs = chunks.rows_of(row)
            w = chunks.split_chunk(data, offs, lower=False)
            edge = np.zeros(len(w.hashes) + 1, np.int64)
            start = w.first[runs[:, 0]] + runs[:, 1]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + runs[:, 2] + window - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            raw = data.tobytes()
            keep = np.flatnonzero(~gone)
            bounds = np.searchsorted(keep, w.first)
            begins, ends = w.starts[keep].tolist(), w.ends[keep].tolist()
            # Spans of removed words, by text; a text's border ends a span.
            inner = np.zeros(len(gone) + 1, bool)
            inner[w.first] = True
            opens = np.flatnonzero(gone & (~np.concatenate([[False], gone[:-1]]) | inner[:-1])) if len(gone) else np.zeros(0, np.int64)
            closes = np.flatnonzero(gone & (~np.concatenate([gone[1:], [False]]) | inner[1:])) + 1 if len(gone) else np.zeros(0, np.int64)
            at = np.searchsorted(opens, w.first)
            first = w.first.tolist()
            for k, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                n = first[k + 1] - first[k]
                out["doc_id"].append(ids[k])
                out["n_words"].append(n)
                out["n_removed"].append(n - (z - a))
                out["kept"].append(b" ".join([raw[i:j] for i, j in zip(begins[a:z], ends[a:z], strict=True)]).decode())
                out["spans"].append([{"start": int(i) - first[k], "stop": int(j) - first[k]} for i, j in zip(opens[at[k] : at[k + 1]], closes[at[k] : at[k + 1]], strict=True)])
        common.release()
        return pa.Table.from_batches([chunks.batch(out, KEPT)])

    return run


def repeated_runs(spark: SparkSession, packed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT_RUNS) -> DataFrame:
    """chunk, data: runs of repeated windows as triples of 32-bit numbers (text in the chunk, first word, windows)."""
    buckets, shards = chunks.bucket_count(packed), chunks.bucket_count(packed, SHARD_BYTES)
    bits = chunks.short_keys(np.zeros(0, words.U), buckets)[1]
    sums, _ = chunks.exchange(spark, packed, _keys_of(buckets, window, anchor), buckets, bits, hot + 1, "anchors")
    segments = packed.groupBy("chunk").cogroup(sums.groupBy("sender")).applyInArrow(_segments(buckets, shards, window, anchor, hot), chunks.ddl(SEGMENT))
    return common.materialize(spark, segments.groupBy("bucket").applyInArrow(_shard(window), chunks.ddl(REMOVED)), "repeated-runs")


def deduplicate(spark: SparkSession, docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and spans (start, stop of removed words) for every document."""
    packed = chunks.pack(spark, docs)
    runs = repeated_runs(spark, packed, window, anchor, hot)
    schema = chunks.ddl({k: t for k, t in KEPT.items() if t != SPANS}) + ", spans array<struct<start: bigint, stop: bigint>>"
    return packed.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(_kept(window), schema)


def report(spark: SparkSession, docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT_RUNS) -> DataFrame:
    """The digest form: doc_id, n_words, n_removed, kept_sha256 for every document."""
    return deduplicate(spark, docs, window, anchor, hot).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
