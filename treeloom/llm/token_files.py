"""Token ids of documents as ORC files with metadata for pruning and stripe-parallel reads.

Documents are range-partitioned by id and sorted, encoded, and written by Spark's ORC writer:
integer run-length encoding of the ids, row indexes every ROW_STRIDE rows, Bloom filters on doc_id.
Readers split files by stripes and skip stripes and row groups that can't hold a wanted id.

Encoding goes piece by piece: a text is cut before single spaces between two other characters, where
no token of a byte-level tokenizer without prefix space can reach across, and a piece that a worker
has seen is not encoded again. The ids equal those of the whole text; texts with unusual white
space are cut only between printable ASCII characters.

Nulls: a null text is empty and has the end id alone; null doc_ids come first. Repeated ids keep one
row each, in order of a hash of their texts. Texts of any length are encoded whole. Empty table: no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

END_ID = 2
ROW_STRIDE = 1000
STRIPE_BYTES = 64 << 20
#: Bytes of text encoded at once by a task.
PIECE_BYTES = 2 << 20
#: Pieces remembered by a worker; beyond that it starts anew.
CACHE_PIECES = 2_000_000

#: White space that is not ASCII's space, tab, LF, VT, FF or CR, by Unicode's property. Fixed values.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_WIDE = _PLAIN.copy()
_WIDE[0x80:] = True
#: Between a letter or digit and a mark (not the apostrophe, for contractions) the first split always cuts.
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = _PLAIN & ~_ALPHA
_PUNCT[0x27] = False


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """Hash table from 64-bit piece hashes to runs of ids, in arrays, with linear probing."""

    def __init__(self, bits: int = 22):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        """Forget all pieces; a table that has grown is small again."""
        self._slots(self.bits)
        self.count = self.used = 0
        self.begin, self.size, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)

    def _slots(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, words.U)
        self.slot = np.zeros(1 << bits, np.int32)

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        """Put distinct hashes that are not in the table into free slots."""
        todo = np.arange(len(h))
        at = (h & words.U(self.mask)).astype(np.int64)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[todo[free]]  # of several for one place the last stays
            self.slot[at[free]] = number[todo[free]]
            done = free & (self.keys[at] == h[todo])
            todo, at = todo[~done], (at[~done] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 where it is not known."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        at = (h & words.U(self.mask)).astype(np.int64)
        while len(todo):
            there = self.keys[at]
            hit = there == h[todo]
            out[todo[hit]] = self.slot[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """h: distinct hashes that are not in the table."""
        n = len(h)
        self.begin, self.size = _room(self.begin, self.count + n), _room(self.size, self.count + n)
        self.ids = _room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[self.count : self.count + n] = size
        self.begin[self.count : self.count + n] = self.used + np.cumsum(size) - size
        bits = self.mask.bit_length()
        while 2 * (self.count + n) > 1 << bits:
            bits += 1
        if bits > self.mask.bit_length():  # half of the slots stay free, so that probing always ends
            old = np.flatnonzero(self.keys)
            keys, slot = self.keys[old], self.slot[old]
            self._slots(bits)
            self._place(keys, slot)
        self._place(h, np.arange(self.count, self.count + n, dtype=np.int32))
        self.count, self.used = self.count + n, self.used + len(flat)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    b = np.zeros(max(n, 2 * len(a)), a.dtype)
    b[: len(a)] = a
    return b


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 0x100 + k for k, b in enumerate(other)}


_LETTERS = _byte_letters()


class Encoder:
    """Encodes many texts; remembers the ids of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
        #: Pieces give the ids of the whole only with this kind of tokenizer.
        self.by_piece = plain and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) and " " not in t["content"] for t in spec.get("added_tokens", []))
        #: A special token must stay whole: where one occurs, punctuation is no place to cut.
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.table = PieceTable() if self.by_piece else None

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and n+1 offsets of each text's ids."""
        if not self.by_piece:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            found = [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        raw = data.tobytes()
        side = _PLAIN if _UNUSUAL.search(raw.decode()) else _WIDE
        cut = np.zeros(n + 1, bool)
        if n > 2:
            ok = side[data]
            cut[1 : n - 1] = (data[1:-1] == 0x20) & ok[:-2] & ok[2:]
            if not any(x in raw for x in self.special):
                cut[1:n] |= _PUNCT[data[1:]] & _ALPHA[data[:-1]]
        cut[offs] = True
        at = np.flatnonzero(cut)
        start, stop = at[:-1], at[1:]
        h = _hash(data, start, stop)
        place = self.table.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.table.count > CACHE_PIECES:
                self.table.clear()
                new = np.arange(len(h))
            own, first = np.unique(h[new], return_index=True)
            k = new[first]
            found = [self._ids(raw[a:b]) for a, b in zip(start[k].tolist(), stop[k].tolist(), strict=True)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.table.add(own, size, np.fromiter((x for e in found for x in e), np.int32, int(size.sum())))
            place[new] = self.table.find(h[new])
        size = self.table.size[place].astype(np.int64)
        ends = np.cumsum(size)
        shift = np.repeat(self.table.begin[place] - (ends - size), size)
        shift += np.arange(int(ends[-1]))
        return self.table.ids[shift], np.concatenate([[0], ends])[np.searchsorted(start, offs)].astype(np.int64)

    def _ids(self, piece: bytes) -> list[int]:
        text = piece.decode()
        word = text[1:] if text[0] == " " else text
        if word.isalpha() and max(word) < "\u0250":  # letters alone are one token of the first split
            return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_LETTERS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def _hash(data, start, stop):
    power, inverse = words._power_tables(len(data) + 1)
    values = words._BYTE[data]
    values *= power[: len(data)]
    total = np.empty(len(data) + 1, words.U)
    total[0] = 0
    np.cumsum(values, out=total[1:])
    h = total[stop] - total[start]
    h *= inverse[start]
    h += (stop - start).astype(words.U)
    h = words.mix(h)
    h[h == 0] = 1
    return h


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, text to doc_id, n_tokens, ids; the order of rows is kept. `path` must exist on every executor."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            data, at = common.text_bytes(batch.column(1))
            for i, j, b, o in common.pieces(data, at, PIECE_BYTES):
                ids, ends = enc.encode(b, o)
                if end_id is not None:
                    ids = np.insert(ids, ends[1:], end_id)
                    ends = ends + np.arange(len(ends))
                column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                common.release()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(ends)), column], names=["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>")


def write_orc(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID) -> None:
    """Encode documents and write them in ascending doc_id order."""
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    # Rows with one id, or none, are dealt by their texts, so that they don't meet in one task.
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    encoded = tokenize(ranged, path or tokenizer_path(), end_id).withColumn("row", F.monotonically_increasing_id())
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").orc(folder)
    )


def read_orc(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>, row bigint").orc(folder)


def find(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id; the filter reaches the files, whose statistics and Bloom filters prune."""
    return read_orc(spark, folder).where(F.col("doc_id").isin(list(doc_ids)))


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, row, start, n_tokens, ids_crc32 as read from the files.

    The upper bits of `row` number the file in order of doc_id. Files' totals are summed up over
    files, of which there are as many as write tasks; inside a file a window sums up the rest.
    """
    rows = read_orc(spark, folder)

    def crc(batches):
        for batch in batches:
            column = batch.column(2)
            offs = column.offsets.to_numpy()
            raw = column.values.to_numpy().astype("<u4", copy=False).view(np.uint8).data
            out = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.int64())], names=["doc_id", "n_tokens", "row", "ids_crc32"])

    each = rows.mapInArrow(crc, "doc_id bigint, n_tokens bigint, row bigint, ids_crc32 bigint").withColumn("part", F.shiftright("row", 33))
    totals = rows.groupBy(F.shiftright("row", 33).alias("p")).agg(F.sum("n_tokens").alias("total"))
    base = totals.withColumn("base", F.sum("total").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))).select("p", F.coalesce("base", F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, F.col("part") == F.col("p")).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and write all documents, then describe them from the files."""
    folder = common.work_path(spark, "tokens")
    write_orc(spark, docs, folder, path)
    return starts(spark, folder)
