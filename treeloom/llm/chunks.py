"""The corpus as packed chunks, and an exchange that adds up counts of keys over all chunks.

A chunk is some thousand whole texts in one row, compressed and written once to the shared folder.
Operators that need corpus-wide counts of shingles, windows or n-grams use `exchange`: each chunk
sends its distinct keys with their counts, by ranges of the hashed key, packed into one binary value
per range; the counts of each key are added up and every chunk gets the sums of its own keys.

A sender has at most FAN ranges in one step, so that a row carries about a hundred keys or more at any size of
the corpus. Where the corpus needs more buckets than that, steps are chained: FAN senders' keys of a
range are merged (the same key once), which makes a sender of the next step with its FAN finer
ranges; sums go back the same way. Rows are FAN per chunk and step, linear in the text, and a task
holds FAN rows of a FANth of a chunk's keys each. A key that occurs in a third of all texts is sent once per
chunk, then once per FAN chunks, so no task grows with a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: A chunk is closed at so many bytes of text or texts; one longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_TEXTS = 8 << 20, 1 << 16
#: Bytes of text per bucket of an exchange, and the ranges of a sender in one step.
BUCKET_BYTES, FAN = 4 << 20, 1 << 14
#: Bytes of text for a compressed byte, about.
RATIO = 3
#: Bits of a row number below the chunk's number.
ROW_BITS = 17

CHUNK = "chunk bigint, ids array<bigint>, offsets binary, text binary"


def pack(spark: SparkSession, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs: doc_id, text. A row per chunk; numbers come from the partition, and the table is committed once."""
    common.prepare(spark)

    def run(batches):
        base, k = TaskContext.get().partitionId() << 16, 0
        ids, data, ends, size = [], [], [0], 0

        def flush():
            nonlocal k
            whole = b"".join(data)
            data.clear()
            row = pa.RecordBatch.from_arrays(
                [pa.array([base + k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([common.blob(np.array(ends, np.int64))], pa.binary()), pa.array([pa.compress(whole, codec="zstd", asbytes=True)], pa.binary())],
                names=["chunk", "ids", "offsets", "text"],
            )
            del whole
            common.release()
            k += 1
            return row

        for batch in batches:
            raw, offs = common.text_bytes(batch.column(1))
            own = batch.column(0).to_pylist()
            for i, j, b, o in common.pieces(raw, offs, chunk_bytes // 8):
                if ids and (size + len(b) > chunk_bytes or len(ids) + j - i > CHUNK_TEXTS):
                    yield flush()
                    ids, ends, size = [], [0], 0
                ids += own[i:j]
                data.append(b.tobytes())
                ends += (o[1:] + size).tolist()
                size += len(b)
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CHUNK)
    return common.materialize(spark, rows, "chunks")


def text_size(chunks: DataFrame) -> int:
    """Bytes of text, about."""
    return int(chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * RATIO


def bucket_count(chunks: DataFrame, bucket_bytes: int | None = None) -> int:
    """Number of buckets for this corpus: grows with its bytes from the first one on."""
    return max(1, -(-text_size(chunks) // (bucket_bytes or BUCKET_BYTES)))


def bucket_of(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Bucket of each key below 2 ** bits: an equal share of the range, so sorted keys are sorted by bucket."""
    return ((keys >> words.U(bits - 32)) * words.U(buckets) >> words.U(32)).astype(np.int64)


def runs_of(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal numbers."""
    at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def short_keys(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, int]:
    """Keys shortened to 32 bits more than the number of buckets has, and their bits: for counts that need not be exact."""
    bits = min(64, 32 + max(1, buckets - 1).bit_length())
    return keys >> words.U(64 - bits), bits


ASKED = {"kind": pa.int64(), "slot": pa.int64(), "sender": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
SUMS = {"kind": pa.int64(), "slot": pa.int64(), "sender": pa.int64(), "counts": pa.binary(), "types": pa.int64(), "total": pa.int64()}


def ddl(schema: dict) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{k} {kinds[t]}" for k, t in schema.items())


def _ask(kind: int, sender: int, keys: np.ndarray, counts: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    """A row per slot that has keys; keys are in order, and so are their slots."""
    runs = runs_of(slot)
    return batch(
        {"kind": [kind] * len(runs), "slot": [int(slot[a]) for a, _ in runs], "sender": [sender] * len(runs), "keys": [common.pack_sorted(keys[a:z]) for a, z in runs], "counts": [common.pack_numbers(counts[a:z]) for a, z in runs]},
        ASKED,
    )


def _merged(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each row, distinct keys of all, their first places in the rows, each row key's place there, and sums."""
    rows.sort(key=lambda r: hash((r["slot"], r["sender"])))  # another row is the first one in each slot, the same in each run
    keys = [common.unpack_sorted(r["keys"]) for r in rows]
    own, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([common.unpack_numbers(r["counts"]) for r in rows]), minlength=len(own))
    return keys, own, first, at, total.astype(np.uint64)  # exact up to 2 ** 53


def _only(first: np.ndarray, told: np.ndarray) -> np.ndarray:
    """What rows are told, with the bit of a key's teller at its first place alone."""
    out = told & ~words.U(1)
    out[first] = told[first]
    return out


def _sum_up(most: int | None, least: int | None):
    def run(table: pa.Table) -> pa.Table:
        """A bucket's sums, in the order of each row's keys. The row of the least sender tells the bucket's types and total."""
        rows = table.to_pylist()
        keys, _, one, at, total = _merged(rows)
        told = total if most is None else np.minimum(total, words.U(most))
        told = told[at] if least is None else _only(one, np.where(total >= words.U(least), total * words.U(2) + words.U(1), words.U(0))[at])
        parts = np.split(told, np.cumsum([len(k) for k in keys])[:-1])
        first = min(range(len(rows)), key=lambda k: rows[k]["sender"])
        out = {k: [r[k] for r in rows] for k in ("kind", "slot", "sender")} | {"counts": [common.pack_numbers(x) for x in parts]}
        out["types"] = [int((total > 0).sum()) if k == first else 0 for k in range(len(rows))]
        out["total"] = [int(total.sum()) if k == first else 0 for k in range(len(rows))]
        common.release()
        return pa.Table.from_batches([batch(out, SUMS)])

    return run


def _merge(every: int, bits: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        """Senders of a range become one sender of the finer ranges, each `width` buckets wide."""
        rows = table.to_pylist()
        _, own, _, _, total = _merged(rows)
        common.release()
        return pa.Table.from_batches([_ask(rows[0]["kind"], rows[0]["group"], own, total, bucket_of(own, every, bits) // width)])

    return run


def _steps(buckets: int) -> tuple[int, int]:
    """Ranges of a sender in a step, and the number of steps, for at least so many buckets."""
    steps = 1
    while FAN**steps < buckets:
        steps += 1
    fan = max(1, round(buckets ** (1 / steps)))
    while fan**steps < buckets:
        fan += 1
    return fan, steps


def exchange(spark: SparkSession, packed: DataFrame, keys_of, buckets: int, bits: int = 64, most: int | None = None, name: str = "sums", least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sums of counts by key over all chunks.

    keys_of(row of a chunk) gives (kind, ascending distinct keys below 2 ** bits, counts) for each kind of key.
    Returns rows (kind, slot, sender, counts): a chunk's sums by kind, in the order of its keys if
    rows are taken by slot, packed by common.pack_numbers and, with `most`, not told beyond it; with `least`, sums below
    it are told as 0 and others as twice the sum, and to one of the key's chunks, its teller, as one more; and the rows of the
    last step, whose `types` and `total` sum up to the number of distinct keys with a count and to all counts.
    """
    fan, steps = _steps(buckets)
    every = fan**steps

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                for kind, keys, counts in keys_of(row):
                    yield _ask(kind, row["chunk"], keys, counts, bucket_of(keys, every, bits) // fan ** (steps - 1))
                common.release()

    asked = [packed.mapInArrow(ask, ddl(ASKED))]
    senders = packed.count() if steps > 1 else 0
    for step in range(1, steps):
        senders = -(-senders // fan)
        dealt = asked[-1].withColumn("group", F.pmod(F.xxhash64("sender"), F.lit(senders)))
        asked[-1] = common.materialize(spark, dealt, f"{name}-asked")
        asked.append(asked[-1].groupBy("kind", "slot", "group").applyInArrow(_merge(every, bits, fan ** (steps - 1 - step)), ddl(ASKED)))
    last = sums = common.materialize(spark, asked[-1].groupBy("kind", "slot").applyInArrow(_sum_up(most, least), ddl(SUMS)), name)
    for before in reversed(asked[:-1]):

        def back(own: pa.Table, got: pa.Table) -> pa.Table:
            rows = own.to_pylist()
            keys, merged, first, at, _ = _merged(rows)
            told = np.concatenate([common.unpack_numbers(r["counts"]) for r in sorted(got.to_pylist(), key=lambda r: r["slot"])])
            assert len(told) == len(merged), "a sum is missing"
            told = told[at] if least is None else _only(first, told[at])
            parts = np.split(told, np.cumsum([len(k) for k in keys])[:-1])
            out = {k: [r[k] for r in rows] for k in ("kind", "slot", "sender")} | {"counts": [common.pack_numbers(x) for x in parts], "types": [0] * len(rows), "total": [0] * len(rows)}
            return pa.Table.from_batches([batch(out, SUMS)])

        parent = sums.groupBy("kind", F.expr(f"slot div {fan}"), "sender")
        sums = before.groupBy("kind", "slot", "group").cogroup(parent).applyInArrow(back, ddl(SUMS))
    return sums.select("kind", "slot", "sender", "counts"), last


def sums_of(rows: list[dict], kind: int) -> np.ndarray:
    """A chunk's sums of a kind, from its rows of an exchange."""
    return np.concatenate([np.zeros(0, np.uint64), *[common.unpack_numbers(r["counts"]) for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["slot"])]])


def rows_of(row: dict) -> tuple[int, list, np.ndarray, np.ndarray]:
    """chunk, ids, bytes, offsets of a packed row."""
    offs = np.frombuffer(row["offsets"], np.int64)
    text = pa.decompress(row["text"], int(offs[-1]), codec="zstd", asbytes=True) if offs[-1] else b""
    return row["chunk"], row["ids"], np.frombuffer(text, np.uint8), offs


def split_chunk(data: np.ndarray, offs: np.ndarray, lower: bool, piece: int = 2 << 20) -> words.Words:
    """Words of a whole chunk, split piece by piece to bound memory."""
    parts, firsts, base = [], [np.zeros(1, np.int64)], 0
    for i, _, b, o in common.pieces(data, offs, piece):
        w = words.split(b, o, words.NOT_SPACE, lower)
        parts.append((w.hashes, w.starts + offs[i], w.ends + offs[i]))
        firsts.append(w.first[1:] + base)
        base += len(w.hashes)
    if not parts:
        z = np.zeros(0, np.int64)
        return words.Words(np.zeros(0, words.U), z, z, np.zeros(len(offs), np.int64))
    return words.Words(*(np.concatenate([p[k] for p in parts]) for k in range(3)), np.concatenate(firsts))


def batch(columns: dict, schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))
