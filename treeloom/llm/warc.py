"""WARC archives: an index first, then coalesced byte-range reads of the chosen records.

`write_archives` turns rows into WARC/1.1 records, each a gzip member of its own, and returns an
index row per record: file, offset, length, URL, digest. `read_records` takes any subset of an
index, sorts it by place, merges neighbouring records into byte ranges, and reads each range once.

Nulls: a null payload is an empty one, a null URL an empty one; a row with a null key gets a record
with an empty WARC-Record-ID key and comes back with a null key. Repeated keys each get a record.
An empty table gives an empty index. Extra columns are ignored. A task that is run again writes
new files under new names; the index names only those of the attempt that was committed.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Payloads shorter than this are never replaced by a revisit record.
MIN_REVISIT_BYTES = 100
#: An archive file is closed at about this size.
FILE_BYTES = 1 << 30
#: Two chosen records are read in one go if the gap between them is at most this.
GAP_BYTES = 64 << 10
#: A byte range is closed at this size, so that a task holds little at once.
RANGE_BYTES = 4 << 20
#: The table of repeated payloads is broadcast up to so many rows (a row has about 80 bytes).
BROADCAST_ROWS = 200_000

INDEX = "file string, offset long, length long, url string, digest string, key long, record_type string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def mark_revisits(spark: SparkSession, rows: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add digest, n_bytes and refers_to (smallest key with the same payload, null for the first).

    Only payloads that occur more than once are joined back; that table is counted, and broadcast
    when it is small. Beyond the bound the join shuffles, and skewed digests are split at run time.
    """
    payload = F.encode(F.coalesce("payload", F.lit("")), "utf-8")
    rows = rows.withColumns({"digest": F.sha2(payload, 256), "n_bytes": F.octet_length(F.coalesce("payload", F.lit(""))).cast("long")})
    first = (
        rows.where(F.col("n_bytes") >= min_bytes).groupBy(F.col("digest").alias("again")).agg(F.min("key").alias("origin"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and origin is not null").select("again", "origin")
    )
    first = common.materialize(spark, first, "warc-copies")
    if first.count() <= broadcast_rows:
        first = F.broadcast(first)
    joined = rows.join(first, rows.digest == first.again, "left")
    is_copy = F.col("origin").isNotNull() & (F.col("n_bytes") >= min_bytes)
    later = is_copy & (F.coalesce(F.col("key") != F.col("origin"), F.lit(True)))
    return joined.select("key", "url", "payload", "digest", "n_bytes", F.when(later, F.col("origin")).alias("refers_to"))


def _record(key, url: str, payload: bytes, digest: str, refers) -> bytes:
    name = "" if key is None else str(key)
    kind = "response" if refers is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:key:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + " ".join(url.split()),
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        block = b""
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:key:{refers}>",
            f"X-Payload-Length: {len(payload)}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(spark: SparkSession, rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """rows: key long, url string, payload string, digest string, refers_to long. Returns the index, written."""
    common.prepare(spark)

    def write(batches):
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                found = []
                for key, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    url = url or ""
                    data = _member(_record(key, url, (payload or "").encode(), digest, refers))
                    out.write(data)
                    found.append((name, at, len(data), url, digest, key, "response" if refers is None else "revisit"))
                    at += len(data)
                cols = list(zip(*found, strict=True)) or [()] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    index = rows.select("key", "url", "payload", "digest", "refers_to").mapInArrow(write, INDEX)
    return common.materialize(spark, index, "warc-index")


def coalesce_ranges(index: DataFrame, gap: int = GAP_BYTES, size: int = RANGE_BYTES) -> DataFrame:
    """Chosen index rows to byte ranges: file, start, stop, members (offset, length) in order of place.

    Windows are over one archive file, whose size is bounded. A range ends where the next record
    lies over `gap` bytes away or in the next `size` bytes of the file.
    """
    place = Window.partitionBy("file").orderBy("offset")
    apart = F.coalesce(F.col("offset") - F.lag(F.expr("offset + length")).over(place) > gap, F.lit(True))
    block = F.floor(F.col("offset") / size)
    apart = apart | (block != F.coalesce(F.lag(block).over(place), F.lit(-1)))
    marked = index.select("file", "offset", "length", apart.cast("int").alias("apart")).withColumn("span", F.sum("apart").over(place))
    return marked.groupBy("file", "span").agg(
        F.min("offset").alias("start"), F.max(F.expr("offset + length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members")
    )


RECORD = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def _parse(data: bytes, keep: bool):
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    key = fields["WARC-Record-ID"][len("<urn:key:") : -1]
    key = int(key) if key else None
    url, kind = fields.get("WARC-Target-URI", ""), fields["WARC-Type"]
    if kind == "revisit":
        return key, url, kind, int(fields["WARC-Refers-To"][len("<urn:key:") : -1]), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].partition(":")[2], None
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha256(payload).hexdigest()
    if digest != fields["WARC-Payload-Digest"].partition(":")[2]:
        raise ValueError(f"the payload of record {key} doesn't match its digest")
    return key, url, kind, None, len(payload), digest, payload.decode() if keep else None


def read_records(spark: SparkSession, index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read the records that `index` names; digest and length of responses come from what was read."""
    ranges = coalesce_ranges(index)

    def read(batches):
        store, root = _open(folder)
        for batch in batches:
            for file, start, stop, members in zip(*(batch.column(k).to_pylist() for k in ("file", "start", "stop", "members")), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    data = f.read_at(stop - start, start)
                found = [_parse(zlib.decompress(data[m["offset"] - start : m["offset"] - start + m["length"]], 31), payloads) for m in members]
                cols = list(zip(*found, strict=True))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return ranges.mapInArrow(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive every page, then read all records back through the index."""
    rows = pages.select(F.col("page_id").cast("long").alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("payload"))
    folder = common.work_path(spark, "warc")
    index = write_archives(spark, mark_revisits(spark, rows), folder)
    return read_records(spark, index, folder, payloads=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
