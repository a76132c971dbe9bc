"""Session settings, shared folders and Arrow column access used by the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch sent to Python: whole texts can be long, so batches are closed at either bound.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the size of the Arrow batches that carry whole texts, where the session has a larger bound."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None) or ""
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give memory that a worker has freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim  # glibc's; other C libraries have none and need none
except (AttributeError, OSError, TypeError):
    _trim = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is spark.checkpoint.dir of the session. Where that is unset, a local master (tests on one
    machine) gets a temporary folder; on a cluster there is no such folder to choose.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="treeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Work folders of this driver, in order of their making.
CREATED: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    CREATED.append(f"{shared_dir(spark)}/treeloom/{name}-{uuid.uuid4().hex}")
    return CREATED[-1]


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(data: np.ndarray, offs: np.ndarray, limit: int):
    """Cut a batch into runs of whole texts of about `limit` bytes: (first, last, bytes, offsets)."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an array, compressed, for what is shuffled in large amounts."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def expand(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b"", kind)


def pack_numbers(a: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes: only as many bytes of each as the largest needs, equal bytes of all side by side, compressed."""
    a = np.ascontiguousarray(a, np.uint64)
    width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    head = len(a).to_bytes(7, "little") + bytes([width])
    if not width:
        return head
    return head + pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), codec="zstd", asbytes=True)


def unpack_numbers(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:7], "little"), data[7]
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return pack_numbers(np.diff(a, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


def free_name(wanted: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()
