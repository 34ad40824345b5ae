"""What the corpus operators share: the shared folder, written tables, and word hashing in numpy."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wardline.functions.shipping import ship

#: Bytes of text that one numpy pass takes at a time; a longer document is a pass of its own.
CHUNK_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset on one machine (tests) a temporary folder becomes the checkpoint folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wardline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends. What will be written may need the package."""
    ship(spark)
    path = f"{shared_dir(spark)}/wardline-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rpartition("/")[0]))
    return path


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffles that no DataFrame needs any more; the second pass frees what the first has let go."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: this cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._wardline_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete what table() wrote, once nothing reads it any more."""
    for t in tables:
        remove(t.sparkSession, t._wardline_path)


def raw_files(df: DataFrame, payload: str, *by: str, path: str) -> None:
    """Write each row's binary ``payload`` as the content of a file below ``by=value/`` folders.

    Spark's own writer does it, so any file system works and a repeated task leaves one copy.
    Each file ends with one extra line feed; formats carry their own lengths.
    """
    from pyspark.sql import functions as F

    df.select(F.col(payload).cast("string").alias("value"), *by).write.partitionBy(*by).option("lineSep", "\n").text(path)


# --- words ---------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(space))
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``data[start:end]``, eight bytes a step."""
    data = data + b"\0" * 8
    lanes = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    size = (ends - starts).astype(np.uint64)
    h = mix(size * _GOLD + np.uint64(1))
    some, at, left = np.arange(len(starts)), starts, size
    while len(some):
        v = lanes[at]
        short = left < 8
        v = np.where(short, v & ((np.uint64(1) << (np.minimum(left, np.uint64(7)) * np.uint64(8))) - np.uint64(1)), v)
        h[some] = mix((h[some] ^ v) * _GOLD + np.uint64(0x632BE59BD9B4E019))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - np.uint64(8)
    return h


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes: a polynomial in wrapping 64-bit arithmetic, then mixed."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return mix(out)


def doc_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts sum to ``limit`` bytes or are one document; null texts are empty."""
    for batch in batches:
        col = [b"" if t is None else t.encode() for t in batch.column(text).to_pylist()]
        i = 0
        while i < len(col):
            j, size = i + 1, len(col[i])
            while j < len(col) and size + len(col[j]) <= limit:
                size += len(col[j])
                j += 1
            yield batch.slice(i, j - i), col[i:j]
            i = j


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts with a line feed between, and where each starts (one more entry: the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return b"\n".join(texts), at


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and for each text where its words start (one more entry: the end)."""
    data, at = joined(texts)
    starts, ends = word_spans(data)
    return word_hashes(data, starts, ends), np.searchsorted(starts, at)


# --- sorted 64-bit arrays in few bytes -----------------------------------------------------------


def pack(a: np.ndarray, by_difference: bool = True) -> bytes:
    """Zstandard over the bytes of each place together; ascending arrays as differences."""
    import zstandard

    a = np.ascontiguousarray(a)
    if by_difference and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype: str, by_difference: bool = True) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    a = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return np.cumsum(a, dtype=dtype) if by_difference else a
