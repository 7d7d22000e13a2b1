"""What the text operators share: stored intermediate tables and text as flat numpy arrays."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 512 << 10
#: Bytes of text whose words are looked up at once: the more, the more of them repeat.
WORD_BLOCK = 4 << 20
#: Settings of the C library's and Arrow's allocators in Python workers.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1000
#: Rows of two longs that may be broadcast, 16 MB.
BROADCAST_ROWS = 1_000_000
#: By application: its folder for stored tables, in local mode without spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where that is unset, a temporary one serves a driver that
    runs its tasks itself; on a cluster it is an error, as executors wouldn't see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lociframe-")
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later step reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither recompute it nor hang on
    executors that computed it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of TEXT_ROWS rows, unless the session says otherwise: batches are buffered whole on both sides of
    a Python worker, and Spark's usual 10,000 rows of text, or of pairs of long ones, take hundreds of MB. New Python
    workers also give large arrays back to the system as they are freed, rather than keep them for their next task."""
    for key, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(key, value)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(TEXT_ROWS))


def fresh(columns: list[str], *names: str) -> tuple[str, ...]:
    """names, with underscores added until no column is called so (case doesn't tell names apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def together(it: Iterator[pa.RecordBatch], rows: int = 3000) -> Iterator[pa.Table]:
    """The batches, so many rows of them at a time: more words of more texts are the same."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        held += [batch] * (len(batch) > 0)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def few_rows(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows of two longs at most, marked for broadcast if it is small enough for that."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has collected the plans that made them; ask for that between
    steps whose results are stored, so that the disk holds the shuffles of one step and not of all."""
    gc.collect()
    spark._jvm.System.gc()


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about limit bytes; null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, len(texts))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last byte + 1 and row of each word [^\\x20\\x09-\\x0D]+."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SEPARATORS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return begins, ends, np.searchsorted(offsets, begins, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, by differences of one running polynomial sum."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, len(data)), out=sums[1:])
    part = (sums[ends] - sums[begins]) * _powers(_INVERSE, len(data) + 1)[begins]
    return mix(part + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of size words of a row, in order; a row of fewer words gives one hash of them all."""
    counts = np.bincount(rows, minlength=n_rows)
    out_rows, out = [], []
    for k in range(1, size + 1):
        keep = (counts >= size) if k == size else (counts == k)
        if len(words) < k or not keep.any():
            continue
        h = np.full(len(words) - k + 1, k * int(_BASE) % (1 << 64), np.uint64)
        for i in range(k):
            h = (h ^ words[i : len(words) - k + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        at = np.flatnonzero((rows[: len(rows) - k + 1] == rows[k - 1 :]) & keep[rows[: len(rows) - k + 1]])
        out.append(mix(h[at]))
        out_rows.append(rows[at])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found_rows, found = np.concatenate(out_rows), np.concatenate(out)
    order = np.argsort(found_rows, kind="stable")
    return found_rows[order], found[order]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + length - 1."""
    total = int(lengths.sum())
    firsts = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else starts, lengths)
    return firsts + np.arange(total)
