"""Shared helpers: reading tables, durable cuts of lineage, and vectorised text hashing.

Text hashing works on whole Arrow buffers: a chunk of about CHUNK bytes of
concatenated UTF-8 is tokenised and hashed with a handful of NumPy passes, so
Python cost does not depend on the number of words.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20  # bytes of text that are hashed at a time
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64 constants
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package by name; make its root importable there. Unless the session says
    how large Arrow batches may be, they are small, as each task holds some in the JVM and in Python."""
    if ARROW_BYTES not in dict(spark.conf.getAll):
        spark.conf.set(ARROW_BYTES, str(4 << 20))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir. Where that is not set, a folder of this machine's, but only if the whole job runs on it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/marlstone-checkpoints"
    return f"{base}/{uuid.uuid4().hex}"


MERGED = 8
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, codec: str = "snappy", few_files: str = "") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at
    durable files, so a lost executor costs a re-read and no recomputation, and
    the shuffles that led there are deleted as soon as it is written. The default codec suits
    hashes and other numbers, which do not compress, and needs little memory outside the heap. With ``few_files``,
    a "wide" table has a file for MERGED of the session's shuffle partitions, but one for each core at least, and a "narrow" one, of a few numbers a row, one for each core."""
    spark = df.sparkSession
    path = shared_folder(spark)
    if few_files:
        merged = int(spark.conf.get("spark.sql.shuffle.partitions")) // MERGED if few_files == "wide" else 0
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, merged))
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing reads any more."""
    spark = tables[0].sparkSession
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives the memory that it no longer uses back to the system, as idle workers stay."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return wrapped


def slices(column: pa.Array, chunk: int = CHUNK, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) with about ``chunk`` bytes of text each, and at most ``rows`` rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1, at + (rows or n)))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, b in enumerate((BASE, BASE_INV)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * BASE**i; with span_hash any substring's hash costs O(1)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each [start, end), the same wherever the bytes stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are not ``between`` words (ASCII white space): starts, ends, and for each document its first word's index."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | cut[1:-1]
    last[:-1] &= gap[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each document its first word's index."""
    starts, ends, at = words(data, offsets)
    return span_hash(prefix_hash(data), starts, ends), at


def binary_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, by XXH3 of the bytes of each distinct word, so that no pattern of letters makes different words equal."""
    first, end, at = words(data, offsets)
    ends = np.concatenate(([0], np.cumsum(end - first)))
    flat = np.ascontiguousarray(data[~_SPACE[data]])
    encoded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w, BASE & 0xFFFFFFFF) for w in encoded.dictionary.to_pylist()), np.uint64, len(encoded.dictionary))
    return known[encoded.indices.to_numpy()], at


def shingles(hashes: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and each document's first index. A text of 1 to k-1 words has one shingle of all its words."""
    n = at[1:] - at[:-1]
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(n)), count)
    pos = np.arange(first[-1]) - first[doc] + at[doc]
    out = np.zeros(len(pos), np.uint64)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    for j in range(k):
        inside = pos + j < at[doc + 1]
        out = mix(out + np.where(inside, padded[pos + j], np.uint64(j + 1)) + np.uint64(0x9E3779B97F4A7C15))
    return out, first


def arrays_added(rows: DataFrame, keys: list[str], dtype: str) -> DataFrame:
    """``rows`` (keys, sums) with the arrays in ``sums`` (binary, little-endian) added up by their keys, of which each is an int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, ...], np.ndarray] = {}
        for batch in batches:
            for *key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[tuple(key)] = sums.get(tuple(key), 0) + np.frombuffer(raw, dtype)
        for key, x in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([x.tobytes()], pa.binary())], [*keys, "sums"])

    kind = ", ".join(f"{k} int" for k in keys) + ", sums binary"
    return rows.select(*[F.col(k).cast("int") for k in keys], "sums").repartition(*keys).mapInArrow(run, kind)


BROADCAST_ROWS = 1_000_000  # more numbers than this are joined by a shuffle


def joined(rows: DataFrame, few: DataFrame, key: str, how: str = "left_semi", numbers: int = 1) -> DataFrame:
    """``rows`` joined with a narrow table of ``numbers`` numbers a row, which is sent to all tasks if it has up to BROADCAST_ROWS of them, so that texts need not move."""
    small = few.limit(BROADCAST_ROWS // numbers + 1).count() <= BROADCAST_ROWS // numbers
    return rows.join(F.broadcast(few) if small else few, key, how)


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """A row's own id: equal for rows of one id and text only, and there when the id is null."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))


def wide_row_key(doc_id: str = "doc_id", text: str = "text"):
    """As ``row_key``, in 128 bits: two hashes of different seeds as one decimal."""
    part = lambda seed: F.xxhash64(F.lit(seed), F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text)).cast("decimal(19,0)")
    return (part(1) * F.lit(str(10**19)).cast("decimal(20,0)") + part(2)).cast("decimal(38,0)")


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def text_or_empty(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))
