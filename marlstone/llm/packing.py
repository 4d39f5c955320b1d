"""Best-fit packing with large-item matching.

Method. Texts are encoded, ended with an end-of-text id and, only if longer
than the capacity, cut (a short remainder comes first, so that all later pieces
are full). Packing depends on lengths alone, and there are at most ``capacity``
of them, so the driver packs the *histogram*: pieces above a third of the
capacity pair at most two to a bin by greedy matching (longest with the longest
that fits), then shorter ones go, longest first, to the smallest gap that holds
them. A step handles all equal bins and equal pieces at once, so a plan has a few
thousand entries at any input size. Pieces find their place by their rank among
pieces of the same length; ranks come from per-task counters plus prefix sums
over (task, length), so no length, however common, meets in one task.

Edge cases: null text is empty; an empty text is one piece holding only the end
id; repeated rows are packed each; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import released, stored, table, workers_find_package
from marlstone.llm.tokens import END_OF_TEXT, default_vocabulary, encoded

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_OF_TEXT, with_ids: bool = False) -> DataFrame:
    """A row for each piece. ``task`` and ``nth`` number pieces of one length within a task;
    store the result before use, as the numbers depend on how rows were dealt."""
    workers_find_package(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            doc_id = batch.column(0)
            for at, end, ids, first in encoded(batch.column(1), path):
                out, held = [], []
                for i, doc in enumerate(doc_id.slice(at, end - at).to_pylist()):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    for k, (s, n) in enumerate(cut(len(own), capacity)):
                        part = own[s : s + n]
                        out.append((doc, k, s, n, zlib.crc32(part), task, int(seen[n])))
                        seen[n] += 1
                        if with_ids:
                            held.append(part.astype(np.int32))
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(held, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(released(run), PIECES + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Place ``counts[length]`` pieces of each length. An entry (length, first, count, bin, each, offset)
    puts pieces first..first+count-1 of that length into bins bin, bin+1, ..., ``each`` to a bin, from ``offset`` on."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}  # gap: [(first bin, bins)]
    bins = 0

    def place(n: int, count: int, at: int, each: int, offset: int) -> None:
        out.append((n, used[n], count, at, each, offset))
        used[n] += count
        left[n] -= count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and m <= n and left[m] > (m == n)), None)
            if mate is None:
                count = left[n]
                place(n, count, bins, 1, 0)
                gap = capacity - n
            elif mate == n:
                count = left[n] // 2
                place(n, 2 * count, bins, 2, 0)
                gap = capacity - 2 * n
            else:
                count = min(left[n], left[mate])
                place(n, count, bins, 1, 0)
                place(mate, count, bins, 1, n)
                gap = capacity - n - mate
            open_bins.setdefault(gap, []).append((bins, count))
            bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g in open_bins if g >= n), default=None)
            if gap is None:
                each = capacity // n
                count = -(-left[n] // each)
                gap, at = capacity, bins
                bins += count
            else:
                at, count = open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap]
            each = gap // n
            full = min(count, left[n] // each)
            if full:
                place(n, full * each, at, each, capacity - gap)
                open_bins.setdefault(gap - each * n, []).append((at, full))
            if full < count and left[n]:  # fewer than a bin's worth remain
                some = left[n]
                place(n, some, at + full, some, capacity - gap)
                open_bins.setdefault(gap - some * n, []).append((at + full, 1))
                full += 1
            if full < count and at + full < bins:
                open_bins.setdefault(gap, []).append((at + full, count - full))
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored ``pieces``."""
    spark = parts.sparkSession
    counts = parts.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    entries = plan(histogram, capacity)
    fields = ["length", "first", "count", "bin", "each", "at"]
    schema = T.StructType([T.StructField(f, T.LongType()) for f in fields])
    by_length = spark.createDataFrame(entries, schema).groupBy("length").agg(F.collect_list(F.struct(*fields[1:])).alias("entries"))
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    ranked = parts.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(F.broadcast(by_length), "length").withColumn(  # a row for each length: at most `capacity`
        "e", F.filter("entries", lambda e: (F.col("rank") >= e["first"]) & (F.col("rank") < e["first"] + e["count"]))[0]
    )
    within = F.col("rank") - F.col("e.first")
    return placed.select(
        *[c for c in parts.columns if c not in ("task", "nth")],
        (F.col("e.bin") + F.floor(within / F.col("e.each"))).cast("long").alias("sequence_id"),
        (F.col("e.at") + (within % F.col("e.each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(stored(pieces(docs, capacity, vocabulary, with_ids=with_ids)), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
