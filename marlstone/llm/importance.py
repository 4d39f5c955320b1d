"""Importance resampling towards a target corpus, by a dictionary of distinct n-gram features.

Method. Features are all runs of 1 to 3 words. Texts become blocks of a few MB: the words of a block as numbers into its own sorted list of words. For each length of
run in turn, a block sends each of its distinct features once, as a string with its count, to the part of the dictionary that the string's hash names. A part holds
all blocks' strings: it finds the distinct ones by their bytes, counts them over all documents and over the target texts, hashes each of them once (CRC-32 modulo BUCKETS), adds
the counts to the buckets, and answers each block with the buckets of what it sent, in the same order. From the buckets' counts follow the gains, BUCKETS numbers, and the
answers join them back to the blocks' own features, where each document's gains are added up. Documents with enough words are then drawn by weight plus
Gumbel noise that is fixed by seed and id: one distributed sort by score gives the ranks.

Pieces of work follow the input: blocks by bytes, parts of the dictionary by words. A feature is sent once by a block however often it occurs, so no
frequent word or pair makes a part large, and memory is that of one block or one part of one length. What is sent is sorted and compressed, and lengths of run are done one after
another (the longest, most of which are distinct, in two rounds of half the parts), so that only some of it is on disk at a time. The driver sees the buckets' counts and a number of rows for each part of the sort.

Edge cases: a null or empty text has no words: no features, weight 0, and it is never drawn; a null id hashes as an empty one and comes after
others at equal scores; repeated rows are documents of their own, with ranks of their own; a document larger than a block is a block. Empty target texts leave t = 0 everywhere; empty documents give an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import arrays_added, mix, prefix_hash, slices, span_hash, stored, table, words, workers_find_package

LONGEST, BUCKETS = 3, 10_000
SEED, LEAST_WORDS, SHARE = 42, 20, (5, 100)
BLOCK_BYTES = 8 << 20  # of text in a block
PART_WORDS = 1 << 20  # words of all texts for each part of the dictionary
SENDINGS = {1: 1, 2: 1, 3: 2}  # for each length of run, in how many rounds parts of the dictionary are filled
CRC_ROWS = 1 << 16
SLAB = 1_000  # buckets that are added up together
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = np.ones(256, bool)
_BETWEEN[0x30:0x3A] = _BETWEEN[0x61:0x7B] = _BETWEEN[0x80:] = False


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end]: a step takes the next byte of all, of as many as the processor's cache holds, that still have one."""
    if len(start) > CRC_ROWS:
        return np.concatenate([crc32(data, start[i : i + CRC_ROWS], end[i : i + CRC_ROWS]) for i in range(0, len(start), CRC_ROWS)])
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(start - end, kind="stable")  # longest first
    at, reg, length = start[order], out[order], (end - start)[order]
    for k in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -k))
        reg[:n] = (reg[:n] >> 8) ^ _CRC[(reg[:n] ^ data[at[:n] + k]) & 0xFF]
    out[order] = ~reg
    return out


def grouped(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their keys (0 <= key < width) and, for each position in that order, whether a new key begins; equal keys stay in the order of their positions."""
    bits = len(key).bit_length()
    if width < 1 << 62 - bits:  # key and position fit in one number, and numbers sort much faster than positions by their keys
        both = np.sort(key << bits | np.arange(len(key)))
        order, key = both & (1 << bits) - 1, both >> bits
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return order, new


def numbered(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each position the rank of its key, from what ``grouped`` gives."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def packed(x: bytes | np.ndarray) -> bytes:
    """Compressed bytes; numbers are split into planes of equal rank, of which the high ones are mostly zero."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if isinstance(x, np.ndarray) and len(x) else bytes(x)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(raw: bytes, dtype: str = "u1") -> np.ndarray:
    flat = np.frombuffer(pa.Codec("zstd", 1).decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


class Block:
    """Words of some documents: ``ids`` are ranks in the sorted list ``vocabulary``, document i has those from start[i] to start[i + 1]."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, vocabulary: pa.Array):
        self.ids, self.start, self.vocabulary = ids.astype(np.int64), start, vocabulary

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Block:
        data = _LOWER[data]
        first, end, start = words(data, offsets, _BETWEEN)
        kept = data[~_BETWEEN[data]]  # words only, without anything between them
        encoded = binaries(kept, np.cumsum(end - first)).dictionary_encode()
        order = pc.array_sort_indices(encoded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        return cls(rank[encoded.indices.to_numpy()], start, encoded.dictionary.take(order))

    def row(self) -> list[bytes]:
        ended = b"\n".join(self.vocabulary.to_pylist()) + b"\n" if len(self.vocabulary) else b""
        return [packed(self.ids.astype("<u4")), packed(self.start.astype("<u4")), packed(ended)]

    @classmethod
    def from_row(cls, ids: bytes, start: bytes, vocabulary: bytes) -> Block:
        flat = unpacked(vocabulary)
        line = flat == 10
        return cls(unpacked(ids, "<u4"), unpacked(start, "<u4").astype(np.int64), binaries(flat[~line], np.flatnonzero(line) - np.arange(int(line.sum()))))

    def features(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs of n words: each document's number of them (as ends), which distinct one each of them is, and of the distinct
        ones, in the order of their words, a place where it stands and their count."""
        ends = self.start[1:].repeat(np.diff(self.start))
        at = np.flatnonzero(np.arange(len(self.ids)) + n <= ends)
        v = max(len(self.vocabulary), 1)
        key, width = self.ids[at], v
        for j in range(1, n):
            if width > (1 << 61 - len(at).bit_length()) // v:  # ranks of what there is need fewer bits
                key = numbered(*(found := grouped(key, width)))
                width = max(int(found[1].sum()), 1)
            key, width = key * v + self.ids[at + j], width * v
        order, new = grouped(key, width)
        begin = np.flatnonzero(new)
        count = np.diff(begin, append=len(order))
        return np.cumsum(np.maximum(np.diff(self.start) - n + 1, 0)), numbered(order, new), at[order[begin]], count

    def parts(self, place: np.ndarray, n: int, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct features in the order of the dictionary's parts, and the parts; a part depends on the feature's words only."""
        offsets = np.frombuffer(self.vocabulary.buffers()[1], np.int64)[self.vocabulary.offset : self.vocabulary.offset + len(self.vocabulary) + 1]
        flat = np.frombuffer(self.vocabulary.buffers()[2], np.uint8)[: offsets[-1]] if len(self.vocabulary) else np.zeros(0, np.uint8)
        word = span_hash(prefix_hash(flat), offsets[:-1], offsets[1:])
        h = np.zeros(len(place), np.uint64)
        for j in range(n):
            h = mix(h + word[self.ids[place + j]] + GOLDEN)
        part = (h % np.uint64(n_parts)).astype(np.uint16 if n_parts <= 1 << 16 else np.int64)  # short numbers are sorted by their digits
        order = np.argsort(part, kind="stable")
        return order, part[order].astype(np.int64)

    def strings(self, place: np.ndarray, n: int) -> pa.Array:
        """Features as words joined by a space, with a line's end."""
        last = pc.binary_join_element_wise(self.vocabulary, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        columns = [(self.vocabulary if j < n - 1 else last).take(pa.array(self.ids[place + j])) for j in range(n)]
        return pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if n > 1 else columns[0]


def blocks(texts: DataFrame) -> DataFrame:
    """(block, target, doc_ids, n_words, ids, starts, vocabulary) from texts (doc_id, text, target)."""
    workers_find_package(texts.sparkSession)
    names = ["block", "target", "doc_ids", "n_words", "ids", "starts", "vocabulary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0

        def made(held: list[pa.RecordBatch], target: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n
            whole = pa.Table.from_batches(held).combine_chunks()
            for s, e, data, offsets in slices(whole["text"], chunk=BLOCK_BYTES):
                block = Block.of(data, offsets)
                row = [task << 32 | n, target, whole["doc_id"][s:e].to_pylist(), len(block.ids), *block.row()]
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3), strict=True)], names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for target in (False, True):
                own = batch.filter(pc.equal(batch.column(2), target))
                if own.num_rows == batch.num_rows and held and held[0].column(2)[0].as_py() == target:
                    held.append(own)
                elif own.num_rows:
                    if held:
                        yield from made(held, held[0].column(2)[0].as_py())
                    held = [own]
                if sum(b.nbytes for b in held) >= BLOCK_BYTES:
                    yield from made(held, target)
                    held = []
        if held:
            yield from made(held, held[0].column(2)[0].as_py())

    return texts.select(F.col("doc_id").cast("long"), "text", "target").mapInArrow(run, "block long, target boolean, doc_ids array<long>, n_words long, ids binary, starts binary, vocabulary binary")


def sent(held: DataFrame, n: int, n_parts: int, wanted: range) -> DataFrame:
    """(part, block, target, strings, counts): each block's distinct runs of n words, for each of the ``wanted`` parts of the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, target, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block.from_row(*raw)
                _, _, place, count = block.features(n)
                order, part = block.parts(place, n, n_parts)
                order, part = (x[np.searchsorted(part, wanted.start) : np.searchsorted(part, wanted.stop)] for x in (order, part))
                text, count = block.strings(place[order], n), count[order].astype("<u4")
                offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
                flat = np.frombuffer(text.buffers()[2], np.uint8) if len(text) else np.zeros(0, np.uint8)
                cut = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))[: len(part) + 1]
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([part[s]]), pa.array([number]), pa.array([target]), pa.array([packed(flat[offsets[s] : offsets[e]].tobytes())], pa.binary()), pa.array([packed(count[s:e])], pa.binary())], ["part", "block", "target", "strings", "counts"])

    return held.select("block", "target", "ids", "starts", "vocabulary").mapInArrow(run, "part long, block long, target boolean, strings binary, counts binary")


def answered(cells: DataFrame) -> DataFrame:
    """(block, part, slab, buckets) from ``sent``: answers to blocks of documents, and (block null) sums of the buckets' counts, slab 2 * i for documents and 2 * i + 1 for the target."""
    dealt = cells.repartition("part").sortWithinPartitions("part", "block")
    names = ["block", "part", "slab", "buckets"]

    def rows(block: list, part: list, slab: list, data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int64()), pa.array(slab, pa.int32()), pa.array(data, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        held: list[tuple] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            arrays = []
            for _, _, strings, _ in held:
                flat = unpacked(strings)
                arrays.append(binaries(flat, np.flatnonzero(flat == 10) + 1))
            encoded = pa.concat_arrays(arrays).dictionary_encode()
            known, which = encoded.dictionary, encoded.indices.to_numpy()
            offsets = np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1]
            bucket = (crc32(np.frombuffer(known.buffers()[2], np.uint8), offsets[:-1], offsets[1:] - 1) % np.uint32(BUCKETS)).astype("<u2")
            at = 0
            for (block, target, _, counts), strings in zip(held, arrays, strict=True):
                own = which[at : at + len(strings)]
                at += len(strings)
                np.add.at(sums[int(target)], bucket[own], unpacked(counts, "<u4").astype(np.int64))
                if not target:
                    yield rows([block], [last], [None], [packed(bucket[own])])
            held.clear()

        for batch in batches:
            for part, *cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and part != last:
                    yield from done()
                last = part
                held.append(tuple(cell))
        if held:
            yield from done()
        for s in range(0, BUCKETS, SLAB):
            yield rows([None] * 2, [None] * 2, [2 * (s // SLAB), 2 * (s // SLAB) + 1], [sums[0, s : s + SLAB].tobytes(), sums[1, s : s + SLAB].tobytes()])

    return dealt.mapInArrow(run, "block long, part long, slab int, buckets binary")


def gains(counts: list[tuple[int, int]]) -> np.ndarray:
    """Each bucket's gain from its counts (in documents, in the target)."""
    everything, target = (sum(c[k] for c in counts) for k in (0, 1))
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(everything + BUCKETS)) / (float(s + 1) * float(target + BUCKETS)))) for s, t in counts], np.int64)


def weighed(held: DataFrame, answers: DataFrame, gain: np.ndarray, n_parts: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document, from blocks and the dictionary's answers (n, block, part, buckets)."""
    no = lambda kind: F.lit(None).cast(kind)
    own = held.where("not target").select("block", F.lit(0).alias("n"), F.lit(0).cast("long").alias("part"), "doc_ids", "ids", "starts", "vocabulary", no("binary").alias("buckets"))
    back = answers.select("block", "n", "part", no("array<long>").alias("doc_ids"), *[no("binary").alias(c) for c in ("ids", "starts", "vocabulary")], "buckets")
    dealt = own.unionByName(back).repartition("block").sortWithinPartitions("block", "n", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, heard = None, [], {}

        def done() -> pa.RecordBatch:
            size = np.diff(block.start)
            number, weight = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for n in range(1, LONGEST + 1):
                ends, which, place, _ = block.features(n)
                if not len(place):
                    continue
                order, _ = block.parts(place, n, n_parts)
                bucket = np.empty(len(place), np.int64)
                bucket[order] = np.concatenate([unpacked(x, "<u2") for x in heard[n]])
                total = np.concatenate(([0], np.cumsum(gain[bucket][which])))
                begin = np.concatenate(([0], ends[:-1]))
                number += ends - begin
                weight += total[ends] - total[begin]
            heard.clear()
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(size), pa.array(number), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

        for batch in batches:
            for _, n, _, ids_of, ids, starts, vocabulary, buckets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n:
                    heard.setdefault(n, []).append(buckets)
                    continue
                if block is not None:
                    yield done()
                block, docs = Block.from_row(ids, starts, vocabulary), ids_of
        if block is not None:
            yield done()

    return dealt.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def feature_weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of ``docs`` (doc_id, text) against the texts of ``target``."""
    texts = docs.select("doc_id", "text", F.lit(False).alias("target")).unionByName(target.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("target")))
    held = stored(blocks(texts))
    n_parts = max(1, -(-(held.agg(F.sum("n_words")).first()[0] or 0) // PART_WORDS))
    answers: list[DataFrame] = []
    for n in range(1, LONGEST + 1):
        ends = [n_parts * k // SENDINGS[n] for k in range(SENDINGS[n] + 1)]
        for low, high in zip(ends, ends[1:], strict=False):
            answers.append(stored(answered(sent(held, n, n_parts, range(low, high)))).withColumn("n", F.lit(n)))
    every = reduce(DataFrame.unionByName, answers)
    slabs = arrays_added(every.where("block is null").select("slab", F.col("buckets").alias("sums")), ["slab"], "<i8").collect()
    by_slab = {slab: np.frombuffer(raw, "<i8").tolist() for slab, raw in slabs}
    zero = [0] * SLAB
    counts = [pair for i in range(BUCKETS // SLAB) for pair in zip(by_slab.get(2 * i, zero), by_slab.get(2 * i + 1, zero), strict=True)]
    return weighed(held, every.where("block is not null"), gains(counts), n_parts)


def drawn(weights: DataFrame, seed: int = SEED, share: tuple[int, int] = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """``weights`` with score and rank; ranks go to the given share, with the highest scores, of the rows of at least ``least`` words."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = stored(weights.withColumn("score", F.col("weight") + noise))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = stored(scored.where(F.col("n_words") >= least).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("at", 33).alias("task")).count().orderBy("task").collect()
    before = [0]
    for r in sizes:
        before.append(before[-1] + r["count"])
    wanted = share[0] * before[-1] // share[1]
    starts = placed.sparkSession.createDataFrame([(int(r["task"]), b) for r, b in zip(sizes, before, strict=False)], "task long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("task", F.shiftright("at", 33)).join(F.broadcast(starts), "task").withColumn("rank", F.when(rank <= wanted, rank)).drop("task", "before", "at")
    return ranked.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = feature_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn(weights).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is linear: the exclusive or of what each byte adds at its distance from the end and of what the start adds at that length.
SQL = r"""
with recursive bits(b, k, c) as (select b::bigint, 0, b::bigint from range(256) r(b) union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
base as materialized (select b, c from bits where k = 8),
texts as (select doc_id, false as target, text from documents union all select null, true, text from benchmark),
spoken as (select row_number() over () as row, doc_id, target, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from texts),
features as materialized (
  select row, target, array_to_string(w[i:i + n - 1], ' ') as f, count(*) as c
  from (select row, target, w, unnest(range(1, len(w) + 1)) as i from spoken), (values (1), (2), (3)) v(n) where i + n - 1 <= len(w) group by all),
dictionary as materialized (select f, hex(encode(f)) as x, strlen(f) as size, sum(case when target then 0 else c end) as s, sum(case when target then c else 0 end) as t from features group by f),
far(b, k, c) as (select b, 0, c from base union all select f.b, k + 1, xor(f.c >> 8, p.c) from far f join base p on p.b = f.c & 255 where k < (select max(size) from dictionary)),
start(k, c) as (select 0, 4294967295::bigint union all select k + 1, xor(s.c >> 8, p.c) from start s join base p on p.b = s.c & 255 where k < (select max(size) from dictionary)),
bytes as (select f, size, unnest(range(size)) as i, x from dictionary),
hashed as (select y.f, xor(bit_xor(a.c), any_value(s.c)) as reg from bytes y join far a on a.k = y.size - 1 - y.i and a.b = ('0x' || x[2 * i + 1:2 * i + 2])::bigint join start s on s.k = y.size group by y.f),
buckets as materialized (select d.f, xor(h.reg, 4294967295) % 10000 as bucket, s, t from dictionary d join hashed h using (f)),
counts as (select bucket, sum(s) as s, sum(t) as t from buckets group by bucket),
totals as (select sum(s) as s, sum(t) as t from counts),
gains as (select bucket, floor(1000 * ln(((c.t + 1)::double * (a.s + 10000)::double) / ((c.s + 1)::double * (a.t + 10000)::double)))::bigint as gain from counts c, totals a),
weights as (select row, sum(f.c)::bigint as n_features, sum(f.c * g.gain)::bigint as weight from features f join buckets b using (f) join gains g using (bucket) where not target group by row),
scored as (
  select p.doc_id, len(p.w) as n, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
  from spoken p left join weights using (row) where not target),
placed as (select *, row_number() over (order by score desc, doc_id nulls last) as place from scored where n >= 20)
select doc_id, n_features, weight, score, case when place <= 5 * (select count(*) from placed) // 100 then place end as rank from placed
union all select doc_id, n_features, weight, score, null from scored where n < 20
"""
