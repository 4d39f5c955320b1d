"""Retrieval (R1-R17): every operator answers all queries of a table at once.

Tables: vectors (doc_id, embedding), queries (query_id, text, embedding), ranked lists
(query_id, list_id, rank from 0, doc_id, score, text). Every rank has a total order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import bm25_tokens, stripped, text_key
from marlstone.session import kept

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
FUNNEL = {"fetch": 6, "fuse": 4, "rerank": 5}
GATE = {"max": 0.5, "mean": 0.3}
DIGITS = 6  # scores are compared after rounding, so that ranks do not hang on summation order
QUERY_BLOCK = 1024
PIECE_BYTES, BROADCAST_BYTES, HELD_BLOCKS = 1 << 20, 1 << 26, 64
BROADCAST_TERMS = 1_000_000
QUERIES = 256  # whose best scores are picked at a time
SCORES = 1 << 22  # of documents times queries that a task holds at a time
DENSE_TERMS, DENSE_SHARE = 512, 0.01  # words multiplied as dense matrices, and the least share of pairs of a document and a query that such a word has
ADDED = 1 << 17  # products of the other words added at a time
SLACK = 1e-6  # scores are rounded to DIGITS


def top(rows: DataFrame, k: int, by: list[Column], group: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 0 (planned as partial and final group limits)."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*by))
    return rows.withColumn("rank", place - 1).where(F.col("rank") < k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """R2 of one pair; null for a zero vector under cosine."""
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", by: str | None = None) -> DataFrame:
    """Exact nearest vectors of each query, (query_id, doc_id, score, rank).

    Queries are packed into blocks of about QUERY_BLOCK and vectors, in one scan, into pieces of PIECE_BYTES; each piece meets each block.
    Blocks are broadcast if all queries take up to BROADCAST_BYTES; else pieces and blocks are dealt by block and slice.
    A task passes on at most k rows for each query and piece of work, so nothing grows with vectors x queries, and only
    the queries' number and size reach the driver. With ``by``, an integer column of both, a query meets only
    vectors of its own value (a query may stand there with several)."""
    spark = vectors.sparkSession
    cell = F.col(by).cast("int") if by else F.lit(0)
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), cell.alias("cell"))
    sizes = asked.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("numbers"))
    most, numbers = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("numbers"), F.lit(0))).first()
    blocks = max(1, -(-most // QUERY_BLOCK))
    block = (F.col("cell") * blocks + F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).alias("block")
    packed = asked.groupBy(block).agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked"))
    pieces = vectors.select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<double>"), cell.alias("cell")).mapInArrow(_packed, "cell int, ids array<bigint>, numbers array<double>")
    dealt = pieces.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda n: F.col("cell") * blocks + n)))
    if 8 * numbers <= BROADCAST_BYTES:
        met = dealt.join(F.broadcast(packed), "block")
    else:
        slices = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
        dealt = dealt.withColumn("slice", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(slices)).cast("int"))
        met = dealt.join(packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), ["block", "slice"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # of each block: query ids, scores, vector ids

        def found() -> pa.RecordBatch:
            parts = [(np.repeat(q, np.isfinite(s).sum(axis=1)), d[np.isfinite(s)], s[np.isfinite(s)] + 0.0) for q, s, d in best.values()]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["query_id", "doc_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                number, ids = batch.column(0)[i].as_py(), batch.column(1)[i].values.to_numpy()
                v = batch.column(2)[i].values.to_numpy().reshape(len(ids), -1)
                rows = batch.column(3)[i].values
                names, q = rows.field("query_id").to_numpy(), rows.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                if number not in best and len(best) == HELD_BLOCKS:
                    yield found()
                names, was_s, was_d = best.get(number, (names, np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)))
                kept_s, kept_d = [], []
                for x in range(0, len(names), QUERIES):  # a piece's scores of so many queries are held and sorted at a time
                    some = slice(x, x + QUERIES)
                    s = np.concatenate((was_s[some], np.round(scores(q[some], v, metric), DIGITS)), axis=1)
                    d = np.concatenate((was_d[some], np.broadcast_to(ids, (len(s), len(ids)))), axis=1)
                    order = np.lexsort((d, -s), axis=1)[:, :k]
                    kept_s.append(np.take_along_axis(s, order, 1))
                    kept_d.append(np.take_along_axis(d, order, 1))
                best[number] = names, np.concatenate(kept_s), np.concatenate(kept_d)
        if best:
            yield found()

    out = met.select("block", "ids", "numbers", "asked").mapInArrow(nearest, "query_id long, doc_id long, score double")
    return top(out, k, [F.desc("score"), F.asc("doc_id")])


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """R2 of all pairs of rows; -inf where there is none."""
    s = q @ v.T
    if metric == "cosine":
        norm = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]
        return np.where(norm > 0, s / np.where(norm > 0, norm, 1), -np.inf)
    if metric == "euclidean":
        return -np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * s))
    return s


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of a batch and cell end to end, in pieces of about PIECE_BYTES; nulls are left out."""
    for whole in batches:
        whole = whole.filter(whole.column(1).is_valid())
        for cell in np.unique(whole.column(2).to_numpy()).tolist():
            batch = whole.filter(pa.array(whole.column(2).to_numpy() == cell))
            flat = batch.column(1).flatten()
            step = max(1, PIECE_BYTES * batch.num_rows // max(1, 8 * len(flat)))
            cut = np.append(np.arange(0, batch.num_rows, step), batch.num_rows)
            lists = [pa.ListArray.from_arrays(pa.array(cut * (len(x) // batch.num_rows), pa.int32()), x) for x in (batch.column(0), flat)]
            yield pa.RecordBatch.from_arrays([pa.array([cell] * len(lists[0]), pa.int32()), *lists], ["cell", "ids", "numbers"])


class Bm25:
    """Tokens, corpus statistics and term statistics as tables. Texts are split into words once: the tokens are written to the shared folder or,
    with ``folder``, there, from where later searches read them as well."""

    def __init__(self, docs: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON, folder: str | None = None) -> None:
        self.k1, self.b, self.epsilon = k1, b, epsilon
        tokens = docs.select("doc_id", bm25_tokens(F.col("text")).alias("ts"))
        if folder:
            tokens.write.mode("overwrite").parquet(f"{folder}/tokens")
        self.tokens = docs.sparkSession.read.parquet(f"{folder}/tokens") if folder else kept(tokens)
        self.stats = self.tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("ts")).alias("avgdl"))
        terms = self.tokens.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        if folder:
            terms.write.mode("overwrite").parquet(f"{folder}/terms")
        self.terms = docs.sparkSession.read.parquet(f"{folder}/terms") if folder else kept(terms)

    def idf(self) -> DataFrame:
        """(term, df, idf); a negative one becomes epsilon times the mean over all terms."""
        raw = self.terms.join(F.broadcast(self.stats), how="cross").withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
        mean = raw.agg(F.avg("raw").alias("mean"))
        return raw.join(F.broadcast(mean), how="cross").select("term", "df", F.when(F.col("raw") < 0, self.epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, doc_id, score, rank); scores above 0 only; a repeated query word counts again. Rows of one id are documents of their own.

        About BROADCAST_TERMS different words of queries are sent to all tasks with their weights. A task looks up its documents' tokens, scores
        them for all queries and passes on at most k rows a query, so nothing is shuffled but these. More queries are asked in rounds of that size, whose results are kept one after the other."""
        words = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        weights = kept(words.join(self.idf(), "term").select(F.col("query_id").cast("long"), "term", "df", (F.col("qtf") * F.col("idf")).alias("weight")))
        count, asked = weights.agg(F.count("*"), F.count_distinct("query_id")).first()
        rounds = max(1, min(asked, -(-count // max(1, BROADCAST_TERMS))))
        by = [F.desc("score"), F.asc("doc_id")]
        if rounds == 1:
            return top(self._by_lookup(weights, k), k, by)
        own = F.pmod(F.xxhash64("query_id"), F.lit(rounds))
        return reduce(DataFrame.unionByName, (kept(top(self._by_lookup(weights.where(own == n), k), k, by)) for n in range(rounds)))

    def _by_lookup(self, weights: DataFrame, k: int) -> DataFrame:
        """A slice of documents and all queries make one matrix of scores. Words that many documents and many queries have are multiplied as
        dense matrices; the postings of the others are added one by one. A score below the k-th so far of its query goes no further."""
        sent = weights.toArrow().sort_by([("term", "ascending"), ("query_id", "ascending")])
        terms, names = (pc.unique(sent[c]) for c in ("term", "query_id"))
        of_term, of_query = (pc.index_in(sent[c].combine_chunks(), value_set=v).to_numpy() for c, v in (("term", terms), ("query_id", names)))
        weight, begin, asked = sent["weight"].to_numpy(), np.searchsorted(of_term, np.arange(len(terms) + 1)), names.to_numpy()
        totals = self.stats.first()
        mean, k1, b = totals["avgdl"] or 1.0, self.k1, self.b
        step = max(1, SCORES // max(1, len(names)))
        met = sent["df"].to_numpy()[begin[:-1]].astype(float) * np.diff(begin)  # pairs of a document and a query that have the word
        often = np.argsort(-met, kind="stable")[:DENSE_TERMS]
        often = often[met[often] >= DENSE_SHARE * totals["n_docs"] * len(names)]
        column = np.full(len(terms) + 1, -1)
        column[often] = np.arange(len(often))

        def scored(doc: np.ndarray, term: np.ndarray, part: np.ndarray, n: int, wide: np.ndarray) -> np.ndarray:
            at = column[term]
            dense, rest = np.zeros((n, len(wide))), at < 0
            dense[doc[~rest], at[~rest]] = part[~rest]
            score = dense @ wide
            flat, doc, term, part = score.reshape(-1), doc[rest], term[rest], part[rest]
            count = begin[term + 1] - begin[term]
            ends = np.cumsum(count)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], ADDED)) if len(ends) else 0, len(ends)))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                c, first = count[x:y], begin[term[x:y]]
                place = np.repeat(first - (ends[x:y] - c - (ends[x] - count[x])), c) + np.arange(ends[y - 1] - ends[x] + count[x])
                np.add.at(flat, np.repeat(doc[x:y] * len(asked), c) + of_query[place], np.repeat(part[x:y], c) * weight[place])
            return score

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wide, at = np.zeros((len(often), len(asked))), column[of_term]
            wide[at[at >= 0], of_query[at >= 0]] = weight[at >= 0]
            floor = np.zeros(len(asked))
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            waiting = 0

            def settled() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                q, d, s = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((d, -s, q))
                q, d, s = q[order], d[order], s[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                floor[q[place == k - 1]] = s[place == k - 1]
                return [(q[place < k], d[place < k], s[place < k])]

            for batch in batches:
                lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
                starts = np.append(0, np.cumsum(lengths))
                for low in range(0, batch.num_rows if len(asked) else 0, step):
                    length = lengths[low : low + step]
                    own, ids = found[starts[low] : starts[low + len(length)]], batch.column(0).slice(low, step)
                    pair, tf = np.unique((np.repeat(np.arange(len(length)), length) * len(terms) + own)[own >= 0], return_counts=True)
                    doc, term = pair // len(terms), pair % len(terms)
                    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
                    score = scored(doc, term, part, len(length), wide)
                    good = score >= np.maximum(floor - SLACK, SLACK / 10)[None, :]
                    if np.count_nonzero(good) > 4 * k * len(asked) and len(score) > k:  # most do not last: none below the k-th of these documents does
                        for x in range(0, len(asked), QUERIES):
                            some = slice(x, x + QUERIES)
                            good[:, some] &= score[:, some] >= np.partition(score[:, some], len(score) - k, axis=0)[len(score) - k] - SLACK
                    r, c = np.nonzero(good)
                    s = np.round(score[r, c], DIGITS)
                    r, c, s = (x[(s > 0) & (s >= floor[c])] for x in (r, c, s))
                    held.append((c, ids.to_numpy(zero_copy_only=False)[r], s))
                    waiting += len(c)
                    if waiting >= k * len(asked):
                        held, waiting = settled(), 0
            ((q, d, s),) = settled()
            yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(d), pa.array(s)], ["query_id", "doc_id", "score"])

        return self.tokens.select(F.col("doc_id").cast("long"), "ts").mapInArrow(best, "query_id long, doc_id long, score double")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10, **options) -> DataFrame:
    return Bm25(docs, **options).search(queries, k)


def variants(queries: DataFrame, proposed: DataFrame, n: int = 3, include_original: bool = True) -> DataFrame:
    """(query_id, variant, text): the original first, then up to n proposals over five characters, without
    repeats by stripped lower case. ``proposed`` has (query_id, texts array<string>)."""
    rows = queries.select("query_id", F.col("text").alias("original")).join(proposed, "query_id", "left")
    kept = F.slice(F.filter(F.coalesce("texts", F.array().cast("array<string>")), lambda t: F.length(stripped(t)) > 5), 1, n)
    listed = F.concat(F.array("original"), kept) if include_original else F.when(F.size(kept) > 0, kept).otherwise(F.array("original"))
    rows = rows.select("query_id", F.posexplode(listed).alias("pos", "text"))
    first = F.row_number().over(Window.partitionBy("query_id", F.lower(stripped(F.col("text")))).orderBy("pos"))
    rows = rows.withColumn("_copy", first).where("_copy = 1")
    return rows.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1).alias("variant"), "text")


def rrf(lists: DataFrame, k: int = RRF_K, top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_id, rank, doc_id, text, score), (query_id, rank, doc_id, text, score).

    Ranks count from 0; texts with equal first 200 characters are one item and keep the first seen (by list, then
    rank); ties go to the first seen. A query with a single list keeps its items, repeats included."""
    if k <= 0:
        raise ValueError("k must be positive")
    rows = lists.withColumn("_key", text_key(F.col("text")))
    lone = F.min("list_id").over(Window.partitionBy("query_id")) == F.max("list_id").over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_key", F.when(lone, F.concat_ws(":", F.col("rank").cast("string"), "_key")).otherwise(F.col("_key")))
    fused = rows.groupBy("query_id", "_key").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_id", "rank", "doc_id", "text")).alias("first")
    )
    out = top(fused, top_k or 2**31 - 1, [F.desc("score"), F.col("first.list_id"), F.col("first.rank")])
    return out.select("query_id", "rank", "first.doc_id", "first.text", "score")


def hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Dense and sparse lists of each query, (query_id, list_id 0 dense or 1 sparse, rank, doc_id, score, text).
    Blank queries have none; queries are cut to 1,000 characters."""
    asked = queries.where(F.coalesce(stripped(F.col("text")), F.lit("")) != "").withColumn("text", F.substring("text", 1, 1000))
    dense = dense_topk(asked, vectors, k).withColumn("list_id", F.lit(0))
    sparse = bm25_topk(asked, docs, k).withColumn("list_id", F.lit(1))
    both = dense.unionByName(sparse)
    return both.join(docs.select("doc_id", "text"), "doc_id").select("query_id", "list_id", "rank", "doc_id", "score", "text")


def advanced(queries: DataFrame, docs: DataFrame, vectors: DataFrame, top_k: int = 5, rerank=None) -> DataFrame:
    """Variants (query_id, variant, text, embedding) -> lists of 6k -> fusion to 4k -> rerank -> k, for all queries in one plan.
    Lists are ordered all dense ones first, then all sparse ones."""
    key = F.col("query_id") * 1_000 + F.col("variant")  # fewer than a thousand variants
    asked = queries.withColumn("_id", key)
    lists = hybrid(asked.select(F.col("_id").alias("query_id"), "text", "embedding"), docs, vectors, FUNNEL["fetch"] * top_k)
    lists = lists.withColumn("list_id", F.col("list_id") * 1_000 + F.col("query_id") % 1_000).withColumn("query_id", F.expr("query_id div 1000"))
    fused = rrf(lists, top_k=FUNNEL["fuse"] * top_k)
    if rerank is None:
        return fused.where(F.col("rank") < top_k).withColumn("source", F.lit("no_rerank"))
    original = queries.where("variant = 0").select("query_id", F.col("text").alias("query"))
    return rerank(original, fused.where(F.col("rank") < FUNNEL["rerank"] * top_k), top_k)


def gate(ranked: DataFrame, most: float = GATE["max"], mean: float = GATE["mean"]) -> DataFrame:
    """(query_id, max_score, mean_score, abstain); meant for cosine or rerank scores."""
    stats = ranked.groupBy("query_id").agg(F.round(F.max("score"), DIGITS).alias("max_score"), F.round(F.avg("score"), DIGITS).alias("mean_score"))
    return stats.withColumn("abstain", (F.col("max_score") < most) | (F.col("mean_score") < mean))


def requests_in_window(events: DataFrame, seconds: int = 60, key: str = "user_id") -> DataFrame:
    """R13, analytically: requests of the same key within the last ``seconds``, this one included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    recent = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(recent))
