"""K5: an approximate index of layered proximity graphs, one for each shard of the vectors, stored as a table.

A shard holds about SHARD_BYTES of vectors. Its lowest layer links every vector to near ones that differ in direction; each further layer does
so for a share of the vectors (1 of LINKS of the layer below, by a hash of the id), so that a search descends from few vectors to all. Links come from exact
neighbours within the shard, computed in blocks. A search meets every shard with blocks of queries, keeps a beam of the ``beam`` nearest vectors seen
and expands them until none is left; the shards' best are merged. ``n_read`` tells how many vectors were compared.

The index is written once beside the collection; opening it reads nothing, and ``add`` appends shards for new vectors without touching the old ones.
Null and (under cosine) zero vectors are left out. Ids may repeat; all their vectors are indexed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.retrieval import BROADCAST_BYTES, DIGITS, top

LINKS, BEAM = 16, 20
SHARD_BYTES = 16 << 20
QUERY_BLOCK = 256
ROWS = 256  # of a shard whose neighbours are computed at a time
SHARD = "shard long, size int, ids binary, vectors binary, links binary, layers array<binary>"


def chosen(x: np.ndarray, own: np.ndarray, others: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates ``others`` (nearest first, with closeness ``near``) up to ``width``: those that are closer to the row than to any
    candidate chosen before, then the nearest of the rest; -1 where there are none."""
    v = x[others]
    norm = (v * v).sum(axis=2)
    between = -(norm[:, :, None] + norm[:, None, :] - 2 * np.einsum("rcd,red->rce", v, v))
    keep = np.zeros(others.shape, bool)
    for c in range(others.shape[1]):
        keep[:, c] = ~(keep & (between[:, c, :] > near[:, c, None])).any(axis=1) & (keep.sum(axis=1) < width)
    order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(others, order, 1)


def linked(x: np.ndarray, members: np.ndarray, width: int) -> np.ndarray:
    """(len(members), width) links of a layer, to places in ``x``; both directions, the nearest first, -1 at the end."""
    own, n = x[members], len(members)
    norm = (own * own).sum(axis=1)
    many = min(2 * width, n - 1)
    edges = []
    for s in range(0, n if many > 0 else 0, ROWS):
        close = 2 * own[s : s + ROWS] @ own.T - norm[None, :] - norm[s : s + ROWS, None]
        close[np.arange(len(close)), np.arange(s, s + len(close))] = -np.inf
        best = np.argpartition(-close, many - 1, axis=1)[:, :many]
        near = np.take_along_axis(close, best, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        best, near = np.take_along_axis(best, order, 1), np.take_along_axis(near, order, 1)
        to = chosen(own, own[s : s + ROWS], best, near, max(1, width // 2))
        edges.append(np.stack([np.repeat(np.arange(s, s + len(to)), to.shape[1]), to.reshape(-1)], axis=1))
    out = np.full((n, width), -1, np.int32)
    if edges:
        e = np.concatenate(edges)
        e = np.unique(np.concatenate((e, e[:, ::-1])), axis=0)
        d = own[e[:, 0]] - own[e[:, 1]]
        e = e[np.lexsort(((d * d).sum(axis=1), e[:, 0]))]
        first = np.searchsorted(e[:, 0], np.arange(n))
        place = np.arange(len(e)) - first[e[:, 0]]
        e, place = e[place < width], place[place < width]
        out[e[:, 0], place] = members[e[:, 1]]
    return out


def graph(x: np.ndarray, ids: np.ndarray, links: int = LINKS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Links of the lowest layer, and (members, links) of those above, from the second up."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD1B54A32D192ED03)
    level = np.floor(-np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / np.log(links)).astype(int)
    upper = []
    for at in range(1, int(level.max(initial=0)) + 1):
        members = np.flatnonzero(level >= at)
        upper.append((members, linked(x, members, links)))
    return linked(x, np.arange(len(x)), 2 * links), upper


def descend(x: np.ndarray, low: np.ndarray, upper: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the places of the nearest vectors seen, their closeness (minus the squared distance), and how many vectors were compared."""
    n, rows = len(x), np.arange(len(q))
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True  # where links end
    norm, norm_q = (x * x).sum(axis=1), (q * q).sum(axis=1)

    def closeness(r: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.where(places < n, 2 * np.einsum("rd,rwd->rw", q[r], x[np.minimum(places, n - 1)]) - norm[np.minimum(places, n - 1)] - norm_q[r, None], -np.inf)

    top_layer = upper[-1][0] if upper else np.zeros(1, np.int64)
    start = np.tile(top_layer[: max(1, beam)], (len(q), 1))
    near = closeness(rows, start)
    seen[rows[:, None], start] = True
    at, best = start[rows, near.argmax(axis=1)], near.max(axis=1)
    for members, links in reversed(upper):
        table = np.full(n, -1)
        table[members] = np.arange(len(members))
        live = rows
        while len(live):
            to = links[table[at[live]]]
            to = np.where(to < 0, n, to)
            close = closeness(live, to)
            seen[live[:, None], to] = True
            j = close.argmax(axis=1)
            better = close[np.arange(len(live)), j] > best[live]
            live, j = live[better], to[np.arange(len(live)), j][better]
            at[live], best[live] = j, close.max(axis=1)[better]
    low = np.where(low < 0, n, low)
    read = seen[:, :n].sum(axis=1)
    seen[:, :n] = False
    seen[rows, at] = True
    places, close, done = np.full((len(q), beam), n), np.full((len(q), beam), -np.inf), np.zeros((len(q), beam), bool)
    places[:, 0], close[:, 0] = at, best
    live = rows
    while len(live):
        open_ = ~done[live] & (places[live] < n)
        live, nearest = live[open_.any(axis=1)], open_.argmax(axis=1)[open_.any(axis=1)]
        if not len(live):
            break
        done[live, nearest] = True
        to = low[places[live, nearest]]
        to = np.where(seen[live[:, None], to], n, to)
        seen[live[:, None], to] = True
        p, c = np.concatenate((places[live], to), axis=1), np.concatenate((close[live], closeness(live, to)), axis=1)
        d = np.concatenate((done[live], np.zeros(to.shape, bool)), axis=1)
        order = np.argsort(-c, axis=1, kind="stable")[:, :beam]
        places[live], close[live], done[live] = (np.take_along_axis(v, order, 1) for v in (p, c, d))
    return places, close, read + seen[:, :n].sum(axis=1)


class ProximityIndex:
    """The index at ``path``; ``metric`` is cosine or euclidean."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine", links: int = LINKS) -> None:
        if metric not in ("cosine", "euclidean"):
            raise ValueError(f"no proximity graph for {metric}")
        self.spark, self.path, self.metric, self.links = spark, f"{path}/{metric}-{links}", metric, links

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def ids(self) -> DataFrame:
        """(doc_id) of what is indexed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.as_buffer(), "<i8"))], ["doc_id"])

        return self.spark.read.schema(SHARD).parquet(self.path).select("ids").mapInArrow(run, "doc_id long")

    def add(self, vectors: DataFrame) -> ProximityIndex:
        """Index ``vectors`` (doc_id, embedding) in shards of their own."""
        metric, links = self.metric, self.links
        given = vectors.where("embedding is not null").select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
        n, numbers = given.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
        shards = max(1, -(-4 * numbers // SHARD_BYTES))

        def built(key: tuple, rows: pa.Table) -> pa.Table:
            ids = rows["doc_id"].to_numpy()
            x = np.stack([np.asarray(v, np.float32) for v in rows["embedding"].to_pylist()]) if len(ids) else np.zeros((0, 1), np.float32)
            if metric == "cosine":
                norm = np.sqrt((x * x).sum(axis=1))
                ids, x = ids[norm > 0], x[norm > 0] / norm[norm > 0, None]
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], np.ascontiguousarray(x[order])
            low, upper = graph(x, ids, links)
            layers = [part for members, to in upper for part in (members.astype("<i4").tobytes(), to.astype("<i4").tobytes())]
            return pa.table({"shard": pa.array([key[0].as_py()]), "size": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([x.astype("<f4").tobytes()], pa.binary()), "links": pa.array([low.astype("<i4").tobytes()], pa.binary()), "layers": pa.array([layers], pa.list_(pa.binary()))})

        dealt = given.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long"))
        dealt.groupBy("shard").applyInArrow(built, SHARD).where("size > 0").write.mode("append").parquet(self.path)
        return self

    def search(self, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
        """(query_id, doc_id, score, rank, n_read): the nearest vectors found; n_read counts the vectors compared for the query in all shards."""
        metric, links, width = self.metric, self.links, max(beam, k)
        asked = queries.where("embedding is not null").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
        n, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
        blocks = max(1, -(-n // QUERY_BLOCK))
        packed = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked"))
        shards = self.spark.read.schema(SHARD).parquet(self.path)
        if 8 * numbers <= BROADCAST_BYTES:
            packed = F.broadcast(packed)
        met = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block").select("size", "ids", "vectors", "links", "layers", "asked")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    size, *blobs = (batch.column(c)[i] for c in range(4))
                    size = size.as_py()
                    ids, x, low = (np.frombuffer(b.as_buffer(), t) for b, t in zip(blobs, ("<i8", "<f4", "<i4"), strict=True))
                    x, low = x.reshape(size, -1), low.reshape(size, 2 * links)
                    flat = [np.frombuffer(b.as_buffer(), "<i4") for b in batch.column(4)[i].values]
                    upper = [(m, to.reshape(len(m), links)) for m, to in zip(flat[::2], flat[1::2], strict=True)]
                    rows = batch.column(5)[i].values
                    names, q = rows.field("query_id").to_numpy(), np.stack([np.asarray(v, np.float32) for v in rows.field("embedding").to_pylist()])
                    if metric == "cosine":
                        norm = np.sqrt((q * q).sum(axis=1))
                        names, q = names[norm > 0], q[norm > 0] / norm[norm > 0, None]
                    places, _, read = descend(x, low, upper, q, width)
                    own, at = np.nonzero(places[:, :k] < size)
                    hit = places[own, at]
                    a, b = q[own].astype(float), x[hit].astype(float)
                    score = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)) if metric == "cosine" else -np.sqrt(((a - b) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(ids[hit]), pa.array(np.round(score, DIGITS) + 0.0), pa.array(np.where(at == 0, read[own], 0))], ["query_id", "doc_id", "score", "n_read"])

        found = met.mapInArrow(run, "query_id long, doc_id long, score double, n_read long")
        work = found.groupBy("query_id").agg(F.sum("n_read").alias("n_read"))
        return top(found.drop("n_read"), k, [F.desc("score"), F.asc("doc_id")]).join(work, "query_id")
