"""Embedding near-duplicates: all cosines of at least a limit, found tile by tile along principal axes.

Method. Vectors are scaled to length 1 and turned to the principal axes of the whole table (axes of largest second moment about the origin first). Rows of
one label and one number of components are sorted by their first principal component and packed into blocks; two blocks make a tile. Products of a tile are
accumulated over leading axes first; what the remaining axes can add is bounded by the product of the suffix norms of both vectors (Cauchy-Schwarz), and a pair stops as soon as its
cosine cannot reach the limit. Pairs that reach the end are decided by the cosine of the given components in double precision. The same bound drops tiles whole: a block knows the range of
its leading components and its largest suffix norm.

Equal vectors of a label are one node that weighs as many rows as it has. A tile returns how many links each node has in it and links that span the tile's components,
never a row for each pair, so results grow with the vectors, not with the pairs. Work is quadratic in the vectors of a label, as nothing but the bound
excludes a pair; it spreads over tiles, so one label may hold any share of the rows.
The axes are the one matrix (components by components, of the second moment of all vectors) that passes the driver.

Edge cases: vectors that are null, empty, zero or have null, NaN or infinite components, and rows without a label, link with nothing. Vectors of different
lengths do not link. Each row is a vector of its own, also where ids are repeated; a component is named by its smallest id (null if no member has one), and a row
without an id is kept if its component has no id either. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import arrays_added, release, stored, table, workers_find_package
from marlstone.llm.graph import components

COSINE = 0.93
BLOCK_BYTES = 2 << 20  # of the vectors of one block
BLOCK_BITS = 21  # a node is its block's number and its place there
LEADING = (8, 16, 32, 64)  # axes after which pairs are given up; then at every doubling
BOX = 8  # leading axes whose ranges a block knows
STRIP = 256  # rows of a tile that are multiplied at a time
SLACK = 1e-9  # far more than rounding can change a product of unit vectors
WORKER_BYTES = 2_000_000  # about, of the axes' partial sums that one row carries


def stops(d: int) -> list[int]:
    """Numbers of leading axes at which the bound is tested, up to all ``d``."""
    out = [x for x in LEADING if x < d]
    while out and out[-1] * 2 < d:
        out.append(out[-1] * 2)
    return [*out, d]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow of squares."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, d, key, vector): key (a hash of the components) and vector (doubles) are null where nothing may be linked."""
    workers_find_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(2)
            size = np.diff(given.offsets.to_numpy())
            values = given.values.slice(given.offsets[0].as_py(), int(size.sum())) if len(given) else given.values
            flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # null is NaN, -0.0 is 0.0
            at = np.concatenate(([0], np.cumsum(size)))
            live = ~np.asarray(given.is_null()) & ~np.asarray(batch.column(1).is_null()) & (size > 0)
            keys, vectors = [], []
            for i, ok in enumerate(live.tolist()):
                x = flat[at[i] : at[i + 1]]
                ok = ok and bool(np.isfinite(x).all() and x.any())
                vectors.append(x.astype("<f8").tobytes() if ok else None)
                keys.append(hashlib.sha256(vectors[-1]).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "label", "d", "key", "vector"])

    taken = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return taken.mapInArrow(run, "vec_id long, label long, d int, key binary, vector binary")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, d)


def principal_axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each number of components the axes, as columns, by falling second moment of all unit vectors. Tasks add up whole matrices;
    their rows are added up by row number, so the driver gets one matrix."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column(0).to_numpy()
            for d in np.unique(of).tolist():
                x = unit(matrix(batch.column(1).filter(pa.array(of == d)), d))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            step = max(1, WORKER_BYTES // (8 * d))
            for s in range(0, d, step):
                part = np.ascontiguousarray(m[s : s + step])
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(part), pa.int32()), pa.array(range(s, s + len(part)), pa.int32()), pa.array([r.tobytes() for r in part], pa.binary())], ["d", "i", "sums"])

    kind = "d int, i int, sums binary"
    found: dict[int, dict[int, np.ndarray]] = {}
    for d, i, raw in arrays_added(nodes.select("d", "vector").mapInArrow(moments, kind), ["d", "i"], "<f8").collect():
        found.setdefault(d, {})[i] = np.frombuffer(raw)
    return {d: np.linalg.eigh(np.stack([m[i] for i in range(d)]))[1][:, ::-1] for d, m in found.items()}


def suffix_norms(x: np.ndarray, at: list[int]) -> np.ndarray:
    """Of each row, the lengths of what follows the first ``at`` components."""
    rest = np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])
    return np.stack([rest[:, s] if s < x.shape[1] else np.zeros(len(x)) for s in at], axis=1)


def blocks(nodes: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(block, label, d, n, low, high, rest, weights, vectors): rows of one label in the order of their first principal component. The node
    at place i of a block is block * 2**BLOCK_BITS + i; ``keys`` and ``least`` (smallest vec_id) tell which one it is."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = batch.column(1).to_numpy(), np.zeros(batch.num_rows)
            for d in np.unique(of).tolist():
                out[of == d] = unit(matrix(batch.column(5).filter(pa.array(of == d)), d)) @ axes[d][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "first"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, n = [], None, 0

        def done() -> pa.RecordBatch:
            nonlocal n
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x = matrix(t["vector"], key[1])
            turned = unit(x) @ axes[key[1]]
            lead = turned[:, :BOX]
            row = [t["pid"][0].as_py() << 20 | n, *key, len(x), lead.min(axis=0).tolist(), lead.max(axis=0).tolist(), float(suffix_norms(turned, [min(BOX, key[1])]).max()), t["weight"].to_pylist(), x.tobytes(), t["key"].to_pylist(), t["least"].to_pylist()]
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            label, of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((label[1:] != label[:-1]) | (of[1:] != of[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                while s < e:
                    now = (int(label[s]), int(of[s]))
                    most = min(1 << BLOCK_BITS, max(1, BLOCK_BYTES // (8 * now[1])))
                    size = sum(b.num_rows for b in held)
                    if held and (now != key or size >= most):
                        yield done()
                        size = 0
                    key = now
                    part = batch.slice(s, min(e - s, most - size))
                    held.append(part)
                    s += part.num_rows
        if held:
            yield done()

    names = ["block", "label", "d", "n", "low", "high", "rest", "weights", "vectors", "keys", "least"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    columns = ["label", "d", "key", "least", "weight", "vector"]
    ordered = nodes.select(*columns).mapInArrow(first, "label long, d int, key binary, least long, weight long, vector binary, first double")
    dealt = ordered.repartitionByRange("label", "d", "first", "key").sortWithinPartitions("label", "d", "first", "key").withColumn("pid", F.spark_partition_id().cast("long"))
    return dealt.mapInArrow(packed, "block long, label long, d int, n int, low array<double>, high array<double>, rest double, weights array<long>, vectors binary, keys array<binary>, least array<long>")


def tile_links(x: np.ndarray, y: np.ndarray, axes: np.ndarray, limit: float, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places in y) of all rows of y whose cosine with row i of x is at least ``limit``; of two places in one block only the later one."""
    d = x.shape[1]
    at = stops(d)
    ux, uy = unit(x), unit(y)
    tx, ty = ux @ axes, uy @ axes
    rx, ry = suffix_norms(tx, at), suffix_norms(ty, at)
    for s in range(0, len(x), STRIP):
        own = slice(s, s + STRIP)
        product = tx[own, : at[0]] @ ty[:, : at[0]].T
        alive = product + rx[own, :1] * ry[None, :, 0] >= limit - SLACK
        if same:
            alive &= np.arange(s, s + len(product))[:, None] < np.arange(len(y))[None, :]
        i, j = np.nonzero(alive)
        sums = product[i, j]
        for k in range(1, len(at)):
            if not len(i):
                break
            lead = slice(at[k - 1], at[k])
            if len(i) * 8 > alive.size:  # most are left: whole products are cheaper than picked ones
                sums = sums + (tx[own, lead] @ ty[:, lead].T)[i, j]
            else:
                sums = sums + np.concatenate([np.einsum("ij,ij->i", tx[s + i[c : c + 65536], lead], ty[j[c : c + 65536], lead]) for c in range(0, len(i), 65536)])
            left = sums + rx[s + i, k] * ry[j, k] >= limit - SLACK
            i, j, sums = i[left], j[left], sums[left]
        sure = sums > limit + SLACK
        for p in np.flatnonzero(~sure).tolist():  # at the limit itself the given components decide
            a, b = x[s + i[p]], y[j[p]]
            sure[p] = float(a @ b) / (float(np.sqrt(a @ a)) * float(np.sqrt(b @ b))) >= limit
        i, j = i[sure], j[sure]
        for r in np.unique(i).tolist():
            yield s + r, j[i == r] if len(i) < 4096 else j[np.searchsorted(i, r) : np.searchsorted(i, r, "right")]


def compared(packs: DataFrame, axes: dict[int, np.ndarray], limit: float) -> DataFrame:
    """(node, links, joined): in each tile, how many rows each node links to, and a node of its component there (null for the component's first)."""
    boxes = packs.select("block", "label", "d", "low", "high", "rest")
    other = boxes.select(F.col("block").alias("y"), "label", "d", F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.col("rest").alias("rest_y"))
    corner = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low_y", "high_y"), lambda a, b: F.greatest(a["low"] * b["low_y"], a["low"] * b["high_y"], a["high"] * b["low_y"], a["high"] * b["high_y"]))
    most = F.aggregate(corner, F.col("rest") * F.col("rest_y"), lambda s, v: s + v)
    tiles = boxes.withColumnRenamed("block", "x").join(other, ["label", "d"]).where(F.col("x") <= F.col("y")).where(most >= limit - SLACK).select("x", "y", "d")
    sides = tiles.select("x", "y", "d", F.explode(F.when(F.col("x") < F.col("y"), F.array("x", "y")).otherwise(F.array("x"))).alias("block"))
    dealt = sides.join(packs.select("block", "weights", "vectors"), "block").select("x", "y", "d", "block", "weights", "vectors").repartition("x", "y").sortWithinPartitions("x", "y", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            for a, b, d, block, weights, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (block, np.array(weights, np.int64), np.frombuffer(raw, "<f8").reshape(-1, d))
                if a != b and block == a:
                    left = now
                    continue
                yield from tile(left if a != b else now, now, d)

    def tile(x: tuple, y: tuple, d: int) -> Iterator[pa.RecordBatch]:
        same = x[0] == y[0]
        nx = 0 if same else len(x[1])  # places of x, then those of y; in one block they are the same
        links, part = np.zeros(nx + len(y[1]), np.int64), np.arange(nx + len(y[1]))
        weight = np.concatenate([x[1][:nx], y[1]])
        for i, js in tile_links(x[2], y[2], axes[d], limit, same):
            at = nx + js
            links[i] += weight[at].sum()
            links[at] += weight[i]
            roots = np.unique(part[np.append(at, i)])
            if len(roots) > 1:
                part[np.isin(part, roots)] = roots[0]
        found = np.flatnonzero(links)
        if len(found):
            node = np.concatenate([(x[0] << BLOCK_BITS) + np.arange(nx), (y[0] << BLOCK_BITS) + np.arange(len(y[1]))])
            yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(links[found]), pa.array(node[part[found]], mask=part[found] == found)], ["node", "links", "joined"])

    return dealt.mapInArrow(run, "node long, links long, joined long")


def near_vectors(rows: DataFrame, limit: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows`` (vec_id, label, embedding)."""
    vectors = stored(usable(rows))
    nodes = stored(vectors.where("key is not null").groupBy("label", "d", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector")))
    known = stored(vectors.select("vec_id", "label", "d", "key"))
    release(vectors)
    axes = principal_axes(nodes)
    packs = stored(blocks(nodes, axes))
    release(nodes)
    found = stored(compared(packs, axes, limit))
    named = packs.select("block", "label", "d", F.posexplode(F.arrays_zip("keys", "least", "weights")).alias("place", "of"))
    named = named.select(F.expr(f"shiftleft(block, {BLOCK_BITS}) + place").alias("node"), "label", "d", F.col("of.keys").alias("key"), F.col("of.least").alias("least"), F.col("of.weights").alias("weight"))
    parts = components(found.where("joined is not null").select(F.col("node").alias("a"), F.col("joined").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = stored(named.join(links, "node", "left").join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "d", "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    release(packs, found)
    linked = known.where("key is not null").join(named, ["label", "d", "key"]).select("vec_id", "n_links", "component_id")
    alone = known.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive usable as (
  select row_number() over (order by vec_id) as row, vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
links as (select a.row as a, b.row as b from usable a join usable b on a.label = b.label and a.row <> b.row and len(a.x) = len(b.x) where case when len(a.x) = len(b.x) then list_cosine_similarity(a.x, b.x) end >= 0.93),
reach(a, b) as (select row, row from usable union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select r.a as row, min(u.vec_id) as component_id from reach r join usable u on u.row = r.b group by r.a),
counted as (select a as row, count(*) as n from links group by a)
select u.vec_id, coalesce(c.n, 0) as n_links, l.component_id, u.vec_id is not distinct from l.component_id as kept from usable u join least l using (row) left join counted c using (row)
union all
select vec_id, 0, vec_id, true from embeddings where not (label is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0)
  or label is null or embedding is null
"""
