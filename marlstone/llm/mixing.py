"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Method. Every source is dealt by a keyed hash into at most BLOCKS blocks, which
a second keyed hash puts in a permuted order. A source that must give e times its
size contributes all blocks floor(e) times and, of one more pass, the leading
permuted blocks; the block where the target falls is cut by documents, again in
hashed order. The exact numbers of block draws are split among output shards by a
tree: at each node the draws that go to the left half are a multivariate-
hypergeometric sample of the node's quotas, so leaves add up to the quotas. Each
leaf takes a disjoint range of each source's permuted draws, and a shard's rows
are ordered by a keyed hash.

The driver holds a few numbers for each source (weights are given for each
source, so sources fit there by construction) and none for documents or blocks.
Windows range over the blocks of a source (BLOCKS at most) or the documents of
one block. All row work is DataFrame expressions.

Edge cases: null text has size 0; null is a source of its own, ordered last;
sources without words get nothing. Rows are told apart by id and text: rows without an id, and
different texts that share one, are each decided by themselves; where equal rows fall on both sides of a target, ``mix`` counts them one
by one and ``mixed_documents`` gives all of them the larger number of copies. An empty table gives an empty result. Columns of
any name pass through ``mixed_documents``; ``mix`` ignores them.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import joined, row_key, stored, table

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2.0
BLOCKS, SHARDS, SEED = 4096, 16, 20_001
SLICES = 4096  # into which a shard's hashed order is cut, so that tasks can share a shard
MOST_DRAWS = 10**9  # the sampler's limit
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Targets of (source, source_size, ...): proportional to weight, at most ``limit`` times the size.

    Resharing the excess until none is above its limit ends at one level L with
    target = min(limit * size, L * weight); sorted by limit * size / weight, L is
    the first level that leaves the remaining sources below their limits."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("most", limit * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    pool = share * F.sum("source_size").over(everything)
    rows = rows.withColumn("level", (pool - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.least("most", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).drop("most", "ratio", "level", "weight")


def drawn(quotas: np.ndarray, draws: int, generator: np.random.Generator) -> np.ndarray:
    """How many of ``draws`` draws without replacement are of each kind (a normal law stands in for counts beyond the sampler's limit)."""
    out, rest = np.zeros_like(quotas), int(quotas.sum())
    for i, good in enumerate(quotas.tolist()):
        bad = rest - good
        if rest < MOST_DRAWS:
            n = int(generator.hypergeometric(good, bad, draws)) if draws and good else 0
        else:
            share = good / rest
            n = round(generator.normal(draws * share, math.sqrt(draws * share * (1 - share) * (rest - draws) / (rest - 1))))
        out[i] = n = min(max(n, 0, draws - bad), good, draws)
        draws, rest = draws - n, bad
    return out


def split(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Quotas of each shard for each source; sums are exact."""
    out: list[list[int]] = []

    def node(q: np.ndarray, n: int, path: int) -> None:
        if n == 1:
            out.append(q.tolist())
            return
        left = n // 2
        own = drawn(q, int(q.sum()) * left // n, np.random.Generator(np.random.Philox(key=[seed, path])))
        node(own, left, 2 * path)
        node(q - own, n - left, 2 * path + 1)

    if quotas:
        node(np.array(quotas, np.int64), shards, 1)
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """(doc_id, row, size, source_size, target, taken, copies, shards array<int>) for every document; ``row`` is its key by id and text."""
    rows = stored(docs.select("doc_id", "source", row_key().alias("row"), n_words(F.col("text")).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = (
        targets(sizes, weights, share, limit)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("n_blocks", F.least(F.greatest(F.expr("n_docs div 16"), F.lit(1)), F.lit(blocks)).cast("long"))
        .withColumn("id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .drop("n_docs")
    )
    plan = stored(plan)
    keyed = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row"), F.col("n_blocks")))

    permuted = Window.partitionBy("id").orderBy(F.xxhash64(F.lit(seed + 1), "id", "block"), "block")
    by_block = keyed.groupBy("id", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    by_block = by_block.select(
        "id", "block",
        (F.row_number().over(permuted) - 1).alias("place"),
        (F.col("rest") - F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("room"),
        "words",
    ).withColumn("drawn", F.when(F.col("room") <= 0, "none").when(F.col("words") <= F.col("room"), "all").otherwise("part"))
    by_block = stored(by_block)

    per_source = by_block.groupBy("id").agg(F.count("*").alias("filled"), F.count_if(F.col("drawn") != "none").alias("extra"))
    quotas = [(r["id"], r["q"]) for r in plan.join(per_source, "id").select("id", (F.col("epochs") * F.col("filled") + F.col("extra")).alias("q")).orderBy("id").collect()]  # a row for each source
    leaves = np.cumsum(split([q for _, q in quotas], shards, seed), axis=0) if quotas else []
    ends = [{"id": i, "ends": [int(x[k]) for x in leaves]} for k, (i, _) in enumerate(quotas)]
    spark = docs.sparkSession
    by_source = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<id:int,ends:array<bigint>>>")).alias("x")).select("x.*")
    by_source = by_source.join(per_source.select("id", "filled"), "id")

    placed = keyed.join(by_block.select("id", "block", "place", "room", "drawn"), ["id", "block"])
    inner = Window.partitionBy("id", "block").orderBy(F.xxhash64(F.lit(seed + 2), "row"), "row").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.where("drawn = 'part'").withColumn("more", ((F.sum("size").over(inner) - F.col("size") / 2) <= F.col("room")).cast("long"))
    whole = placed.where("drawn <> 'part'").withColumn("more", (F.col("drawn") == "all").cast("long"))
    out = whole.unionByName(cut).withColumn("copies", F.col("epochs") + F.col("more"))
    out = out.join(by_source, "id")
    draws = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda c: c * F.col("filled") + F.col("place"))).otherwise(F.array().cast("array<bigint>"))
    return out.select(
        "doc_id", "row", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.col("copies").cast("int"),
        F.transform(draws, lambda d: F.size(F.filter(F.col("ends"), lambda e: e <= d))).alias("shards"),
    )


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: documents' rows, repeated or left out, dealt to shards and shuffled within each. A task holds
    slices of shards in their hashed order, as many as the session's partitions make of it."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key().alias("row"))
    mixed = mix(docs.select("doc_id", "source", "text"), shards=shards, seed=seed, **options).where("copies > 0")
    decided = stored(mixed.groupBy("row").agg(F.max(F.struct("copies", "shards"))["shards"].alias("shards")))
    copies = joined(whole, decided, "row", "inner", 4).select("doc", "row", F.posexplode("shards").alias("copy", "shard"))
    copies = copies.withColumn("place", F.xxhash64(F.lit(seed + 3), "shard", "row", "copy"))
    dealt = copies.repartition("shard", F.expr(f"(place div 2 + 4611686018427387904) div {(1 << 63) // SLICES}"))
    return dealt.sortWithinPartitions("shard", "place").select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("row")
