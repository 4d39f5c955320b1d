"""The prefix trie of conversations, summed over subtrees by heavy paths.

Method. A conversation is the sequence of its turns, a node is a distinct sequence of first turns, named by 128 bits of a
chain of SHA-256 over its turns. Every conversation gives one narrow row for each node it passes; rows are added up to
nodes. Each node chooses the child with most members (ties: the one with the smallest conversation); edges to chosen children join
nodes to heavy paths. As a child that is not chosen has at most half of its parent's members, any node is reached from the root over
at most log2(conversations) other, light edges: its path's level. Where paths begin is read off along the
turns of one conversation, a node's smallest member, without pointer chasing.
Sums over subtrees are suffix sums along each path. Rounds go from the deepest level up: a round sums the paths of its level,
after the totals of the light paths of the level below have been added up for the nodes they hang on.

Every step is a join, an aggregate or a running sum with map-side combination or spilling, and each
round's result is a table in the shared folder. Turns travel as hashes, never as texts.
Two things are sequential by their nature and stream through one task each with constant memory: the chain along one
conversation (about 50 bytes a turn), and one digest of member ids (24 bytes a member).

Edge cases: turns are ordered by turn (null first), then role, then the turn's hash; null roles and texts are empty strings; repeated rows
are turns of their own. Rows without a conv_id belong to no conversation and are left out. A remainder has the sign of its dividend, as in SQL. A conversation
without turns, after rebuilding, ends at the root. An empty table has no root and gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import release, stored, table, text_or_empty, workers_find_package

WORD = r"[^\x20\x09-\x0D]+"
FAMILY, MOST_SHARED = 20, 4  # conversations of one family share fewer than MOST_SHARED first turns
EMPTY = hashlib.sha256(b"").hexdigest()
KEY, PARENT, NODE = ["hi", "lo"], ["up_hi", "up_lo"], ["conv_id", "depth"]


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, hash, words) for each turn: its place from 1, SHA-256 of role and text, and the number of words."""
    role, text = text_or_empty("role"), text_or_empty("text")
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), said.alias("hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "hash")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "hash", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, source, pos, hash, words) of conversations that begin as their family's first conversation does, in the order of
    source and pos. Each has a row of source -1 for its beginning, so that none is lost."""
    number = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    convs = turns.select("conv_id").distinct().withColumn("h", number)
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    begun = convs.where("h > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "base").where("pos <= h")
    own = turns.where(F.col("pos") > number)
    columns = ["conv_id", "source", "pos", "hash", "words"]
    start = convs.select("conv_id", F.lit(-1).alias("source"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("hash"), F.lit(0).cast("long").alias("words"))
    return start.unionByName(begun.withColumn("source", F.lit(0)).select(*columns)).unionByName(own.withColumn("source", F.lit(1)).select(*columns))


def passed_nodes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, hi, lo, up_hi, up_lo, words, ends) for each node that a conversation passes, from ``rebuilt`` rows."""
    workers_find_package(turns.sparkSession)
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "source", "pos")
    names = ["conv_id", "depth", *KEY, *PARENT, "words", "ends"]
    kinds = [*[pa.int64()] * 7, pa.bool_()]

    def halves(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:16], "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, until it is known whether its conversation goes on
        chain, key, depth = b"", (0, 0), 0
        for batch in batches:
            out = []
            for conv, source, said, words in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                if held is not None:
                    out.append((*held, source < 0))
                if source < 0:
                    chain, up, depth = hashlib.sha256(b"root").digest(), (0, 0), 0
                else:
                    chain, up, depth = hashlib.sha256(chain + said).digest(), key, depth + 1
                key = halves(chain)
                held = (conv, depth, *key, *up, words)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, True), kinds, strict=True)], names)

    return dealt.mapInArrow(run, "conv_id long, depth long, hi long, lo long, up_hi long, up_lo long, words long, ends boolean")


def end_digests(paths: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the conversations that end at a node."""
    dealt = paths.where("ends").select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            out = []
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if key == last:
                    digest.update(b",%d" % conv)
                else:
                    if last is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256(b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], [*KEY, "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, digest.hexdigest())], [*KEY, "ends_sha256"])

    return dealt.mapInArrow(run, "hi long, lo long, ends_sha256 string")


def heavy_paths(paths: DataFrame) -> DataFrame:
    """A row for each node: (conv_id, depth, hi, lo, n_convs, n_children, parent_conv_id, head_conv_id, head_depth, head_parent, level, tokens).

    A node is named by its smallest member and its depth. ``head`` is the first node of its path and ``head_parent`` the node above that one."""
    nodes = stored(paths.groupBy(*KEY).agg(F.min("conv_id").alias("member"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *[F.max(c).alias(c) for c in PARENT], F.max("depth").alias("at")))
    chosen = F.max(F.struct("n_convs", (-F.col("member")).alias("first")))
    kids = nodes.where("at > 0").groupBy(*PARENT).agg(F.count("*").alias("n_children"), chosen.alias("heavy")).select(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"), "n_children", (-F.col("heavy.first")).alias("heavy"))
    known = nodes.select(*KEY, "member", "n_convs", "words").join(kids, KEY, "left")
    walked = paths.join(nodes.select(F.col("member").alias("conv_id")).distinct(), "conv_id", "left_semi").select("conv_id", "depth", *KEY).join(known, KEY)
    along = Window.partitionBy("conv_id").orderBy("depth")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)

    def at_head(c: str | Column) -> Column:
        return F.last(F.when(F.col("light"), c), ignorenulls=True).over(so_far)

    steps = walked.withColumn("parent_conv_id", F.lag("member").over(along)).withColumn("light", ~F.coalesce(F.lag("heavy").over(along) == F.col("member"), F.lit(False)))
    heads = steps.select(
        "conv_id", "depth", *KEY, "member", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "parent_conv_id",
        at_head(F.col("member")).alias("head_conv_id"), at_head(F.col("depth")).alias("head_depth"), at_head(F.col("parent_conv_id")).alias("head_parent"),
        (F.sum(F.col("light").cast("long")).over(so_far) - 1).alias("level"), ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"),
    )
    tree = stored(heads.where("conv_id = member").drop("member"))
    release(nodes)
    return tree


def subtree_sums(tree: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of every node of ``heavy_paths``; one round for each level of paths."""
    deepest = tree.agg(F.max("level")).first()[0]
    along = Window.partitionBy("head_conv_id", "head_depth").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rounds: list[DataFrame] = []
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = tree.where(F.col("level") == level).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
        if rounds:  # what the light paths below bring to the nodes they hang on
            light = rounds[-1].where("depth = head_depth").groupBy(F.col("head_parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
            here = here.join(light, NODE, "left").withColumn("leaf", F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).withColumn("tokens", F.col("tokens") + F.coalesce("more_tokens", F.lit(0)))
        rounds.append(stored(here.select(*NODE, "head_depth", "head_parent", F.sum("leaf").over(along).alias("n_leaves"), F.sum("tokens").over(along).alias("saved_tokens"))))
    if not rounds:
        return tree.select(*NODE, F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.select(*NODE, "n_leaves", "saved_tokens")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie of conversations given as (conv_id, source, pos, hash, words), see ``rebuilt``."""
    paths = stored(passed_nodes(turns))
    tree = heavy_paths(paths)
    out = tree.join(subtree_sums(tree), NODE).join(end_digests(paths), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(hashed_turns(table(spark, sf_dir, "conversations"))))


#: CRC-32 of the decimal id, bit by bit; nodes are lists of turns.
SQL = r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as said
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 20 as base, (~ list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: list_prepend(ascii(c)::bigint, [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))),
    lambda s, x: case when x >= 0 then xor(s, x) when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end)) & 3 as h
  from (select distinct conv_id from turns)),
spoken as (
  select c.conv_id, 0 as source, t.pos, t.said from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
  union all select c.conv_id, 1, t.pos, t.said from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h),
whole as (select c.conv_id, coalesce(list(s.said order by s.source, s.pos) filter (where s.said is not null), []) as said from convs c left join spoken s using (conv_id) group by c.conv_id),
paths as (select conv_id, d as depth, said[:d] as node, said[:d - 1] as above, d = len(said) as ends from whole, unnest(range(len(said) + 1)) as r(d)),
nodes as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(above) as above,
    (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(node[-1].text), '[^\x20\x09-\x0D]+')), 0) as tokens,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from paths group by node, depth),
kids as (select above, count(*) as n from nodes where depth > 0 group by above),
sums as (
  select p.node, p.depth, sum((k.n is null)::bigint) as n_leaves, sum(x.tokens) as saved
  from nodes x join paths q on q.conv_id = x.conv_id and q.depth <= x.depth join nodes p on p.node = q.node and p.depth = q.depth left join kids k on k.above = x.node group by p.node, p.depth)
select n.conv_id, n.depth::bigint as depth, a.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, n.ends_sha256
from nodes n left join nodes a on n.depth > 0 and a.node = n.above and a.depth = n.depth - 1 left join kids k on k.above = n.node join sums s on s.node = n.node and s.depth = n.depth
"""
