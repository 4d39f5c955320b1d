"""Near vectors, the prefix trie and importance resampling against plain versions and SQL, and their edge cases."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import importance, prefix_trie, vectors

DATA = "/root/testdata/sf0.001"
none_first = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("query,sql", [(vectors.op11_near_vectors, vectors.SQL), (prefix_trie.op12_prefix_trie, prefix_trie.SQL), (importance.op13_importance_resampling, importance.SQL)])
def test_queries_match_sql(spark, query, sql):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        duck.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = query(spark, DATA), duck.sql(sql)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=none_first) == sorted(want.fetchall(), key=none_first)


# --- 11 ---

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_near(rows, limit=0.93):
    def usable(r):
        return r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])

    def cosine(a, b):
        a, b = (np.array(x, np.float32).astype(float) for x in (a, b))
        return float(a @ b) / (float(np.sqrt(a @ a)) * float(np.sqrt(b @ b)))

    n = len(rows)
    near = [[j for j in range(n) if j != i and usable(rows[i]) and usable(rows[j]) and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= limit] for i in range(n)]
    out, part = [], list(range(n))
    for _ in range(n):
        part = [min([part[i], *(part[j] for j in near[i])]) for i in range(n)]
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if part[j] == part[i] and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((r[0], len(near[i]), component, r[0] == component))
    return sorted(out, key=none_first)


def clouds(seed, n=240, d=20, centres=12):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, d))
    rows = []
    for i in range(n):
        x = middle[i % centres] + r.normal(size=d) * r.choice([0.02, 0.3, 0.45])
        rows.append((i, [float(v) for v in np.float32(x * r.choice([1e-30, 1, 1e6]))], int(i % centres % 3)))
    rows += [(300 + k, rows[0][1], rows[0][2]) for k in range(5)]  # equal vectors
    rows += [(310, rows[0][1], None), (311, None, 1), (312, [], 1), (313, [0.0] * d, 1), (314, [float("nan")] * d, 1), (315, [1.0, None, *[0.0] * (d - 2)], 1), (316, [float("inf"), *[0.0] * (d - 1)], 1)]
    rows += [(317, [1.0, 2.0], 1), (318, [2.0, 4.0], 1), (319, [-0.0, 1.0], 2), (320, [0.0, 1.0], 2), (5, rows[7][1], rows[7][2]), (None, rows[9][1], rows[9][2]), (None, [9.0, -9.0], 2), (321, [3.0], 0), (322, [-3.0], 0)]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 1500])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
    rows = clouds(1)
    df = spark.createDataFrame(rows, VECTORS).withColumn("links", F.lit(1)).withColumn("key", F.lit("x")).withColumn("d", F.lit(0)).repartition(5)
    got = sorted(map(tuple, vectors.near_vectors(df).collect()), key=none_first)
    assert got == plain_near(rows)
    assert sum(r[1] for r in got) > 500 and len({r[2] for r in got}) > 40


def test_tiles_stop_early_and_lose_no_pair():
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 96))
    x[:90] = x[100:190] + r.normal(size=(90, 96)) * 0.28
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.93, 1)), strict=True)}
    got = [(i, int(j)) for i, js in vectors.tile_links(x, x, axes, 0.93, True) for j in js]
    assert want and set(got) == want and len(got) == len(want)
    assert vectors.stops(64) == [8, 16, 32, 64] and vectors.stops(5) == [5] and vectors.stops(768) == [8, 16, 32, 64, 128, 256, 512, 768]


def test_suffix_norms_bound_what_is_left():
    r = np.random.default_rng(4)
    a, b = vectors.unit(r.normal(size=(50, 40))), vectors.unit(r.normal(size=(50, 40)))
    at = vectors.stops(40)
    left = vectors.suffix_norms(a, at) * vectors.suffix_norms(b, at)
    for k, s in enumerate(at):
        assert ((a[:, s:] * b[:, s:]).sum(axis=1) <= left[:, k] + 1e-12).all()


def test_near_vectors_of_one_hot_vector_and_none(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(400)] + [(1000 + i, [1.0, 2.0 + i / 100, 3.0], 1) for i in range(20)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert {r.n_links for r in got.values()} == {419} and {r.component_id for r in got.values()} == {0} and sum(r.kept for r in got.values()) == 1
    empty = vectors.near_vectors(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert [tuple(r) for r in vectors.near_vectors(spark.createDataFrame([(1, None, 2), (2, [1.0], None)], VECTORS)).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


# --- 12 ---

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2], hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()))] for c, v in own.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = said.get(c - int(math.fmod(c, 20)), [])[:h] + said[c][h:]
    members = collections.defaultdict(list)
    for c, v in sorted(whole.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in cs if len(whole[c]) == len(node))
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=none_first)


def chats(seed):
    r = random.Random(seed)
    rows = []
    for c in range(0, 130):
        base = random.Random(c // 20)
        for t in range(r.randrange(1, 9)):
            text = f"word {base.randrange(2)} of {t}" if r.random() < 0.8 else f"own  {c} thing\n"
            rows.append((c if c % 20 or c < 80 else c + 1000, t if r.random() < 0.95 else None, r.choice(["user", "user", None]) if t else "system", text if r.random() < 0.9 else None))
    rows += [(500, t, "user", f"step {t}") for t in range(300)] + [(501, t, "user", f"step {t}") for t in range(250)]  # one deep path with a branch
    rows += [(900 + 20 * k + 1, 0, "user", "hi") for k in range(60)] + [(None, 0, "user", "nobody"), (-41, 3, "user", "minus"), (-40, 1, "a", "b"), (-40, 1, "a", "b")]
    return rows


def test_trie_equals_a_plain_version(spark):
    rows = chats(1)
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit(1)).withColumn("hash", F.lit("x")).withColumn("pos", F.lit(0)).repartition(4)
    got = sorted(map(tuple, prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.hashed_turns(df))).collect()), key=none_first)
    assert got == plain_trie(rows)
    assert max(r[1] for r in got) >= 297 and sum(r[4] > 1 for r in got) > 20


def test_role_and_text_are_told_apart_and_empty_tables(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (5, 0, "", "abc"), (6, 0, None, "abc"), (7, 0, None, None), (8, 0, "", "")]
    got = sorted(map(tuple, prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.hashed_turns(spark.createDataFrame(rows, TURNS)))).collect()), key=none_first)
    assert got == plain_trie(rows)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.hashed_turns(spark.createDataFrame([], TURNS)))).collect() == []


def test_light_edges_halve_the_members(spark):
    turns = prefix_trie.rebuilt(prefix_trie.hashed_turns(spark.createDataFrame(chats(2), TURNS)))
    tree = prefix_trie.heavy_paths(prefix_trie.stored(prefix_trie.passed_nodes(turns)))
    convs = tree.where("depth = 0").first()["n_convs"]
    assert 1 <= tree.agg(F.max("level")).first()[0] <= math.log2(convs)
    assert tree.groupBy("head_conv_id", "head_depth").agg((F.max("depth") - F.min("depth") + 1 - F.count("*")).alias("gap")).where("gap <> 0").count() == 0


# --- 13 ---

DOCS = "doc_id long, text string"


def plain_importance(docs, target):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, x in docs for f in features(x)[0])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[0])
    everything, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(everything + 10000) / (float(s[b] + 1) * float(wanted + 10000))))
    rows = []
    for i, x in docs:
        f, n = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    best = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(best[: 5 * len(best) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=none_first)


def prose(seed, n=260):
    r = random.Random(seed)
    some = ["Apple", "PEAR", "plum_tree", "naïve", "漢字", "ÄPFEL", "x1", "42", "don't", "z" * 300, "the", "the", "the", "of"]
    docs = [(i, " ".join(r.choice(some) + (str(r.randrange(30)) if r.random() < 0.5 else "") for _ in range(r.choice([0, 3, 19, 20, 21, 60, 200])))) for i in range(n)]
    docs += [(n + k, docs[9][1]) for k in range(30)] + [(1000, None), (1001, ""), (1002, " \x00\x7f--- "), (None, "lone words " * 30), (None, None), (7, docs[7][1]), (1003, "the " * 5000), (1004, "a\nb\tc" * 50)]
    return docs, ["The apple of plum tree 42", None, "", "naïve 漢字 the the"]


@pytest.mark.parametrize("block,part", [(8 << 20, 1 << 20), (700, 300)])
def test_importance_equals_a_plain_version(spark, monkeypatch, block, part):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    monkeypatch.setattr(importance, "PART_WORDS", part)
    docs, target = prose(1)
    df = spark.createDataFrame(docs, DOCS).withColumn("weight", F.lit(1)).withColumn("target", F.lit("x")).withColumn("block", F.lit(0)).repartition(3)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.drawn(importance.feature_weights(df, wanted)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=none_first) == plain_importance(docs, target)


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.drawn(importance.feature_weights(none, target)).collect() == []
    docs, _ = prose(2, 30)
    got = importance.drawn(importance.feature_weights(spark.createDataFrame(docs, DOCS), target.limit(0))).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=none_first) == plain_importance(docs, [])


def test_checksums_and_wide_vocabularies():
    texts = ["", "a", "漢字 x", "q" * 1000, "the of"]
    flat, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([len(t.encode()) for t in texts])
    assert importance.crc32(flat, np.concatenate(([0], ends[:-1])), ends).tolist() == [zlib.crc32(t.encode()) for t in texts]

    class Wide(list):  # a vocabulary too large for three words in 62 bits
        def __len__(self):
            return 1 << 25

    r = np.random.default_rng(1)
    ids = r.integers(0, 50, 4000) * ((1 << 25) // 50)
    start = np.array([0, 1500, 1500, 4000])
    narrow, wide = (importance.Block(ids // (1 if v is Wide else (1 << 25) // 50), start, v() if v is Wide else [None] * 50) for v in (list, Wide))
    for a, b in zip(narrow.features(3), wide.features(3), strict=True):
        assert (a == b).all()
    assert importance.unpacked(importance.packed(np.arange(5, dtype="<u4")), "<u4").tolist() == [0, 1, 2, 3, 4] and not len(importance.unpacked(importance.packed(np.zeros(0, "<u4")), "<u4"))


def test_keys_are_grouped_by_one_sort_of_numbers(monkeypatch):
    r = np.random.default_rng(2)
    for n, width in ((0, 1), (1, 1), (5000, 300), (5000, 1 << 40), (5000, 1 << 61)):
        key = r.integers(0, width, n) // max(width >> 9, 1) * max(width >> 9, 1)
        order, new = importance.grouped(key, width)
        distinct, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        begin = np.flatnonzero(new)
        assert (key[order[begin]] == distinct).all() and (order[begin] == first).all()
        assert (np.diff(begin, append=n) == count).all() and (importance.numbered(order, new) == which).all()
    # Runs of three words of a usual block need no sort of positions by their keys, and checksums no more rows at a time than the cache holds.
    def slow(*a, **b):
        raise AssertionError("positions were sorted by their keys")

    ids = r.integers(0, 150_000, 100_000)
    block = importance.Block(ids, np.array([0, 40_000, 100_000]), [None] * 150_000)
    wanted = np.unique(np.stack([ids[np.r_[0:39_998, 40_000:99_998] + j] for j in range(3)], 1), axis=0)
    monkeypatch.setattr(importance.np, "argsort", slow)
    monkeypatch.setattr(importance.np, "unique", slow)
    _, which, place, count = block.features(3)
    monkeypatch.undo()
    assert (np.stack([ids[place + j] for j in range(3)], 1) == wanted).all() and count.sum() == len(which) == 99_996
    texts = [f"{i:x}" * (i % 5) for i in range(3000)]
    flat, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([len(t) for t in texts])
    monkeypatch.setattr(importance, "CRC_ROWS", 70)
    assert importance.crc32(flat, np.concatenate(([0], ends[:-1])), ends).tolist() == [zlib.crc32(t.encode()) for t in texts]
