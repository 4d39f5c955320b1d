"""The stored indexes: layered proximity graphs, and postings with block bounds."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import retrieval
from marlstone.sources import proximity, store

DATA = "/root/testdata/sf0.1"
whole = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def points(spark, n, d=12, seed=1, first=0):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(r.standard_normal((n, d)).astype(np.float32))], "doc_id long, embedding array<float>").repartition(4)


@whole
def test_graphs_find_most_and_read_little(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    index = proximity.ProximityIndex(spark, str(tmp_path))
    assert not index.exists()
    found = index.add(rows).search(asked, 10).cache()
    assert index.exists() and found.count() == 10 * asked.count()
    assert store.CellIndex.recall(found, retrieval.dense_topk(asked, rows, 10)) >= 0.9
    assert found.agg(F.max("n_read")).first()[0] < rows.count() / 3 and found.agg(F.avg("n_read")).first()[0] < rows.count() / 5


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_shards_are_merged_and_new_vectors_added(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(proximity, "SHARD_BYTES", 12 * 4 * 100)
    rows, more = points(spark, 700), points(spark, 150, seed=2, first=5000)
    asked = points(spark, 40, seed=3).withColumnRenamed("doc_id", "query_id")
    proximity.ProximityIndex(spark, str(tmp_path), metric).add(rows)
    files = set(os.listdir(tmp_path / f"{metric}-16"))
    again = proximity.ProximityIndex(spark, str(tmp_path), metric)  # opened, not built
    assert again.exists() and set(os.listdir(tmp_path / f"{metric}-16")) == files
    again.add(more)
    shards = spark.read.parquet(again.path)
    assert shards.count() >= 7 and files - {"_SUCCESS", "._SUCCESS.crc"} <= set(os.listdir(tmp_path / f"{metric}-16")) and shards.agg(F.sum("size")).first()[0] == 850
    exact = retrieval.dense_topk(asked, rows.unionByName(more), 8, metric)
    assert store.CellIndex.recall(again.search(asked, 8, beam=60), exact) >= 0.97
    scores = again.search(asked, 8, beam=60).join(exact.select("query_id", "doc_id", F.col("score").alias("want")), ["query_id", "doc_id"])
    assert scores.where(F.abs(F.col("score") - F.col("want")) > 2e-6).count() == 0


def test_graphs_of_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.1]), (5, [1.0, 0.0])], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, None), (9, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = proximity.ProximityIndex(spark, str(tmp_path)).add(rows).search(asked, 3).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r.rank) for r in got] == [(7, 1, 0), (7, 5, 1), (7, 4, 2)]
    empty = proximity.ProximityIndex(spark, str(tmp_path / "none")).add(rows.limit(0))
    assert empty.search(asked, 3).collect() == []
    with pytest.raises(ValueError):
        proximity.ProximityIndex(spark, "x", "dot")


def test_an_index_stands_beside_its_collection(spark, tmp_path):
    collections = store.Collections(spark, str(tmp_path))
    name = collections.name(2, 7)
    collections.create(name, 2)
    collections.insert(name, spark.createDataFrame([(i, "t", [1.0, float(i)], None, i) for i in range(9)], "id long, text string, vector array<float>, metadata string, chunk_id long"), 2)
    collections.create_index(name)
    asked = spark.createDataFrame([(0, [1.0, 4.0])], "query_id long, embedding array<float>")
    hits = collections.search_index(name, asked, 1).first()
    assert (hits.doc_id, hits.chunk_id, hits.text) == (4, 4, "t") and name in collections.all() and len(collections.all()) == 1
    collections.insert(name, spark.createDataFrame([(10, "new", [-1.0, 0.0], None, 1)], "id long, text string, vector array<float>, metadata string, chunk_id long"), 2)
    before = set(os.listdir(collections.index(name).path))
    collections.create_index(name)  # only what is new is added
    assert before < set(os.listdir(collections.index(name).path)) and collections.index(name).ids().count() == 10
    assert collections.search_index(name, spark.createDataFrame([(0, [-1.0, 0.0])], "query_id long, embedding array<float>"), 1).first().text == "new"


# --- postings ---


def texts_of(seed, n, first=0):
    import random

    r = random.Random(seed)
    common, rare = ["alpha", "beta", "gamma"], [f"term{i}" for i in range(40)]
    return [(first + i, None if r.random() < 0.03 else " ".join(r.choice(common if r.random() < 0.4 else rare) for _ in range(r.choice([0, 4, 9, 30])))) for i in range(n)]


ASKED = [(1, "alpha term3"), (2, "term1 term2 term1 gamma"), (3, ""), (4, "nothing here"), (5, "beta"), (6, "term7"), (7, None)]


def same(spark, index, docs, k=7):
    from marlstone.operators.retrieval import bm25_topk

    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    got, want = (sorted(map(tuple, x.select("query_id", "doc_id", "score", "rank").collect())) for x in (index.search(asked, k), bm25_topk(asked, spark.createDataFrame(docs, "doc_id long, text string"), k)))
    assert [(a[0], a[1], a[3]) for a in got] == [(a[0], a[1], a[3]) for a in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
    return got


def test_postings_equal_a_new_index_after_changes(spark, tmp_path, monkeypatch):
    from marlstone.operators import postings

    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "SPREAD", 50)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = {i: (i, t) for i, t in texts_of(1, 220)}
    index = postings.StoredBm25(spark, str(tmp_path)).add(frame(list(docs.values())))
    assert same(spark, index, list(docs.values()))
    more = texts_of(2, 60, 180)  # 40 of these replace others
    docs |= {i: (i, t) for i, t in more}
    index.add(frame(more))
    same(spark, index, list(docs.values()))
    for i in (*range(0, 200, 3), 9999):
        docs.pop(i, None)
    index.delete(spark.createDataFrame([(i,) for i in (*range(0, 200, 3), 9999)], "doc_id long"))
    same(spark, index, list(docs.values()))
    back = [(3, "alpha alpha term3"), (6, "term7")]
    docs |= {i: (i, t) for i, t in back}
    again = postings.StoredBm25(spark, str(tmp_path))  # opened, not built
    assert again.segments() == [0, 1, 2]
    same(spark, again.add(frame(back)), list(docs.values()))
    assert again.live().count() == len(docs) == again.idf()[1]
    twice = [(7000, "alpha"), (7000, "term39 term39"), (None, "alpha alpha")]  # the greater text counts, a row without an id does not
    docs[7000] = twice[1]
    same(spark, again.add(frame(twice)), list(docs.values()))


def test_blocks_that_cannot_reach_the_floor_are_skipped(spark, tmp_path, monkeypatch):
    from marlstone.operators import postings

    monkeypatch.setattr(postings, "BLOCK", 4)
    rows = [(i, "apple " * (1 + i % 7) + "filler " * (i % 11) + ("pear" if i % 50 == 0 else "plum")) for i in range(300)] + [(1000 + i, "other words") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = postings.StoredBm25(spark, str(tmp_path)).add(docs)
    asked = spark.createDataFrame([(1, "apple"), (2, "apple pear")], "query_id long, text string")
    got, blocks = index.explained(asked, 5)
    from marlstone.operators.retrieval import bm25_topk

    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25_topk(asked, docs, 5).select(*got.columns).collect()))
    counts = {r.query_id: (r.n, r.s) for r in blocks.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.col("skipped").cast("int")).alias("s")).collect()}
    assert counts[1][0] == 75 and counts[1][1] > 75 / 2  # pear could lift any apple to the floor, so the second query skips none


def test_products_of_postings_and_queries_stay_where_they_are_made(spark, tmp_path, monkeypatch):
    import re

    from marlstone.operators import postings

    docs = texts_of(3, 120)
    index = postings.StoredBm25(spark, str(tmp_path)).add(spark.createDataFrame(docs, "doc_id long, text string"))
    plan = index.search(spark.createDataFrame(ASKED, "query_id long, text string"), 5)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L, doc_id#\d+L", plan)  # scores of pairs are not shuffled
    assert not re.search(r"Join \[term#\d+, segment#\d+", plan)  # a row for each query's block, in small files, is not sent to all tasks
    monkeypatch.setattr(postings, "BROADCAST_TERMS", 3)  # more terms than that are asked in rounds
    same(spark, index, docs)


def test_postings_of_nothing(spark, tmp_path):
    from marlstone.operators import postings

    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    index = postings.StoredBm25(spark, str(tmp_path))
    assert index.search(asked).collect() == [] and index.add(none).search(asked).collect() == [] and index.delete(none).search(asked).collect() == []
    assert index.add(spark.createDataFrame([(1, None), (2, "alpha")], "doc_id long, text string")).live().count() == 2
