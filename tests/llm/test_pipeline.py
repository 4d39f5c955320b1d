"""The pipeline's stages on edge cases, with narrow tables broadcast or shuffled."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import common
from tests.llm.test_llm import SCHEMA, words

ROWS = [
    (1, words(120, 1, 500), "en", "a", 0), (2, None, "en", "a", 0), (3, "", "en", None, 0), (None, words(120, 2, 500), None, "b", None), (None, words(120, 3, 500), "en", "b", 0),
    (5, words(120, 4, 500), "en", "a", 0), (5, words(120, 5, 500), "en", "a", 0), (6, words(120, 1, 500), "en", None, 0), (7, words(120, 6, 500) + " Mr. Smith rang +1 361 555 8283", "en", "a", 0), (7, words(120, 6, 500) + " Mr. Smith rang +1 361 555 8283", "en", "a", 0),
    (8, words(20_000, 7, 500), "en", "c", 0), *((11 + i, " ".join(f"{w}***" for w in words(100, 8 + i, 300).split()), "en", "a", 0) for i in range(6)), (10, "y" * 100_000, "en", "c", 0),
    *((20 + i, words(100 + i, 40 + i, 500), "en", "ab"[i % 2], 0) for i in range(40)),
]


@pytest.mark.parametrize("limit", [1_000_000, -1])
def test_stages_on_edge_cases(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("row", F.lit("r")).withColumn("doc", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("class", F.lit("c")).repartition(3)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: common.stored(stages[name](spark, df, f"file://{tmp_path}"))
    texts = lambda df: collections.Counter(r.text for r in df.collect())
    good = step("quality", docs)
    gone = [None, "", *(r[1] for r in ROWS if r[1] and "***" in r[1])]
    assert good.columns == columns and not set(gone) & set(texts(good))
    assert {r[1] for r in ROWS if r[1] and r[1] not in gone and not r[1].startswith("yyy")} <= set(texts(good))
    one = step("near_dedup", good)
    assert one.columns == columns and max(texts(one).values()) == 1 and set(texts(one)) == set(texts(good))
    assert [r.doc_id for r in one.where(F.col("text") == ROWS[0][1]).collect()] == [1]
    assert one.where("doc_id is null").count() == 2 and one.where("doc_id = 5").count() == 2
    hidden = step("pii", one)
    assert hidden.columns == columns and hidden.count() == one.count() and hidden.where("text like '%Smith%' or text like '%8283%'").count() == 0
    assert set(texts(hidden)) >= {ROWS[0][1], ROWS[3][1]}
    mix = step("mixing", hidden)
    assert mix.columns == columns and max(texts(mix).values()) <= 2 and set(texts(mix)) <= set(texts(hidden))
    packed = step("packing", mix)
    assert packed.agg(F.sum("length")).first()[0] > 20_000 and packed.where("length > 1024").count() == 0


def test_empty_tables_pass_all_stages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
