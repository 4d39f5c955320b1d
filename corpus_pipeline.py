"""A training-corpus pipeline over ``documents``: classify, deduplicate, pseudonymise, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``, extra ones of any name included.

Edge cases: null and empty texts are rejected by the classifier; documents without an id, and
different texts that share one, are told apart by id and text in every stage and go on, each for itself; equal rows are one document
after near_dedup; repeated texts leave the one with the smallest id; texts of any length are used whole; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.classifier import accepted
from marlstone.llm.common import release, stored, table, workers_find_package
from marlstone.llm.mixing import mixed_documents
from marlstone.llm.near_dups import deduplicated
from marlstone.llm.packing import pack_documents
from marlstone.llm.pii import with_surrogates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    return accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return deduplicated(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars is recounted."""
    return with_surrogates(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources meet their targets, shuffled within shards."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids. A document that the mix repeats is packed as often."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: No stage but mixing's targets is expressible in SQL (trained weights, hashes, tokenizer); tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if hasattr(before, "stored_at"):
            release(before)  # the next stage's table stands by itself
    return docs
