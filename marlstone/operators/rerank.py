"""Reranking (R10-R12) over provider objects that score batches of (query, text)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import simplified_query
from marlstone.operators.retrieval import DIGITS, top

QUERY_CHARS, TEXT_CHARS = 512, 4096


def reranked(provider, queries: DataFrame, candidates: DataFrame, k: int, simplify: bool = False) -> DataFrame:
    """Candidates (query_id, rank, doc_id, text, score) by the provider's score, stable; tagged with its source.
    Where the provider fails for a batch its scores are null, and those queries keep their order."""
    asked = queries.withColumn("query", simplified_query(F.col("query"))) if simplify else queries
    rows = candidates.withColumnRenamed("rank", "_old").join(asked, "query_id")
    cut = rows.withColumn("_q", F.substring("query", 1, QUERY_CHARS)).withColumn("_t", F.substring("text", 1, TEXT_CHARS))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            try:
                yield pd.Series(provider.score(q.tolist(), t.tolist()), dtype="float64")
            except ConnectionError:
                yield pd.Series([None] * len(q), dtype="float64")

    scored = cut.withColumn("_score", F.round(score("_q", "_t"), DIGITS)).drop("_q", "_t", "query")
    failed = F.max(F.col("_score").isNull().cast("int")).over(Window.partitionBy("query_id")) == 1
    scored = scored.withColumn("_failed", failed)
    out = top(scored, k, [F.when(F.col("_failed"), F.lit(0.0)).otherwise(-F.col("_score")), F.asc("_old")])
    return out.select("query_id", "rank", "doc_id", "text", F.when(F.col("_failed"), F.col("score")).otherwise(F.col("_score")).alias("score"), F.when(F.col("_failed"), F.lit("no_rerank")).otherwise(F.lit(provider.source)).alias("source"))


def cascade(providers: list, queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The first provider that is up; without one the first k in their order."""
    for p in providers:
        if p.available():
            return reranked(p, queries, candidates, k, simplify=getattr(p, "hosted", False))
    return candidates.where(F.col("rank") < k).select("query_id", "rank", "doc_id", "text", "score", F.lit("no_rerank").alias("source"))
