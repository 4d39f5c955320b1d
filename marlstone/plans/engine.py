"""The Python API: ingest, index, search, answer, evaluate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marlstone.functions.text import contextualized, excerpt
from marlstone.operators import chunking, evaluation, rerank, retrieval
from marlstone.plans import graph
from marlstone.plans.providers import ExtractiveModel, HashingEmbedder, LexicalReranker
from marlstone.sources.store import Collections


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder=None, reranker=None, model=None, metric: str = "cosine") -> None:
        self.spark, self.embedder, self.model = spark, embedder or HashingEmbedder(), model or ExtractiveModel()
        self.reranker, self.collections = reranker or LexicalReranker(), Collections(spark, root, metric)

    def embed(self, rows: DataFrame, column: str = "text", kind: str = "document") -> DataFrame:
        """Rows with ``embedding``; null or blank text has the zero vector."""
        embedder = self.embedder

        @pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            return pd.Series(embedder.embed(texts.fillna("").tolist(), kind))

        return rows.withColumn("embedding", vectors(F.col(column)))

    def hyde(self, queries: DataFrame) -> DataFrame:
        """Queries with the embedding of a written passage (800 characters), else of themselves; ``source`` tells which."""
        model = self.model

        @pandas_udf("string")
        def passage(texts: pd.Series) -> pd.Series:
            return pd.Series(model.generate([f"Write a passage that answers:\n\n## Question: {t}" for t in texts], 0.4))

        rows = queries.withColumn("_passage", F.substring(F.trim(passage("text")), 1, 800))
        rows = rows.withColumn("source", F.when(F.length("_passage") > 0, "hyde").when(F.length(F.trim("text")) > 0, "raw_query").otherwise("failed"))
        return self.embed(rows.withColumn("_passage", F.when(F.col("source") == "hyde", F.col("_passage")).otherwise(F.col("text"))), "_passage", "query").drop("_passage")

    def contextualize(self, chunks: DataFrame) -> DataFrame:
        """Chunks with a summary of their document in front; the original text is kept."""
        model = self.model

        @pandas_udf("string")
        def summary(docs: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series(model.generate([f"{d[:3000]}\n\n## Question: {t[:1500]}" for d, t in zip(docs, texts, strict=True)]))

        docs = chunks.groupBy("seq").agg(excerpt(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"])).alias("_doc"))
        rows = chunks.join(docs, "seq").withColumn("context_summary", summary("_doc", "chunk_text")).drop("_doc")
        text = contextualized(F.col("chunk_text"), F.col("language"), F.col("context_summary"))
        return rows.withColumn("original_text", F.col("chunk_text")).withColumn("chunk_text", text).withColumn("contextualized", F.col("chunk_text") != F.col("original_text"))

    def ingest(self, docs: DataFrame, size: int = chunking.HYBRID["size"], overlap: int = chunking.HYBRID["overlap"], run: str | None = None) -> DataFrame:
        return chunking.chunks(docs, size, overlap, run=run)

    def index(self, chunks: DataFrame, project: int, reset: bool = False) -> str:
        """Embed chunks (chunk_id, chunk_text) into the project's collection."""
        name = self.collections.name(self.embedder.size, project)
        self.collections.create(name, self.embedder.size, reset)
        rows = self.embed(chunks.withColumnRenamed("chunk_text", "text")).select(F.col("chunk_id").alias("id"), "text", F.col("embedding").alias("vector"), F.lit("{}").alias("metadata"), "chunk_id")
        self.collections.insert(name, rows, self.embedder.size)
        return name

    def _corpus(self, project: int) -> DataFrame:
        return self.collections.scan(self.collections.name(self.embedder.size, project)).select(F.col("id").alias("doc_id"), "text", F.col("vector").alias("embedding"))

    def search(self, queries: DataFrame, project: int, k: int = 10) -> DataFrame:
        """Nearest chunks of (query_id, text)."""
        return retrieval.dense_topk(self.embed(queries, kind="query"), self._corpus(project), k)

    def retrieve(self, queries: DataFrame, project: int, k: int = 5, proposed: DataFrame | None = None) -> DataFrame:
        """R14 with the reranker; ``proposed`` has query variants."""
        rows = retrieval.variants(queries, proposed) if proposed is not None else queries.withColumn("variant", F.lit(0))
        corpus = self._corpus(project)
        again = lambda q, c, n: rerank.cascade([self.reranker], q, c, n)
        return retrieval.advanced(self.hyde(rows), corpus.select("doc_id", "text"), corpus.select("doc_id", "embedding"), k, again)

    def answer(self, questions: DataFrame, project: int, agentic: bool = False, **parts) -> DataFrame:
        """G1-G12; ``parts`` are those of ``graph.answer``: judge, web, rewrite and rounds."""
        return graph.answer(questions, lambda q: self.retrieve(q, project), self.model, agentic=agentic, **parts)

    def evaluate(self, questions: DataFrame, project: int, k: int = 10, judge=None) -> DataFrame:
        """Retrieval metrics of (query_id, text, relevant); where there is an ``answer`` (and, if known, ``ground_truth`` and
        ``unanswerable``), also the judge metrics over the texts retrieved."""
        hits = self.search(questions.select("query_id", "text"), project, k)
        lists = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")).alias("retrieved"))
        out = evaluation.retrieval_metrics(questions.join(lists, "query_id", "left"))
        if "answer" not in questions.columns:
            return out
        texts = hits.join(self._corpus(project).select("doc_id", F.col("text").alias("_text")), "doc_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_text"))), lambda x: x["_text"]).alias("contexts"))
        out = out.join(texts, "query_id", "left").withColumn("question", F.col("text"))
        for name, kind in (("ground_truth", "string"), ("unanswerable", "boolean")):
            if name not in questions.columns:
                out = out.withColumn(name, F.lit(None).cast(kind))
        return evaluation.judge_metrics(out, judge)
