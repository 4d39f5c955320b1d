"""Evaluation datasets (D1-D8). Sampling is by a seeded hash order, so it repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import domain, question_language, stripped

QUESTION_TYPES = ["factual", "analytical", "comparative", "summarization", "hallucination"]
DIFFICULTIES = ["easy", "medium", "hard"]
COUNTS = {"factual": 50, "analytical": 30, "comparative": 20, "summarization": 20, "hallucination": 10}
NO_ANSWER = "The documents do not contain this information."


def order(key: Column, seed: int) -> Column:
    """A pseudo-random order that SQL engines share."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def project_chunks(chunks: DataFrame, assets: DataFrame, project: int | None = None) -> DataFrame:
    """Chunks with their asset's name; of one project if given."""
    rows = chunks.join(assets.select(F.col("asset_id").alias("chunk_asset_id"), "asset_name"), "chunk_asset_id")
    return rows if project is None else rows.where(F.col("chunk_project_id") == project)


def sample(chunks: DataFrame, n: int, seed: int = 0, least: int = 50) -> DataFrame:
    """N chunks of at least ``least`` characters."""
    return chunks.where(F.length(stripped(F.col("text"))) >= least).orderBy(order(F.col("id"), seed), "id").limit(n)


def comparative_pairs(chunks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """D3: n pairs of chunks of two sources (of any two chunks if there is one source). Chunk i of a source in
    hash order meets chunk i of the next source, so pairs are as many as chunks, never their square; of a source
    only its first n (+ 1) chunks can be among the first n pairs, and each task passes on no more."""
    hashed = order(F.col("id"), seed)
    rows = chunks.select("id", "source", "text", hashed.alias("_h"))
    sources = rows.select("source").distinct().withColumn("_s", F.row_number().over(Window.orderBy("source")) - 1)
    n_sources = sources.agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("_h", "id"))
    rows = rows.withColumn("_i", place).where(F.col("_i") <= n + 1)
    rows = rows.join(sources, "source").join(F.broadcast(n_sources), how="cross")  # one row
    alone = F.col("_n") == 1
    a = rows.select(F.col("id").alias("id_a"), F.col("source").alias("source_a"), F.col("text").alias("text_a"), F.col("_h"), F.when(alone, F.col("_s")).otherwise((F.col("_s") + 1) % F.col("_n")).alias("_s"), F.when(alone, F.col("_i") + 1).otherwise(F.col("_i")).alias("_i"))
    b = rows.select(F.col("id").alias("id_b"), F.col("source").alias("source_b"), F.col("text").alias("text_b"), "_s", "_i")
    return a.join(b, ["_s", "_i"]).orderBy("_h", "id_a").limit(n).select("id_a", "source_a", "text_a", "id_b", "source_b", "text_b")


def summary_sets(chunks: DataFrame, n: int, seed: int = 0, most: int = 5) -> DataFrame:
    """N sets of 2 to ``most`` chunks over 30 characters, their first 500 characters."""
    rows = chunks.where(F.length("text") > 30).orderBy(order(F.col("id"), seed), "id").limit(n * most)
    rows = rows.withColumn("_i", F.row_number().over(Window.orderBy(order(F.col("id"), seed), "id")) - 1)  # n * most rows
    out = rows.groupBy(F.expr(f"_i div {most}").alias("set_id")).agg(F.array_sort(F.collect_list(F.struct("_i", "id", F.substring("text", 1, 500).alias("text")))).alias("x"))
    return out.where(F.size("x") >= 2).select("set_id", F.col("x.id").alias("ids"), F.col("x.text").alias("texts"))


def unanswerable(chunks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Seeds of questions without an answer: text to 1,000 characters and its domain."""
    rows = chunks.orderBy(order(F.col("id"), seed), "id").limit(n)
    none = F.array().cast("array<string>")
    return rows.select("id", F.substring("text", 1, 1000).alias("text"), domain(F.col("text")).alias("domain"), F.lit(NO_ANSWER).alias("reference_answer"), none.alias("source_chunks"))


def retrieval_examples(questions: DataFrame, chunks: DataFrame, seed: int = 0, first: int = 50, drawn: int = 10, most: int = 5) -> DataFrame:
    """For the first questions, their relevant ids and up to ``most`` irrelevant ones of ``drawn`` hashed ones.

    All questions draw from one hash order at an offset of their own, so a question costs ``drawn`` rows."""
    asked = questions.orderBy("id").limit(first).withColumn("_q", F.row_number().over(Window.orderBy("id")) - 1)
    deck = chunks.select(F.col("id").cast("string").alias("cid"), order(F.col("id"), seed).alias("_h")).orderBy("_h", "cid").limit(first * drawn)
    deck = deck.withColumn("_i", F.row_number().over(Window.orderBy("_h", "cid")) - 1)  # first * drawn rows
    dealt = deck.withColumn("_q", F.expr(f"_i div {drawn}"))
    fits = F.when(F.col("cid").isNotNull() & ~F.array_contains("source_chunks", F.col("cid")), F.struct("_i", "cid"))
    out = asked.join(dealt, "_q", "left").groupBy("id", "question", "source_chunks").agg(F.array_sort(F.collect_list(fits)).alias("x"))
    return out.select("id", F.col("question").alias("query"), F.col("source_chunks").alias("relevant_chunks"), F.slice("x.cid", 1, most).alias("irrelevant_chunks"))


def statistics(questions: DataFrame) -> DataFrame:
    """(kind, name, value): counts by type and difficulty (zeros included) and language, mean answer length, distinct documents and chunks."""
    spark = questions.sparkSession

    def counted(kind: str, column: str, names: list[str] | None) -> DataFrame:
        own = questions.groupBy(F.col(column).alias("name")).agg(F.count("*").cast("double").alias("value"))
        if names:
            own = spark.createDataFrame([(x,) for x in names], "name string").join(own, "name", "left").fillna(0.0, ["value"])
        return own.select(F.lit(kind).alias("kind"), "name", "value")

    total = questions.agg(F.count("*").cast("double").alias("total_questions"), F.avg(F.length("reference_answer")).alias("average_answer_length"))
    distinct = lambda c, n: questions.select(F.explode(c).alias("x")).agg(F.count_distinct("x").cast("double").alias("value")).select(F.lit("total").alias("kind"), F.lit(n).alias("name"), "value")
    totals = total.select(F.lit("total").alias("kind"), F.explode(F.create_map(F.lit("total_questions"), "total_questions", F.lit("average_answer_length"), "average_answer_length")).alias("name", "value"))
    out = totals
    for part in (counted("type", "question_type", QUESTION_TYPES), counted("difficulty", "difficulty", DIFFICULTIES), counted("language", "language", None), distinct("source_documents", "unique_source_documents"), distinct("source_chunks", "unique_chunks_used")):
        out = out.unionByName(part)
    return out


def seeds(chunks: DataFrame, counts: dict[str, int] | None = None, seed: int = 0, languages: list[str] | None = None) -> DataFrame:
    """What questions are written from: (question_type, ids, sources, texts, language), ``counts`` of each type.
    ``languages`` keeps chunks of these languages."""
    counts = COUNTS | (counts or {})
    rows = chunks.withColumn("language", question_language(F.col("text")))
    rows = rows.where(F.col("language").isin(languages)) if languages else rows
    one = lambda kind, df: df.select(F.lit(kind).alias("question_type"), F.array(F.col("id").cast("string")).alias("ids"), F.array("text").alias("texts"))
    out = one("factual", sample(rows, counts["factual"], seed)).unionByName(one("analytical", sample(rows, counts["analytical"], seed + 1)))
    pairs = comparative_pairs(rows, counts["comparative"], seed + 2).select(F.lit("comparative").alias("question_type"), F.array(F.col("id_a").cast("string"), F.col("id_b").cast("string")).alias("ids"), F.array("text_a", "text_b").alias("texts"))
    sets = summary_sets(rows, counts["summarization"], seed + 3).select(F.lit("summarization").alias("question_type"), F.col("ids").cast("array<string>").alias("ids"), "texts")
    return out.unionByName(pairs).unionByName(sets).unionByName(one("hallucination", unanswerable(rows, counts["hallucination"], seed + 4)))
