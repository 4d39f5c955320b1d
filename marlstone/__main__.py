"""Command line: ``python -m marlstone generate-dataset CHUNKS OUT`` and ``python -m marlstone evaluate CHUNKS DATASET OUT``.

CHUNKS is a Parquet table (id, text, source); questions are written by the offline model unless a program passes its own
provider to these functions."""

from __future__ import annotations

import argparse
import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import datasets, evaluation
from marlstone.plans.engine import Engine
from marlstone.plans.prompts import filled
from marlstone.plans.providers import ExtractiveModel
from marlstone.session import session
from marlstone.sources.results import write_results


def generate_dataset(chunks: DataFrame, out: str, model=None, counts: dict[str, int] | None = None, seed: int = 0) -> DataFrame:
    """Questions (id, question_type, question, source_chunks, source_documents) from seeds of all types, written to ``out`` as JSON."""
    model = model or ExtractiveModel()

    @F.pandas_udf("string")
    def written(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        asked = lambda k, t: filled(f"question.{k}", chunk=t[0], other=t[-1], language="English").replace("\n", " ")
        asks = ["\n\n".join(t) + f"\n\n## Question: {asked(k, t)}" for k, t in zip(kinds, texts, strict=True)]
        return pd.Series([x or "" for x in model.generate(asks, 0.7)])

    seeds = datasets.seeds(chunks, counts, seed)
    key = F.concat_ws("_", "question_type", F.array_join("ids", "-"))
    rows = seeds.select(F.substring(F.sha2(key, 256), 1, 16).alias("id"), "question_type", F.trim(written("question_type", "texts")).alias("question"), F.col("ids").alias("source_chunks"))
    rows.where("question <> ''").write.mode("overwrite").json(out)
    return chunks.sparkSession.read.schema(rows.schema).json(out)


def evaluate(chunks: DataFrame, questions: DataFrame, out: str, root: str, k: int = 10) -> dict:
    """Index ``chunks``, retrieve and answer all ``questions``, and write the results to ``out``."""
    spark: SparkSession = chunks.sparkSession
    engine = Engine(spark, root)
    engine.index(chunks.select(F.col("id").cast("long").alias("chunk_id"), F.col("text").alias("chunk_text")), 1, reset=True)
    asked = questions.select(F.pmod(F.xxhash64("id"), F.lit(1 << 52)).alias("query_id"), F.col("question").alias("text"), F.col("source_chunks").alias("relevant"), "question_type")
    answers = engine.answer(asked.select("query_id", F.col("text").alias("question"), "question_type"), 1).select("query_id", "answer")
    rows = engine.evaluate(asked.join(answers, "query_id", "left").withColumn("unanswerable", F.col("question_type") == "hallucination"), 1, k).cache()
    names = ["faithfulness", "answer_relevance", "completeness", "abstention_quality", "generation_score_v2"]
    generation = rows.agg(*[F.avg(n).alias(n) for n in names]).first().asDict()
    retrieval = evaluation.aggregate_retrieval(rows).first().asDict()
    kinds = evaluation.breakdown(rows.withColumns({"e2e_score": F.lit(None).cast("double"), "generation_score": F.col("generation_score_v2")}), "question_type").collect()  # a row for each type
    found = {
        "timestamp": datetime.datetime.now(datetime.UTC), "overall_score": generation["generation_score_v2"], "total_questions": retrieval["questions"], "retrieval_metrics": retrieval,
        "generation_metrics": generation, "question_type_breakdown": {r["question_type"]: r for r in kinds}, "config": {"k": k, "root": root},
    }
    rows.unpersist()
    write_results(spark, found, out)
    return found


def main(words: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    make = commands.add_parser("generate-dataset")
    test = commands.add_parser("evaluate")
    for c in (make, test):
        c.add_argument("chunks")
    make.add_argument("out")
    make.add_argument("--seed", type=int, default=0)
    for kind, n in datasets.COUNTS.items():
        make.add_argument(f"--{kind}", type=int, default=n)
    for name in ("dataset", "out"):
        test.add_argument(name)
    test.add_argument("--root", required=True, help="folder of the vector collections")
    test.add_argument("--k", type=int, default=10)
    a = parser.parse_args(words)
    spark = session()
    chunks = spark.read.parquet(a.chunks)
    if a.command == "generate-dataset":
        print(generate_dataset(chunks, a.out, counts={kind: getattr(a, kind) for kind in datasets.COUNTS}, seed=a.seed).count(), "questions")
    else:
        schema = "id string, question_type string, question string, source_chunks array<string>"
        print(evaluate(chunks, spark.read.schema(schema).json(a.dataset), a.out, a.root, a.k)["overall_score"])


if __name__ == "__main__":
    main()
