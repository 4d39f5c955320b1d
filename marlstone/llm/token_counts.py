"""Exact length histogram: documents by encoded length, with suffix sums.

Method. Each task counts encoded lengths (an exact encoding, no estimate) and
emits one row per (group, length) and batch; these are summed and suffix sums
are taken in two levels: within blocks of BLOCK lengths, and over block totals,
so that no window ranges over all lengths at once. A row for length n answers,
for a context limit of n: how many documents reach it (``docs_ge``), all their
ids (``tokens_ge``), and the total after truncation (``truncated_total``). It
answers every limit L from ``limit_from`` (one above the next smaller length) to n as well: as
many documents reach it, and the truncated total is truncated_total - (n - L) * docs_ge;
limits above the longest document truncate nothing. n is the length at all
quantiles q (nearest rank) with quantile_from < q <= quantile_to. So the rows
answer totals, quantiles and truncated totals for every context limit;
``at_limits`` looks given ones up.

Edge cases: null text counts as empty (length 0); an empty table gives no rows;
extra columns are ignored; repeated rows count each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import stored, table, workers_find_package
from marlstone.llm.tokens import default_vocabulary, encoded

BLOCK = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) counted within each task."""
    workers_find_package(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for _, _, _, first in encoded(batch.column(0), path, count_only=True):
                sizes, n = np.unique(np.diff(first), return_counts=True)
                seen.update(dict(zip(sizes.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(run, "n_tokens long, n_docs long")


def histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    counts = encoded_lengths(docs, vocabulary).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return suffix_sums(stored(counts))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Suffix sums over (n_tokens, n_docs), n_tokens unique."""
    rows = counts.select("n_tokens", "n_docs", F.expr(f"n_tokens div {BLOCK}").alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"), F.max("n_tokens").alias("longest"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    above = totals.select("block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"above_{c}") for c in "dt"], F.sum("t").over(Window.partitionBy()).alias("all_tokens"), F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.lead("longest").over(Window.orderBy(F.desc("block"))).alias("below"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(above, "block").select(
        "n_tokens", "n_docs", "tokens",
        (F.sum("n_docs").over(own) + F.col("above_d")).alias("docs_ge"),
        (F.sum("tokens").over(own) + F.col("above_t")).alias("tokens_ge"),
        "all_tokens", "all_docs",
        (F.coalesce(F.lead("n_tokens").over(Window.partitionBy("block").orderBy(F.desc("n_tokens"))), "below", F.lit(-1)) + 1).alias("limit_from"),
    )
    out = out.withColumn("truncated_total", F.col("all_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens"))
    shorter = F.col("all_docs") - F.col("docs_ge")
    out = out.withColumn("quantile_from", shorter / F.col("all_docs")).withColumn("quantile_to", (shorter + F.col("n_docs")) / F.col("all_docs"))
    return out.drop("all_tokens", "all_docs")


def at_limits(table: DataFrame, limits: list[int], quantiles: list[float] = ()) -> DataFrame:
    """(kind, x, answer): the truncated total for each context limit, and the length at each quantile (nearest rank)."""
    n, L, q = F.col("n_tokens"), F.col("x").cast("long"), F.col("x")
    asks = [F.struct(F.lit("limit").alias("kind"), F.lit(float(x)).alias("x")) for x in limits]
    asks += [F.struct(F.lit("quantile").alias("kind"), F.lit(float(x)).alias("x")) for x in quantiles]
    rows = table.select("*", F.explode(F.array(*asks)).alias("ask")).select("*", "ask.*")
    total = F.when(L.between(F.col("limit_from"), n), F.col("truncated_total") - (n - L) * F.col("docs_ge"))
    at = F.when((q <= F.col("quantile_to")) & ((q > F.col("quantile_from")) | (F.col("quantile_from") == 0)), n)
    beyond = F.sum("tokens")  # a limit above all lengths
    answer = F.when(F.col("kind") == "limit", F.coalesce(F.max(total), beyond)).otherwise(F.max(at))
    return rows.groupBy("kind", "x").agg(answer.alias("answer"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "documents"))
