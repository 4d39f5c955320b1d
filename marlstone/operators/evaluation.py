"""Evaluation (E1-E26). A question is a row; its metrics are column expressions; aggregates are one groupBy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marlstone.functions.text import abstains, numbers, proper_nouns, refuses, stripped
from marlstone.operators.retrieval import similarity
from marlstone.plans.providers import OverlapJudge

K, DEEP, PROMOTED = 5, 10, 5
TARGETS = {"mrr_lift": 0.05, "ndcg_lift": 0.04, "p99_ms": 500.0}
EMPTY = "array<string>"
CAPS = {"question": 500, "context": 2000, "answer": 800, "ground_truth": 500}  # characters that a judge gets
CONTEXT_CAPS = {"faithfulness": 3000, "answer_relevance": 0, "completeness": 1500, "abstention_quality": 1500}


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(EMPTY))


def _share(part: Column, whole: Column, none: Column) -> Column:
    return F.when(whole == 0, none).otherwise(part / F.nullif(whole, F.lit(0)))


def precision(relevant: Column, retrieved: Column) -> Column:
    """Over distinct ids; 0 if nothing was retrieved."""
    got = F.array_distinct(retrieved)
    return _share(F.size(F.array_intersect(relevant, got)), F.size(got), F.lit(0.0))


def recall(relevant: Column, retrieved: Column) -> Column:
    """Without relevant ids 1 if nothing was retrieved, else 0."""
    wanted = F.array_distinct(relevant)
    return _share(F.size(F.array_intersect(wanted, retrieved)), F.size(wanted), F.when(F.size(retrieved) == 0, 1.0).otherwise(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)


def first_hit(relevant: Column, ranked: Column) -> Column:
    """Rank from 1 of the first relevant id; null without one."""
    return F.array_min(F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda i: i.isNotNull()))


def mrr(relevant: Column, ranked: Column) -> Column:
    return F.coalesce(1.0 / first_hit(relevant, ranked), F.lit(0.0))


def dcg(relevant: Column, ranked: Column) -> Column:
    return F.aggregate(F.transform(ranked, lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def ndcg(relevant: Column, ranked: Column, k: int = K) -> Column:
    """E5: repeated relevant ids count each time, so it may exceed 1."""
    n = F.least(F.size(F.array_distinct(relevant)), F.lit(k))
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return F.when(ideal > 0, dcg(relevant, ranked) / F.nullif(ideal, F.lit(0.0))).otherwise(0.0)


def retrieval_metrics(rows: DataFrame, k: int = K) -> DataFrame:
    """E1-E5 for (relevant, retrieved) lists of ids."""
    rel, ret = _list(F.col("relevant")), _list(F.col("retrieved"))
    head = F.slice(ret, 1, k)
    out = rows.withColumn("precision", precision(rel, ret)).withColumn("recall", recall(rel, ret))
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return out.withColumns({
        "retrieval_score": 0.3 * F.col("precision") + 0.4 * F.col("recall") + 0.3 * F.col("f1"),
        "num_retrieved": F.size(ret), "num_relevant": F.size(F.array_distinct(rel)),
        f"precision_at_{k}": precision(rel, head), f"recall_at_{k}": recall(rel, head),
        f"hit_rate_at_{k}": F.arrays_overlap(rel, head).cast("double"),
        f"mrr_at_{k}": mrr(rel, head), f"ndcg_at_{k}": ndcg(rel, head, k),
    })


def _ideal(n: Column, k: int) -> Column:
    n = F.least(n, F.lit(k)).cast("int")
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))


def hit_metrics(rows: DataFrame, k: int = K) -> DataFrame:
    """E1-E5 for (relevant, retrieved, n_relevant), where ``relevant`` has only the relevant ids among ``retrieved``
    and ``n_relevant`` counts them all, so that no list grows with the table."""
    found = retrieval_metrics(rows, k)
    hits, n = lambda size: F.size(F.array_intersect(_list(F.col("relevant")), F.slice(_list(F.col("retrieved")), 1, size))), F.col("n_relevant")
    none = F.when(F.size(_list(F.col("retrieved"))) == 0, 1.0).otherwise(0.0)
    out = found.withColumn("recall", _share(hits(2**31 - 1), n, none)).withColumn(f"recall_at_{k}", _share(hits(k), n, none))
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    gain = dcg(_list(F.col("relevant")), F.slice(_list(F.col("retrieved")), 1, k))
    return out.withColumns({
        "retrieval_score": 0.3 * F.col("precision") + 0.4 * F.col("recall") + 0.3 * F.col("f1"), "num_relevant": n,
        f"ndcg_at_{k}": F.when(n > 0, gain / F.nullif(_ideal(n, k), F.lit(0.0))).otherwise(0.0),
    })


def hit_reranker_metrics(rows: DataFrame, k: int = K) -> DataFrame:
    """E6-E8 for (relevant, before, after, n_relevant, latency_ms), with ``relevant`` and ``n_relevant`` as in ``hit_metrics``."""
    out = reranker_metrics(rows, k)
    for side in ("before", "after"):
        gain = dcg(_list(F.col("relevant")), F.slice(_list(F.col(side)), 1, k))
        out = out.withColumn(f"ndcg_{side}", F.when(F.col("n_relevant") > 0, gain / F.nullif(_ideal(F.col("n_relevant"), k), F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("ndcg_lift", F.col("ndcg_after") - F.col("ndcg_before"))
    return out.withColumn("roi", F.when(F.col("latency_ms") > 0, (F.col("mrr_lift") + F.col("ndcg_lift")) / (F.col("latency_ms") / 1000.0)))


def reranker_metrics(rows: DataFrame, k: int = K) -> DataFrame:
    """E6-E8 for (relevant, before, after, latency_ms)."""
    rel, old, new = (_list(F.col(c)) for c in ("relevant", "before", "after"))
    a, b = F.slice(old, 1, k), F.slice(new, 1, k)
    out = rows.withColumns({
        "mrr_before": mrr(rel, a), "mrr_after": mrr(rel, b), "ndcg_before": ndcg(rel, a, k), "ndcg_after": ndcg(rel, b, k),
        "precision_before": precision(rel, a), "precision_after": precision(rel, b),
    })
    for m in ("mrr", "ndcg", "precision"):
        out = out.withColumn(f"{m}_lift", F.col(f"{m}_after") - F.col(f"{m}_before"))
    both = F.filter(F.array_distinct(rel), lambda x: F.array_contains(old, x) & F.array_contains(new, x))
    moves = F.transform(both, lambda x: F.struct(F.array_position(old, x).alias("was"), F.array_position(new, x).alias("now")))
    total = F.aggregate(moves, F.lit(0.0), lambda s, m: s + (m["was"] - m["now"]))
    out = out.withColumn("avg_position_change", F.when(F.size(moves) > 0, total / F.size(moves)))
    out = out.withColumn("promoted_from_deep", F.size(F.filter(moves, lambda m: (m["was"] >= DEEP) & (m["now"] <= PROMOTED))))
    return out.withColumn("roi", F.when(F.col("latency_ms") > 0, (F.col("mrr_lift") + F.col("ndcg_lift")) / (F.col("latency_ms") / 1000.0)))


def aggregate_retrieval(rows: DataFrame, k: int = K) -> DataFrame:
    """Means that ignore nulls."""
    names = ["precision", "recall", "f1", "retrieval_score", f"precision_at_{k}", f"recall_at_{k}", f"hit_rate_at_{k}", f"mrr_at_{k}", f"ndcg_at_{k}"]
    return rows.agg(F.count("*").alias("questions"), *[F.avg(n).alias(f"average_{n}") for n in names])


def aggregate_reranker(rows: DataFrame) -> DataFrame:
    """Mean lifts, exact p99 latency (linear interpolation) and targets."""
    out = rows.agg(F.avg("mrr_lift").alias("mrr_lift"), F.avg("ndcg_lift").alias("ndcg_lift"), F.avg("precision_lift").alias("precision_lift"), F.avg("latency_ms").alias("latency_ms"), F.percentile("latency_ms", F.lit(0.99)).alias("p99_ms"), F.sum("promoted_from_deep").alias("promoted_from_deep"))
    return out.withColumns({"meets_mrr": F.col("mrr_lift") > TARGETS["mrr_lift"], "meets_ndcg": F.col("ndcg_lift") > TARGETS["ndcg_lift"], "meets_latency": F.col("p99_ms") < TARGETS["p99_ms"]})


def word_list(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def bleu(answer: Column, reference: Column) -> Column:
    """Share of the reference's distinct words in the answer."""
    got, want = F.array_distinct(word_list(answer)), F.array_distinct(word_list(reference))
    return _share(F.size(F.array_intersect(got, want)), F.size(want), F.when(F.size(got) == 0, 1.0).otherwise(0.0))


def rouge(answer: Column, reference: Column) -> Column:
    """Share of the reference's words, repeats counted, in the answer."""
    got, want = F.array_distinct(word_list(answer)), word_list(reference)
    return _share(F.size(F.filter(want, lambda w: F.array_contains(got, w))), F.size(want), F.when(F.size(got) == 0, 1.0).otherwise(0.0))


def semantic(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 of two vectors; 0 for a null or zero one."""
    return F.coalesce((similarity(a, b) + 1) / 2, F.lit(0.0))


def length_ratio(a: Column, b: Column) -> Column:
    """E15."""
    x, y = F.length(F.coalesce(a, F.lit(""))), F.length(F.coalesce(b, F.lit("")))
    return F.when(F.greatest(x, y) > 0, F.least(x, y) / F.nullif(F.greatest(x, y), F.lit(0))).otherwise(0.0)


def hallucination(question_type: Column, answer: Column) -> Column:
    """An unanswerable question should be refused."""
    return F.when(question_type == "hallucination", F.when(refuses(answer), 1.0).otherwise(0.0)).otherwise(1.0)


def abstention(unanswerable: Column, answer: Column, judged: Column | None = None) -> Column:
    """Abstaining is right if unanswerable; else a judge's score decides (``judged``; 0 without one)."""
    return F.when(unanswerable, abstains(answer).cast("double")).when(~abstains(answer), 1.0).otherwise(F.coalesce(judged if judged is not None else F.lit(None), F.lit(0.0)))


def composite(faithfulness: Column, relevance: Column, completeness: Column, abstaining: Column) -> Column:
    """E20."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.round(0.40 * zero(faithfulness) + 0.35 * zero(relevance) + 0.20 * zero(completeness) + 0.05 * zero(abstaining), 4)


def judged(criterion: str, question: Column, context: Column, answer: Column, ground_truth: Column, judge=None) -> Column:
    """A judge's score of the answer, clamped to [0, 1]; 0 for an empty answer, without a score, and on an error."""
    judge = judge or OverlapJudge()

    def one(q: str, c: str, a: str, g: str) -> float:
        try:
            score = float(judge.score(criterion, q, c, a, g))
            return max(0.0, min(1.0, score)) if score == score else 0.0
        except Exception:  # whatever a provider raises
            return 0.0

    @pandas_udf("double")
    def scores(q: pd.Series, c: pd.Series, a: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([one(*x) if x[2] else 0.0 for x in zip(q, c, a, g, strict=True)], dtype="float64")

    relevance = criterion == "answer_relevance"
    truth = F.lit("") if criterion in ("answer_relevance", "abstention_quality") else ground_truth
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    shown = F.lit("") if relevance else cut(context, min(CONTEXT_CAPS[criterion], CAPS["context"]))
    return scores(cut(question, CAPS["question"]), shown, cut(answer, CAPS["answer"]), cut(truth, CAPS["ground_truth"]))


def judge_metrics(rows: DataFrame, judge=None) -> DataFrame:
    """E18-E20 for (question, answer, contexts array<string>, ground_truth, unanswerable): faithfulness, answer_relevance,
    completeness, abstention_quality and generation_score_v2; an empty answer scores 0 in all."""
    question, answer, truth = F.col("question"), F.col("answer"), F.col("ground_truth")
    context = F.array_join(F.coalesce(F.col("contexts"), F.array().cast(EMPTY)), "\n\n---\n\n")
    out = rows
    for name in ("faithfulness", "answer_relevance", "completeness"):
        out = out.withColumn(name, judged(name, question, context, answer, truth, judge))
    out = out.withColumn("_refusal", judged("abstention_quality", question, context, answer, truth, judge))
    right = abstention(F.coalesce(F.col("unanswerable"), F.lit(False)), answer, F.col("_refusal"))
    out = out.withColumn("abstention_quality", F.when(F.coalesce(answer, F.lit("")) == "", 0.0).otherwise(right)).drop("_refusal")
    return out.withColumn("generation_score_v2", composite(F.col("faithfulness"), F.col("answer_relevance"), F.col("completeness"), F.col("abstention_quality")))


def factual(answer: Column, reference: Column) -> Column:
    """Share of the reference's numbers and capitalised words in the answer; 1 if it has none."""
    n, p = numbers(reference), proper_nouns(reference)
    hits = F.size(F.array_intersect(numbers(answer), n)) + F.size(F.array_intersect(proper_nouns(answer), p))
    return _share(hits, F.size(n) + F.size(p), F.lit(1.0))


def generation_metrics(rows: DataFrame) -> DataFrame:
    """E12-E17 for (question_type, answer, reference, similarity)."""
    a, r = F.col("answer"), F.col("reference")
    out = rows.withColumns({"bleu": bleu(a, r), "rouge": rouge(a, r), "length_ratio": length_ratio(a, r), "hallucination_score": hallucination(F.col("question_type"), a)})
    legacy = 0.25 * F.col("bleu") + 0.25 * F.col("rouge") + 0.35 * F.col("similarity") + 0.15 * F.col("length_ratio")
    return out.withColumn("generation_score", F.when(F.col("question_type") == "hallucination", F.col("hallucination_score")).otherwise(legacy))


def end_to_end(rows: DataFrame) -> DataFrame:
    """E22 for (answer, reference, similarity, relevance); a blank answer scores 0."""
    blank = F.coalesce(stripped(F.col("answer")), F.lit("")) == ""
    out = rows.withColumn("factual_consistency", F.when(blank, 0.0).otherwise(factual(F.col("answer"), F.col("reference"))))
    return out.withColumn("e2e_score", F.when(blank, 0.0).otherwise(0.5 * F.col("similarity") + 0.3 * F.col("factual_consistency") + 0.2 * F.col("relevance")))


def breakdown(rows: DataFrame, by: str) -> DataFrame:
    """Count, mean, least and greatest of e2e, else generation, else 0."""
    score = F.coalesce("e2e_score", "generation_score", F.lit(0.0))
    return rows.groupBy(by).agg(F.count("*").alias("count"), F.avg(score).alias("average_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def overall(row: dict[str, Column]) -> Column:
    """E25 from columns retrieval, generation, e2e, faithfulness, relevance, completeness."""
    c = {k: F.coalesce(row.get(k, F.lit(None)), F.lit(0.0)) for k in ("retrieval", "generation", "e2e", "faithfulness", "relevance", "completeness")}
    core = 0.40 * c["faithfulness"] + 0.30 * c["relevance"] + 0.30 * c["completeness"]
    judged = 0.30 * c["retrieval"] + 0.40 * core + 0.30 * c["e2e"]
    plain = 0.25 * c["retrieval"] + 0.25 * c["generation"] + 0.50 * c["e2e"]
    return F.round(F.when((c["faithfulness"] > 0) | (c["relevance"] > 0), judged).otherwise(plain), 4)


def running_means(rows: DataFrame, names: list[str], order: str = "seq", key: str | None = None) -> DataFrame:
    """Prefix means in ``order``, for each ``key`` (an evaluation run) if given."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.avg(n).over(w).alias(f"running_{n}") for n in names])
