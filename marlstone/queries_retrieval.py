"""Queries over retrieval, fusion, evaluation, datasets and the answering graph, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import datasets, evaluation, feedback, learned, rerank, retrieval
from marlstone.operators.postings import StoredBm25
from marlstone.plans import graph
from marlstone.plans.providers import LexicalReranker
from marlstone.queries_text import TOKENS, query, sql_any, table
from marlstone.functions import text as T
from marlstone.session import kept, kept_folder
from marlstone.sources import store
from marlstone.sources.proximity import ProximityIndex

# documents and embeddings share no key; vec_id = doc_id is a convention of these queries, to have a joint corpus


def corpus(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def asked(spark, d):
    """Every document with a vector whose id is divisible by 20, as a query of up to 1,000 characters."""
    docs = corpus(spark, d).where("doc_id % 20 = 0").select("doc_id", F.substring("text", 1, 1000).alias("text"))
    return docs.join(vectors(spark, d), "doc_id").withColumnRenamed("doc_id", "query_id")


def vectors_asked(spark, d):
    """Every vector whose id is divisible by 20, as a query."""
    return vectors(spark, d).where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"


def dense_sql(score: str, k: int, where: str = "q.vec_id % 20 = 0") -> str:
    return f"""SELECT query_id, doc_id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {score} + 0.0 AS score,
    (row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, v.vec_id) - 1)::INT AS rank FROM embeddings q, embeddings v WHERE {where}) WHERE rank < {k}"""


@query(dense_sql(COS, 10))
def dense_cosine(spark, d):
    """R1, R5, R15."""
    return retrieval.dense_topk(vectors_asked(spark, d), vectors(spark, d), 10)


@query(dense_sql("round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)", 10))
def dense_dot(spark, d):
    """R2."""
    return retrieval.dense_topk(vectors_asked(spark, d), vectors(spark, d), 10, "dot")


@query(dense_sql("round(-list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)", 10))
def dense_euclidean(spark, d):
    """R2."""
    return retrieval.dense_topk(vectors_asked(spark, d), vectors(spark, d), 10, "euclidean")


@query()
def approximate_neighbours(spark, d):
    """K5: hits of the approximate index for every id divisible by 20, and whether exact search has them as well."""
    asked, rows = vectors_asked(spark, d), vectors(spark, d)
    exact = retrieval.dense_topk(asked, rows, 10).select("query_id", "doc_id", F.lit(True).alias("exact"))
    found = store.CellIndex(rows).search(asked, 10)
    return found.join(exact, ["query_id", "doc_id"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


@query()
def proximity_neighbours(spark, d):
    """K5: hits of the layered proximity graphs for every id divisible by 20, whether exact search has them as well, and how many vectors were compared."""
    asked, rows = vectors_asked(spark, d), vectors(spark, d)
    exact = retrieval.dense_topk(asked, rows, 10).select("query_id", "doc_id", F.lit(True).alias("exact"))
    found = ProximityIndex(spark, kept_folder(spark)).add(rows).search(asked, 10)
    return found.join(exact, ["query_id", "doc_id"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


def bm25_ctes(queries: str) -> str:
    """CTEs up to ``scores``, for a relation of (query_id, text)."""
    return f"""t AS (SELECT doc_id, {TOKENS.format('text')} AS ts FROM documents),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
p AS (SELECT doc_id, term, count(*) AS tf, dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY 1, 2, 4),
r AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY term, n),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
w AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS term FROM ({queries})) GROUP BY 1, 2),
scores AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM p JOIN w USING (term) JOIN i USING (term), s GROUP BY 1, 2 HAVING score > 0)"""


BM25_SQL = f"""WITH {bm25_ctes('SELECT item_id AS query_id, text FROM benchmark')},
x AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM scores)
SELECT query_id, doc_id, score, rank FROM x WHERE rank < 10"""


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(BM25_SQL)
def bm25(spark, d):
    """Benchmark items against documents."""
    return retrieval.bm25_topk(items(spark, d), corpus(spark, d), 10)


@query(BM25_SQL)
def stored_bm25(spark, d):
    """The same from an index that grew by two additions, the second of which replaced documents; it holds all documents in the end."""
    docs, held = corpus(spark, d), StoredBm25(spark, kept_folder(spark))
    held.add(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 3, F.lit("an older text")).otherwise(F.col("text"))))
    return held.add(docs.where("doc_id % 7 = 3")).search(items(spark, d), 10)


@query(f"""WITH {bm25_ctes('SELECT item_id AS query_id, text FROM benchmark')},
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM scores),
h AS (SELECT query_id, doc_id, score / sum(score) OVER (PARTITION BY query_id) AS share FROM x WHERE place <= 5),
f AS (SELECT query_id, term, sum(share * tf / dl) AS likely FROM h JOIN p USING (doc_id) GROUP BY 1, 2),
g AS (SELECT query_id, term, round(likely * idf, 9) AS score FROM f JOIN i USING (term) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.query_id = f.query_id AND w.term = f.term)),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS place FROM g),
m AS (SELECT query_id, string_agg(term, ' ' ORDER BY place) AS more FROM z WHERE place <= 10 GROUP BY 1)
SELECT item_id AS query_id, coalesce(text || ' ' || more, text) AS text FROM benchmark LEFT JOIN m ON query_id = item_id""")
def feedback_variants(spark, d):
    """Benchmark items with the terms of their first hits."""
    return feedback.expanded(items(spark, d), retrieval.Bm25(corpus(spark, d)))


ASKED = "SELECT doc_id AS query_id, substr(d.text, 1, 1000) AS text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE doc_id % 20 = 0"
LISTS = f"""{bm25_ctes(ASKED)},
l AS (SELECT query_id, 0 AS list_id, rank, doc_id, score FROM ({dense_sql(COS, 10, "q.vec_id % 20 = 0 AND q.vec_id IN (SELECT doc_id FROM documents)")})
    UNION ALL SELECT query_id, 1, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM scores) WHERE rank < 10),
lists AS (SELECT l.*, text FROM l JOIN documents USING (doc_id))"""
FUSED = """f AS (SELECT query_id, substr(sha256(substr(text, 1, 200)), 1, 12) AS key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min((list_id, rank, doc_id, text)) AS first FROM lists GROUP BY 1, 2),
o AS (SELECT query_id, first[3] AS doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first[1], first[2]) - 1)::INT AS rank FROM f)"""


@query(f"WITH {LISTS} SELECT query_id, list_id, rank, doc_id, score FROM lists")
def hybrid_lists(spark, d):
    """Dense and sparse lists."""
    return retrieval.hybrid(asked(spark, d), corpus(spark, d), vectors(spark, d), 10).drop("text")


@query(f"WITH {LISTS}, {FUSED} SELECT query_id, doc_id, score, rank FROM o WHERE rank < 5")
def hybrid_search(spark, d):
    """The flagship, "more like this" over documents and vectors, fused by reciprocal rank."""
    return retrieval.rrf(retrieval.hybrid(asked(spark, d), corpus(spark, d), vectors(spark, d), 10), top_k=5).drop("text")


@query("""WITH l AS (SELECT conv_id % 40 AS query_id, CASE WHEN conv_id % 40 < 5 THEN 0 ELSE turn % 3 END AS list_id, row_number() OVER (PARTITION BY conv_id % 40, CASE WHEN conv_id % 40 < 5 THEN 0 ELSE turn % 3 END ORDER BY conv_id, turn) - 1 AS rank, conv_id * 100 + turn AS doc_id, text FROM conversations),
k AS (SELECT *, min(list_id) OVER (PARTITION BY query_id) = max(list_id) OVER (PARTITION BY query_id) AS lone, substr(sha256(substr(text, 1, 200)), 1, 12) AS h FROM l),
f AS (SELECT query_id, CASE WHEN lone THEN rank || ':' || h ELSE h END AS key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min((list_id, rank, doc_id)) AS first FROM k GROUP BY 1, 2)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first[1], first[2]) - 1)::INT AS rank, first[3] AS doc_id, score FROM f""")
def rank_fusion(spark, d):
    """R9 with repeated texts, three lists, and single lists."""
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").withColumn("query_id", F.col("conv_id") % 40).withColumn("list_id", F.when(F.col("query_id") < 5, 0).otherwise(F.col("turn") % 3))
    rank = F.row_number().over(Window.partitionBy("query_id", "list_id").orderBy("conv_id", "turn")) - 1
    rows = rows.select("query_id", "list_id", rank.alias("rank"), (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text", F.lit(0.0).alias("score"))
    return retrieval.rrf(rows).drop("text")


@query("""WITH v AS (SELECT item_id AS query_id, text, [text, '  ' || text || '  ', 'other way', 'tiny'] AS vs FROM benchmark),
k AS (SELECT query_id, [text] || list_filter(vs, lambda t: length(trim(t)) > 5)[1:3] AS vs FROM v),
u AS (SELECT query_id, unnest(range(len(vs))) AS pos, unnest(vs) AS text FROM k),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(text)) ORDER BY pos) AS n FROM u)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1)::INT AS variant, text FROM x WHERE n = 1""")
def query_variants(spark, d):
    """R8."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    proposed = q.select("query_id", F.array("text", F.concat(F.lit("  "), F.col("text"), F.lit("  ")), F.lit("other way"), F.lit("tiny")).alias("texts"))
    return retrieval.variants(q, proposed)


ADV = "SELECT doc_id * 1000 + v AS query_id, CASE v WHEN 0 THEN substr(d.text, 1, 1000) ELSE substr(d.text, 101, 300) END AS text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, (SELECT unnest([0, 1]) AS v) WHERE doc_id % 20 = 0 AND length(trim(CASE v WHEN 0 THEN d.text ELSE substr(d.text, 101, 300) END)) > 0"


@query(f"""WITH a AS ({ADV}), {bm25_ctes(ADV)},
dn AS (SELECT a.query_id, v.vec_id AS doc_id, {COS} AS score, row_number() OVER (PARTITION BY a.query_id ORDER BY {COS} DESC, v.vec_id) - 1 AS rank FROM a JOIN embeddings q ON q.vec_id = a.query_id // 1000, embeddings v),
sp AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scores),
lists AS (SELECT query_id // 1000 AS query_id, x.list_id + query_id % 1000 AS list_id, rank, doc_id, text FROM (SELECT query_id, doc_id, rank, 0 AS list_id FROM dn WHERE rank < 30 UNION ALL SELECT query_id, doc_id, rank, 1000 FROM sp WHERE rank < 30) x JOIN documents USING (doc_id)),
{FUSED} SELECT query_id, doc_id, score, rank FROM o WHERE rank < 5""")
def advanced_retrieval(spark, d):
    """R14 without a reranker: two variants of each question, 30 of each list, fused."""
    q = asked(spark, d)
    second = corpus(spark, d).select(F.col("doc_id").alias("query_id"), F.substring("text", 101, 300).alias("text")).join(q.select("query_id", "embedding"), "query_id")
    both = q.withColumn("variant", F.lit(0)).unionByName(second.withColumn("variant", F.lit(1)))
    return retrieval.advanced(both, corpus(spark, d), vectors(spark, d)).drop("text", "source")


@query()
def reranked_search(spark, d):
    """R10, R12, R14 with the offline reranker, for every id divisible by 20."""
    q = asked(spark, d).withColumn("variant", F.lit(0))
    again = lambda a, c, n: rerank.cascade([LexicalReranker()], a, c, n)
    return retrieval.advanced(q, corpus(spark, d), vectors(spark, d), 5, again).drop("text")


def known_items(spark, d):
    """A question of three runs of two words out of each document whose id is divisible by 20."""
    words = corpus(spark, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text", T.bm25_tokens(F.col("text")).alias("ts")).where("size(ts) > 1")
    place = "cast(pmod(query_id div 20 + i * 7919, size(ts) - 1) as int)"
    return words.select("query_id", F.expr(f"array_join(flatten(transform(sequence(0, 2), i -> slice(ts, {place} + 1, 2))), ' ')").alias("query"), "text")


def known_item_lists(spark, d):
    """(questions, candidates, relevant documents, index): 20 documents a question by the fused lists of its words and of its expansion; relevant are all with its document's text."""
    asked, docs = known_items(spark, d), corpus(spark, d)
    index = retrieval.Bm25(docs)
    plain = asked.select("query_id", F.col("query").alias("text"))
    lists = index.search(plain, 20).withColumn("list_id", F.lit(0)).unionByName(index.search(feedback.expanded(plain, index), 20).withColumn("list_id", F.lit(1)))
    fused = retrieval.rrf(lists.join(docs.where("doc_id is not null"), "doc_id"), top_k=20)
    same = F.sha2("text", 256).alias("same")
    relevant = docs.select("doc_id", same).join(asked.select("query_id", same), "same").select("query_id", "doc_id")
    return asked.select("query_id", "query"), kept(fused), relevant, index


@query()
def learned_reranking(spark, d):
    """The reranker trained on every other known-item question, on the rest: five documents each, their former places, and whether they are relevant."""
    asked, found, relevant, index = known_item_lists(spark, d)
    model = learned.LearnedReranker.trained(asked.where("query_id % 40 = 0"), found.where("query_id % 40 = 0"), relevant, index)
    ranked = model(asked.where("query_id % 40 = 20"), found.where("query_id % 40 = 20"), 5).drop("text", "source")
    before = found.select("query_id", "doc_id", F.col("rank").alias("fused_rank"))
    good = relevant.distinct().withColumn("relevant", F.lit(True))
    out = ranked.join(before, ["query_id", "doc_id"]).join(good, ["query_id", "doc_id"], "left")
    return out.withColumn("relevant", F.coalesce("relevant", F.lit(False)))


@query(f"""WITH r AS ({dense_sql(COS, 5)}), g AS (SELECT query_id, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM r GROUP BY 1)
SELECT *, max_score < 0.5 OR mean_score < 0.3 AS abstain FROM g""")
def relevance_gate(spark, d):
    """R16."""
    return retrieval.gate(retrieval.dense_topk(vectors_asked(spark, d), vectors(spark, d), 5))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events""")
def request_rates(spark, d):
    """R13, analytically, over an hour."""
    return retrieval.requests_in_window(table(spark, d, "events"), 3600).select("event_id", "recent")


def judged_hits(spark, d):
    """For every vector whose id is divisible by 20: its ten nearest of all vectors, those of them with its label, and how many vectors have it."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    hits = retrieval.dense_topk(vectors_asked(spark, d), vectors(spark, d), 10)
    own = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("wanted"))
    rows = hits.join(labels, "doc_id").join(own, "query_id")
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id"), (F.col("label") == F.col("wanted")).alias("hit"))))
    rows = rows.groupBy("query_id", "wanted").agg(listed.alias("l"))
    counts = labels.groupBy(F.col("label").alias("wanted")).agg(F.count("*").alias("n_relevant"))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    return rows.join(counts, "wanted").select("query_id", "n_relevant", ids(F.col("l")).alias("retrieved"), ids(F.filter("l", lambda x: x["hit"])).alias("relevant"))


JUDGED = f"""ranked AS ({dense_sql(COS, 10, "q.vec_id % 20 = 0")}),
judged AS (SELECT r.query_id, r.doc_id, r.rank + 1 AS pos, (a.label = b.label)::INT AS rel, (SELECT count(*) FROM embeddings e WHERE e.label = a.label) AS n_rel
    FROM ranked r JOIN embeddings a ON a.vec_id = r.query_id JOIN embeddings b ON b.vec_id = r.doc_id)"""


@query(f"""WITH {JUDGED}, m AS (SELECT query_id, sum(rel) / 10.0::DOUBLE AS p, sum(rel)::DOUBLE / max(n_rel) AS r, sum(rel) FILTER (WHERE pos <= 5) / 5.0::DOUBLE AS p5, (sum(rel) FILTER (WHERE pos <= 5))::DOUBLE / max(n_rel) AS r5,
    max(rel) FILTER (WHERE pos <= 5)::DOUBLE AS hit, coalesce(1.0::DOUBLE / min(pos) FILTER (WHERE rel = 1 AND pos <= 5), 0) AS mrr,
    sum(rel / log2(pos + 1)) FILTER (WHERE pos <= 5) / (SELECT sum(1 / log2(x.i + 1)) FROM (SELECT unnest(range(1, 6)) AS i) x WHERE x.i <= least(5, any_value(n_rel))) AS ndcg FROM judged GROUP BY 1),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(0.3::DOUBLE * p + 0.4::DOUBLE * r + 0.3::DOUBLE * f1, 6) AS retrieval_score, round(p5, 6) AS precision_at_5, round(r5, 6) AS recall_at_5,
    hit AS hit_rate_at_5, round(mrr, 6) AS mrr_at_5, round(ndcg, 6) AS ndcg_at_5 FROM f""")
def retrieval_metrics(spark, d):
    """E1-E5, E9, E10."""
    out = evaluation.hit_metrics(judged_hits(spark, d))
    names = ["precision", "recall", "f1", "retrieval_score", "precision_at_5", "recall_at_5", "hit_rate_at_5", "mrr_at_5", "ndcg_at_5"]
    return out.select("query_id", *[F.round(n, 6).alias(n) for n in names])


@query(f"""WITH {JUDGED}, m AS (SELECT query_id, sum(rel) / 10.0::DOUBLE AS p, coalesce(1.0::DOUBLE / min(pos) FILTER (WHERE rel = 1 AND pos <= 5), 0) AS mrr FROM judged GROUP BY 1)
SELECT count(*) AS questions, round(avg(p), 6) AS average_precision, round(avg(mrr), 6) AS average_mrr_at_5 FROM m""")
def retrieval_averages(spark, d):
    """E11."""
    out = evaluation.aggregate_retrieval(evaluation.hit_metrics(judged_hits(spark, d)))
    return out.select("questions", F.round("average_precision", 6).alias("average_precision"), F.round("average_mrr_at_5", 6).alias("average_mrr_at_5"))


def reranked_hits(spark, d):
    return judged_hits(spark, d).select("query_id", "n_relevant", "relevant", F.col("retrieved").alias("before"), F.reverse("retrieved").alias("after"), (F.col("query_id") * 10.0).alias("latency_ms"))


RERANKED = f"""{JUDGED}, b AS (SELECT query_id, coalesce(1.0::DOUBLE / min(pos) FILTER (WHERE rel = 1 AND pos <= 5), 0) AS mrr_before, coalesce(1.0::DOUBLE / min(11 - pos) FILTER (WHERE rel = 1 AND pos > 5), 0) AS mrr_after,
    sum(rel / log2(pos + 1)) FILTER (WHERE pos <= 5) AS d0, sum(rel / log2(12 - pos)) FILTER (WHERE pos > 5) AS d1, (SELECT sum(1 / log2(x.i + 1)) FROM (SELECT unnest(range(1, 6)) AS i) x WHERE x.i <= least(5, any_value(n_rel))) AS ideal,
    avg(pos - (11 - pos)) FILTER (WHERE rel = 1) AS moved, (count(*) FILTER (WHERE rel = 1 AND pos >= 10))::INT AS promoted_from_deep, query_id * 10.0::DOUBLE AS ms FROM judged GROUP BY 1),
z AS (SELECT query_id, mrr_after - mrr_before AS mrr_lift, (d1 - d0) / ideal AS ndcg_lift, moved, promoted_from_deep, ms FROM b)"""


@query(f"""WITH {RERANKED} SELECT query_id, round(mrr_lift, 6) AS mrr_lift, round(ndcg_lift, 6) AS ndcg_lift, round(moved, 6) AS avg_position_change, promoted_from_deep,
    round(CASE WHEN ms > 0 THEN (mrr_lift + ndcg_lift) / (ms / 1000) END, 6) AS roi FROM z""")
def reranker_metrics(spark, d):
    """E6-E8, with the reversed list as the reranked one."""
    out = evaluation.hit_reranker_metrics(reranked_hits(spark, d))
    return out.select("query_id", F.round("mrr_lift", 6).alias("mrr_lift"), F.round("ndcg_lift", 6).alias("ndcg_lift"), F.round("avg_position_change", 6).alias("avg_position_change"), "promoted_from_deep", F.round("roi", 6).alias("roi"))


@query(f"""WITH {RERANKED} SELECT round(avg(mrr_lift), 6) AS mrr_lift, round(quantile_cont(ms, 0.99), 6) AS p99_ms, sum(promoted_from_deep)::BIGINT AS promoted, avg(mrr_lift) > 0.05 AS meets_mrr, quantile_cont(ms, 0.99) < 500 AS meets_latency FROM z""")
def reranker_averages(spark, d):
    """E11."""
    out = evaluation.aggregate_reranker(evaluation.hit_reranker_metrics(reranked_hits(spark, d)))
    return out.select(F.round("mrr_lift", 6).alias("mrr_lift"), F.round("p99_ms", 6).alias("p99_ms"), F.col("promoted_from_deep").alias("promoted"), "meets_mrr", "meets_latency")


def answers(spark, d):
    """Each assistant turn with the turn before it as its reference."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    r = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    kind = F.when(F.col("turn") % 3 == 0, "hallucination").otherwise("factual")
    return a.join(r, ["conv_id", "turn"]).withColumn("question_type", kind).withColumn("similarity", (F.col("conv_id") % 10) / 10.0).withColumn("relevance", (F.col("turn") % 5) / 5.0)


WORDS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> '')"
ANSWERS = f"""x AS (SELECT a.conv_id, a.turn, a.text AS answer, r.text AS reference, CASE WHEN a.turn % 3 = 0 THEN 'hallucination' ELSE 'factual' END AS question_type, (a.conv_id % 10) / 10.0::DOUBLE AS similarity, (a.turn % 5) / 5.0::DOUBLE AS relevance,
    {WORDS.format('a.text')} AS g, {WORDS.format('r.text')} AS w FROM conversations a JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn - 1 WHERE a.role = 'assistant'),
m AS (SELECT *, CASE WHEN len(w) = 0 THEN (len(g) = 0)::INT::DOUBLE ELSE len(list_intersect(list_distinct(g), list_distinct(w)))::DOUBLE / len(list_distinct(w)) END AS bleu,
    CASE WHEN len(w) = 0 THEN (len(g) = 0)::INT::DOUBLE ELSE len(list_filter(w, lambda t: list_contains(g, t)))::DOUBLE / len(w) END AS rouge,
    CASE WHEN greatest(length(answer), length(reference)) = 0 THEN 0 ELSE least(length(answer), length(reference))::DOUBLE / greatest(length(answer), length(reference)) END AS ratio,
    CASE WHEN question_type = 'hallucination' AND NOT {sql_any('answer', T.REFUSALS)} THEN 0.0::DOUBLE ELSE 1 END AS hall FROM x),
s AS (SELECT *, CASE WHEN question_type = 'hallucination' THEN hall ELSE 0.25::DOUBLE * bleu + 0.25::DOUBLE * rouge + 0.35::DOUBLE * similarity + 0.15::DOUBLE * ratio END AS score FROM m)"""


@query(f"""WITH {ANSWERS} SELECT conv_id, turn, round(bleu, 6) AS bleu, round(rouge, 6) AS rouge, round(ratio, 6) AS length_ratio, hall AS hallucination_score, round(score, 6) AS generation_score FROM s""")
def generation_metrics(spark, d):
    """E12, E13, E15-E17."""
    out = evaluation.generation_metrics(answers(spark, d))
    return out.select("conv_id", "turn", F.round("bleu", 6).alias("bleu"), F.round("rouge", 6).alias("rouge"), F.round("length_ratio", 6).alias("length_ratio"), "hallucination_score", F.round("generation_score", 6).alias("generation_score"))


@query(f"""WITH {ANSWERS} SELECT question_type, count(*) AS count, round(avg(score), 6) AS average_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score FROM s GROUP BY 1""")
def score_breakdown(spark, d):
    """E23, E24."""
    rows = evaluation.generation_metrics(answers(spark, d)).withColumn("e2e_score", F.lit(None).cast("double"))
    out = evaluation.breakdown(rows, "question_type")
    return out.select("question_type", "count", *[F.round(c, 6).alias(c) for c in ("average_score", "min_score", "max_score")])


@query(r"""WITH x AS (SELECT a.conv_id, a.turn, a.text AS answer, r.text AS reference, (a.conv_id % 10) / 10.0::DOUBLE AS similarity, (a.turn % 5) / 5.0::DOUBLE AS relevance FROM conversations a JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn - 1 WHERE a.role = 'assistant'),
w AS (SELECT *, regexp_replace(answer, '[^\p{L}\p{N}_]+', '  ', 'g') AS a2, regexp_replace(reference, '[^\p{L}\p{N}_]+', '  ', 'g') AS r2 FROM x),
f AS (SELECT *, list_distinct(regexp_extract_all(answer, '\d+(?:\.\d+)?')) AS an, list_distinct(regexp_extract_all(reference, '\d+(?:\.\d+)?')) AS rn,
    list_distinct(list_filter(string_split(a2, '  '), lambda t: regexp_full_match(t, '[A-Z][a-z]+'))) AS ap, list_distinct(list_filter(string_split(r2, '  '), lambda t: regexp_full_match(t, '[A-Z][a-z]+'))) AS rp FROM w),
c AS (SELECT *, CASE WHEN trim(answer) = '' THEN 0 WHEN len(rn) + len(rp) = 0 THEN 1 ELSE (len(list_intersect(an, rn)) + len(list_intersect(ap, rp)))::DOUBLE / (len(rn) + len(rp)) END AS fact FROM f)
SELECT conv_id, turn, round(fact, 6) AS factual_consistency, round(CASE WHEN trim(answer) = '' THEN 0 ELSE 0.5::DOUBLE * similarity + 0.3::DOUBLE * fact + 0.2::DOUBLE * relevance END, 6) AS e2e_score FROM c""")
def end_to_end_metrics(spark, d):
    """E21, E22."""
    out = evaluation.end_to_end(answers(spark, d))
    return out.select("conv_id", "turn", F.round("factual_consistency", 6).alias("factual_consistency"), F.round("e2e_score", 6).alias("e2e_score"))


@query()
def judge_metrics(spark, d):
    """E18-E20 by the offline judge: each assistant turn, with the turn before it as question and context."""
    rows = answers(spark, d).select("conv_id", "turn", F.col("reference").alias("question"), "answer", F.array("reference").alias("contexts"), F.lit("").alias("ground_truth"), (F.col("question_type") == "hallucination").alias("unanswerable"))
    names = ["faithfulness", "answer_relevance", "completeness", "abstention_quality", "generation_score_v2"]
    return evaluation.judge_metrics(rows).select("conv_id", "turn", *[F.round(n, 6).alias(n) for n in names])


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {sql_any('text', T.ABSTENTIONS)}::INT::DOUBLE WHEN {sql_any('text', T.ABSTENTIONS)} THEN 0.0 ELSE 1.0 END AS abstention_quality,
    round(0.40::DOUBLE * (turn % 5) / 5 + 0.35::DOUBLE * (conv_id % 7) / 7 + 0.20::DOUBLE * (turn % 3) / 3 + 0.05::DOUBLE, 4) AS composite,
    round(CASE WHEN turn % 5 > 0 OR conv_id % 7 > 0 THEN 0.30::DOUBLE * 0.5 + 0.40::DOUBLE * (0.40::DOUBLE * (turn % 5) / 5 + 0.30::DOUBLE * (conv_id % 7) / 7 + 0.30::DOUBLE * (turn % 3) / 3) + 0.30::DOUBLE * 0.25
        ELSE 0.25::DOUBLE * 0.5 + 0.25::DOUBLE * 0.75 + 0.50::DOUBLE * 0.25 END, 4) AS overall FROM conversations""")
def composite_scores(spark, d):
    """E19, E20, E25."""
    f, r, c = (F.col("turn") % 5) / 5, (F.col("conv_id") % 7) / 7, (F.col("turn") % 3) / 3
    whole = evaluation.overall({"retrieval": F.lit(0.5), "generation": F.lit(0.75), "e2e": F.lit(0.25), "faithfulness": f, "relevance": r, "completeness": c})
    return table(spark, d, "conversations").select(
        "conv_id", "turn", evaluation.abstention(F.col("turn") % 2 == 0, F.col("text")).alias("abstention_quality"), evaluation.composite(f, r, c, F.lit(1.0)).alias("composite"), whole.alias("overall")
    )


@query("""WITH s AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round((c + 1) / 2, 6) AS similarity FROM s""")
def semantic_similarity(spark, d):
    """E14."""
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(evaluation.semantic(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("SELECT conv_id, turn, round(avg(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 6) AS running FROM conversations")
def running_evaluation(spark, d):
    """Prefix means within each run, with conversations as runs."""
    rows = table(spark, d, "conversations").withColumn("score", F.length("text"))
    return evaluation.running_means(rows, ["score"], "turn", "conv_id").select("conv_id", "turn", F.round("running_score", 6).alias("running"))


def chunk_rows(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


@query("""SELECT doc_id AS chunk_id, 'asset ' || source AS asset_name FROM documents WHERE doc_id % 2 = 0""")
def project_chunks(spark, d):
    """D1."""
    docs = table(spark, d, "documents")
    assets = docs.select("source").distinct().select(F.col("source").alias("asset_id"), F.concat(F.lit("asset "), F.col("source")).alias("asset_name"))
    rows = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("chunk_asset_id"), (F.col("doc_id") % 2).alias("chunk_project_id"))
    return datasets.project_chunks(rows, assets, 0).select("chunk_id", "asset_name")


@query("SELECT doc_id AS id FROM documents WHERE length(trim(text)) >= 50 ORDER BY md5('0:' || doc_id), doc_id LIMIT 30")
def sampled_chunks(spark, d):
    """D2 (30 is the sample's size)."""
    return datasets.sample(chunk_rows(spark, d), 30).select("id")


@query("""WITH r AS (SELECT doc_id AS id, source, md5('2:' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY md5('2:' || doc_id), doc_id) AS i, dense_rank() OVER (ORDER BY source) - 1 AS s FROM documents),
n AS (SELECT max(s) + 1 AS n FROM r)
SELECT a.id AS id_a, b.id AS id_b, a.source AS source_a, b.source AS source_b FROM r a, n JOIN r b ON b.s = (a.s + 1) % n.n AND b.i = a.i ORDER BY a.h, a.id LIMIT 20""")
def comparative_pairs(spark, d):
    """D3 (20 is the number asked for)."""
    return datasets.comparative_pairs(chunk_rows(spark, d), 20, 2).select("id_a", "id_b", "source_a", "source_b")


@query("""WITH r AS (SELECT doc_id AS id, substr(text, 1, 500) AS text, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) - 1 AS i FROM documents WHERE length(text) > 30)
SELECT i // 5 AS set_id, list(id ORDER BY i) AS ids, md5(string_agg(text, '|' ORDER BY i)) AS digest FROM r WHERE i < 50 GROUP BY 1""")
def summary_sets(spark, d):
    """D4 (10 sets are asked for)."""
    return datasets.summary_sets(chunk_rows(spark, d), 10, 3).select("set_id", "ids", F.md5(F.array_join("texts", "|").cast("binary")).alias("digest"))


@query("SELECT doc_id AS id, substr(text, 1, 1000) AS text, CASE " + " ".join(f"WHEN {sql_any('text', w)} THEN '{n}'" for n, w in T.DOMAINS.items()) + " ELSE 'General' END AS domain FROM documents ORDER BY md5('4:' || doc_id), doc_id LIMIT 10")
def unanswerable_seeds(spark, d):
    """D5 (10 are asked for)."""
    return datasets.unanswerable(chunk_rows(spark, d), 10, 4).select("id", "text", "domain")


def questions(spark, d):
    kinds = F.array(*[F.lit(x) for x in datasets.QUESTION_TYPES[:4]])
    b = table(spark, d, "benchmark")
    return b.select(
        F.col("item_id").alias("id"), F.col("text").alias("question"), F.col("text").alias("reference_answer"), F.element_at(kinds, (F.col("item_id") % 4 + 1).cast("int")).alias("question_type"),
        F.when(F.col("item_id") % 2 == 0, "easy").otherwise("hard").alias("difficulty"), F.lit("en").alias("language"), F.array(F.col("item_id").cast("string")).alias("source_chunks"), F.array(F.lit("d")).alias("source_documents"),
    )


@query("""WITH q AS (SELECT item_id AS id, text AS query, row_number() OVER (ORDER BY item_id) - 1 AS q FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 50)),
c AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id::VARCHAR) - 1 AS i FROM documents)
SELECT id, query, coalesce(list(doc_id::VARCHAR ORDER BY i) FILTER (WHERE doc_id <> id), [])[1:5] AS irrelevant_chunks FROM q LEFT JOIN c ON c.i // 10 = q.q GROUP BY 1, 2""")
def retrieval_examples(spark, d):
    """D6."""
    return datasets.retrieval_examples(questions(spark, d), chunk_rows(spark, d)).select("id", "query", "irrelevant_chunks")


@query("""SELECT kind, name, value::DOUBLE AS value FROM (
SELECT 'type' AS kind, t AS name, (SELECT count(*) FROM benchmark WHERE item_id % 4 = n) AS value FROM (SELECT unnest(['factual', 'analytical', 'comparative', 'summarization', 'hallucination']) AS t, unnest(range(5)) AS n)
UNION ALL SELECT 'difficulty', 'easy', count(*) FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'difficulty', 'medium', 0 UNION ALL SELECT 'difficulty', 'hard', count(*) FROM benchmark WHERE item_id % 2 = 1
UNION ALL SELECT 'language', 'en', count(*) FROM benchmark UNION ALL SELECT 'total', 'total_questions', count(*) FROM benchmark UNION ALL SELECT 'total', 'average_answer_length', avg(length(text)) FROM benchmark
UNION ALL SELECT 'total', 'unique_source_documents', 1 UNION ALL SELECT 'total', 'unique_chunks_used', count(DISTINCT item_id) FROM benchmark)""")
def dataset_statistics(spark, d):
    """D7."""
    return datasets.statistics(questions(spark, d))


@query()
def dataset_seeds(spark, d):
    """D8."""
    return datasets.seeds(chunk_rows(spark, d)).select("question_type", "ids")


STATES = {
    "docs": "(conv_id + turn) % 3", "answer": "CASE WHEN (conv_id + 2 * turn) % 5 = 0 THEN ' ' WHEN turn % 7 = 6 THEN NULL ELSE text END", "iterations": "CAST(length(text) % 2 AS INT)",
    "agentic": "role = 'user' OR conv_id % 4 = 0", "need": "length(text) % 3 < 2", "agentic_iterations": "CAST(conv_id % 3 AS INT)", "sources": "1 + length(text) % 3",
    "hall": "CASE length(text) % 5 WHEN 0 THEN 'no' WHEN 1 THEN NULL ELSE 'yes' END", "qual": "CASE (conv_id + length(text)) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'no' WHEN 2 THEN 'no' ELSE 'yes' END",
}
STATE_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in STATES.items())
AUDIT = "coalesce(trim(answer), '') = '' OR docs = 0"


@query(f"""SELECT *, CASE WHEN audit = 'rewrite' THEN 'rewrite_query' ELSE 'end' END AS next FROM (
    SELECT conv_id, turn, CASE WHEN docs = 0 AND iterations < 1 THEN 'rewrite_query' ELSE 'generate' END AS grading, CASE WHEN coalesce(trim(answer), '') = '' THEN 'end' WHEN agentic AND sources <= 1 THEN 'evaluate_context' ELSE 'audit_answer' END AS generation,
    CASE WHEN agentic AND need AND agentic_iterations < 2 AND sources < 3 THEN 'route_source' ELSE 'audit_answer' END AS evaluation,
    CASE WHEN {AUDIT} THEN 'end' WHEN coalesce(hall, '') = 'no' THEN CASE WHEN iterations >= 1 THEN 'end' ELSE 'rewrite' END WHEN qual IS NULL OR qual = 'yes' OR iterations >= 1 THEN 'end' ELSE 'rewrite' END AS audit
    FROM (SELECT conv_id, turn, {STATE_COLUMNS} FROM conversations))""")
def graph_routes(spark, d):
    """What the routers say of states that turns of conversations stand for: a turn's text is the answer, and its numbers and length give the rest."""
    c = F.col
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", *[f"{e} AS {n}" for n, e in STATES.items()])
    rows = rows.select(
        "conv_id", "turn", graph.after_grading(c("docs"), c("iterations")).alias("grading"), graph.after_generation(c("answer"), c("agentic"), c("sources")).alias("generation"),
        graph.after_evaluation(c("agentic"), c("need"), c("agentic_iterations"), c("sources")).alias("evaluation"), graph.audit(c("answer"), c("docs"), c("iterations"), c("hall"), c("qual")).alias("audit"),
    )
    return rows.withColumn("next", graph.after_audit(c("audit")))


@query()
def fetch_records(spark, d):
    """For each user turn, whether the turn before it suffices, and what another source gives if not."""
    rows = answers(spark, d).select("conv_id", "turn", F.col("reference").alias("question"), F.col("answer").alias("context"), F.lit("").alias("answer"), F.array(F.lit("vector_db")).alias("sources_tried"))
    return graph.route_and_fetch(rows).select("conv_id", "turn", "need_more", "source", "reason", F.md5(F.col("data").cast("binary")).alias("digest"), "success")


@query()
def answered_questions(spark, d):
    """All benchmark items answered over documents by the offline providers."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("factual").alias("question_type"))
    docs = corpus(spark, d)
    index = retrieval.Bm25(docs)
    find = lambda a: index.search(a, 5).join(docs, "doc_id")
    return graph.answer(q, find, agentic=True)
