"""Edge cases and properties of the package's own operators."""

import hashlib
import io
import os
import re
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone import registry
from marlstone.functions import text as T
from marlstone.operators import chunking, evaluation, retrieval
from marlstone.plans import graph
from marlstone.plans.engine import Engine
from marlstone.plans.providers import KeyRing, LexicalReranker, RateLimiter, web_text
from marlstone.sources import loaders, store
from marlstone.sources.html import main_text


def one(spark, expression, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()] or [F.lit(1).alias("_")]).select(expression).first()[0]


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.col("t")), t="éa\x07b  \t c\n\n\n\nd ") == "éa b c\n\nd"
    assert one(spark, T.clean_text(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(("t", "hint"), [("", "unknown"), ("123", "unknown"), ("مرحبا بالعالم", "arabic"), ("hello", "english"), ("مرحبا hello", "mixed")])
def test_language(spark, t, hint):
    assert one(spark, T.language_hint(F.col("t")), t=t) == hint


@pytest.mark.parametrize(("reply", "want"), [('["a b", " c "]', ["a b", "c"]), ('```json\n["x"]\n```', ["x"]), ("so: [\"y\"] ok", ["y"]), ("1. first one\n- no\n2) second one", ["first one", "second one"]), ("", [])])
def test_parsed_list(spark, reply, want):
    assert one(spark, T.parsed_list(F.col("t")), t=reply) == want


@pytest.mark.parametrize(("reply", "want"), [('{"score": 1.7}', 1.0), ('{"score": 0.4}', 0.4), ("score 0.25", 0.25), ("bad", 0.0), ("", 0.0)])
def test_judge_score(spark, reply, want):
    assert one(spark, T.judge_score(F.col("t")), t=reply) == want


@pytest.mark.parametrize(("t", "want"), [("Article 5 Scope\nx", "Article 5 Scope"), ("a1\n1.2.3. Title here\ny", "1.2.3. Title here"), ("z9\nALL CAPS\nw", "ALL CAPS"), ("no 1 here.", "")])
def test_heading(spark, t, want):
    assert one(spark, T.heading(F.col("t")), t=t) == want


def test_sentences_respect_abbreviations_and_fragments():
    assert chunking.sentences("Dr. Smith came home late. It was raining hard. Yes.", "english") == ["Dr. Smith came home late.", "It was raining hard.", "Yes."]
    assert chunking.sentences("This is a sentence. no. Then another one.", "english") == ["This is a sentence. no.", "Then another one."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ,.", min_size=1, max_size=60), max_size=12))
def test_packing_keeps_all_words(parts):
    parts = [p.strip() for p in parts if p.strip()]
    joined = " ".join(chunking.packed(parts, 50, 0 or 10)).split()
    assert set(" ".join(parts).split()) <= set(joined)


def test_long_sentence_is_halved_once():
    assert chunking.halves("aaaa, bbbb cccc", 5) == ["aaaa,", "bbbb cccc"]
    assert chunking.packed(["x" * 30], 10, 5) == ["x" * 30]


def test_images_between_sections():
    image = lambda i: {"image_index": i, "image_text": f"t{i}", "source_type": "pdf_embedded_image"}
    assert chunking.merged("a\n\nb", [image(2), image(1)]) == "a\n\n[Image 1: t1]\n\nb\n\n[Image 2: t2]"
    assert chunking.merged("a\n\nb\n\nc\n\nd", [image(1)]) == "a\n\nb\n\n[Image 1: t1]\n\nc\n\nd"
    assert "[Image 7: t7]" in chunking.merged("plain words", [image(7)])


def test_duplicate_chunks_stay_once_per_run(spark):
    line = "the same sentence that is long enough to be kept as a chunk of its own"
    rows = spark.createDataFrame([(1, line, "english", "a"), (2, line, "english", "a"), (3, line, "english", "b")], "seq long, text string, language string, run string")
    assert chunking.chunks(rows).count() == 1
    assert chunking.chunks(rows, run="run").count() == 2


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id long, list_id int, rank int, doc_id long, text string, score double")


def test_fusion(spark):
    out = retrieval.rrf(lists(spark, [(1, 0, 0, 10, "a", 0.0), (1, 0, 1, 11, "b", 0.0), (1, 1, 0, 12, "b", 0.0), (2, 0, 0, 13, "x", 0.0), (2, 0, 1, 14, "x", 0.0)])).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in out] == [(1, 11), (1, 10), (2, 13), (2, 14)]
    with pytest.raises(ValueError):
        retrieval.rrf(lists(spark, []), k=0)


def test_dense_without_queries_or_with_nulls(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.doc_id, r.score) for r in retrieval.dense_topk(q, v).collect()] == [(1, 1.0)]
    assert retrieval.dense_topk(q.limit(0), v).count() == 0


def test_bm25_ignores_blank_queries(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, None), (4, "green hen")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red"), (2, " "), (3, None)], "query_id long, text string")
    assert [(r.query_id, r.doc_id) for r in retrieval.bm25_topk(q, docs).collect()] == [(1, 1)]


def test_retrieval_metrics_edges(spark):
    rows = spark.createDataFrame([(1, [], []), (2, ["a"], []), (3, [], ["a"]), (4, ["a", "b"], ["x", "a", "y", "z", "w", "b"])], "id int, relevant array<string>, retrieved array<string>")
    r = {x.id: x for x in evaluation.retrieval_metrics(rows).collect()}
    assert (r[1].precision, r[1].recall, r[2].recall, r[3].recall) == (0.0, 1.0, 0.0, 0.0)
    assert (r[4].mrr_at_5, r[4].precision_at_5, r[4].recall) == (0.5, 0.2, 1.0)
    assert 0 <= r[4].ndcg_at_5 <= 1


def test_overlap_metrics_edges(spark):
    assert one(spark, evaluation.bleu(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, evaluation.rouge(F.lit("a b"), F.lit("a a c"))) == pytest.approx(2 / 3)
    assert one(spark, evaluation.factual(F.lit("x"), F.lit("no facts"))) == 1.0


def test_upload_and_names(spark):
    assert one(spark, store.upload_signal(F.lit("image/gif"), F.lit(1))) == "file_type_not_supported"
    assert one(spark, store.stored_name(F.lit(" a b-ç.txt "), F.lit("0123456789abcdef"))) == "0123456789ab_abç.txt"


def test_collections(spark, tmp_path):
    c = store.Collections(spark, f"file://{tmp_path}/c")
    name = c.name(2, 1)
    assert c.create(name, 2) and not c.create(name, 2) and c.all() == [name]
    c.insert(name, spark.createDataFrame([(1, "t", [1.0, 0.0], None, 1)], "id long, text string, vector array<double>, metadata string, chunk_id long"), 2)
    assert c.info(name)["rows"] == 1
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert c.search(name, q).first().score == 1.0
    assert c.delete(name) and not c.exists(name)


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xe9  \n\n\n\nx")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "c.docx").write_bytes(b"broken")
    files = loaders.files(spark, f"file://{tmp_path}")
    kind = loaders.loader_of(F.col("path"))
    texts = loaders.text_documents(files.where(kind == "text")).collect()
    assert [(r.text, r.encoding) for r in texts] == [("café\n\nx", "cp1252")] or texts[0].text.startswith("café")
    assert [r.text for r in loaders.office_documents(files.where(kind == "word")).collect()] == ["Hello\na | b"]
    assert io.BytesIO(b"").read() == b""


def test_html():
    assert main_text("<body><nav>n</nav><main>m<article>a &amp; b<script>x</script></article></main></body>").split("\n") == ["a & b"]
    assert main_text("<p>plain") == "plain"


def test_references_without_semicolon_are_text():
    assert main_text("<article><h1>one&amp;&amp</h1>&lt;x&gt &ampcopy; &#39;&#39 &nosuch; &copy;&am</article>") == "one&&amp\n<x&gt &ampcopy; '&#39 &nosuch; ©&am"


def test_providers():
    keys = KeyRing(["a", "", "b"])
    assert (keys.current(), keys.advance(), keys.advance()) == ("a", "b", None)
    limiter = RateLimiter(2, 10.0)
    assert [limiter.wait(t) for t in (0.0, 1.0)] == [0.0, 0.0] and limiter.wait(2.0) == pytest.approx(8.1)
    assert web_text([{"title": "t", "snippet": "s"}], "x") == "[Web Search Results — x]\n\n**t**\ns"
    assert LexicalReranker().score(["a b"], ["aa bb"]) == [0.0]


def test_engine_end_to_end(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/root")
    docs = spark.createDataFrame([(1, "Sensors measure temperature in the cold greenhouse every single hour. " * 3, "english"), (2, "Contracts are signed by both of the parties before any work begins. " * 3, "english")], "seq long, text string, language string")
    chunks = e.ingest(docs, 200, 20).withColumn("chunk_id", F.col("seq") * 100 + F.col("chunk_index"))
    e.index(chunks, 1)
    q = spark.createDataFrame([(1, "who signed the contracts")], "query_id long, text string")
    assert e.search(q, 1, 1).first().doc_id // 100 == 2
    got = e.answer(q.select("query_id", F.col("text").alias("question"), F.lit("factual").alias("question_type")), 1).first()
    assert "Contracts" in got.answer or got.answer == graph.NO_CONTEXT


# --- queries over whole tables, which have no SQL ---

DATA = "/root/testdata/sf0.001"
whole = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def nearest(v, q, k, score):
    """Brute-force (query, rank) -> (id, score), of ids and vectors."""
    out = {}
    for i in q:
        for rank, (s, j) in enumerate(sorted((-round(float(score(v[i], x)), 6), j) for j, x in v.items())[:k]):
            out[i, rank] = (j, round(-s, 5) + 0.0)
    return out


@whole
def test_searches_ask_every_twentieth_id(spark):
    queries = registry.queries()
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = {i for i in v if i % 20 == 0}
    scores = {"cosine": lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b)), "dot": lambda a, b: a @ b, "euclidean": lambda a, b: -np.sqrt(((a - b) ** 2).sum())}
    for name, score in scores.items():
        got = {(r.query_id, r.rank): r for r in queries[f"dense_{name}"](spark, DATA).collect()}
        want = nearest(v, ids, 10, score)
        assert got.keys() == want.keys() and len({i for i, _ in got}) == len(ids) > 20
        assert all(abs(got[k].score - want[k][1]) < 2e-5 for k in want)
        assert sum(got[k].doc_id != want[k][0] for k in want) <= 0.01 * len(want)  # ties after rounding
    assert {r.query_id for r in queries["relevance_gate"](spark, DATA).collect()} == ids
    for name in ("hybrid_lists", "hybrid_search", "advanced_retrieval", "reranked_search"):
        assert {r.query_id for r in queries[name](spark, DATA).collect()} == ids & docs, name


@whole
def test_all_benchmark_items_are_answered(spark):
    items = {r.item_id for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert {r.query_id for r in registry.queries()["answered_questions"](spark, DATA).collect()} == items


@whole
def test_metrics_over_all_vectors_equal_those_of_whole_lists(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    label = {r.vec_id: r.label for r in rows}
    hits = {}
    for r in registry.queries()["dense_cosine"](spark, DATA).orderBy("rank").collect():
        hits.setdefault(r.query_id, []).append(str(r.doc_id))
    lists = [(i, [str(j) for j in label if label[j] == label[i]], h, h[::-1], i * 10.0) for i, h in hits.items()]
    assert len(lists) == sum(i % 20 == 0 for i in label)
    frame = spark.createDataFrame(lists, "query_id long, relevant array<string>, retrieved array<string>, after array<string>, latency_ms double")
    cases = {"retrieval_metrics": evaluation.retrieval_metrics(frame), "reranker_metrics": evaluation.reranker_metrics(frame.withColumnRenamed("retrieved", "before"))}
    for name, want in cases.items():
        got = registry.queries()[name](spark, DATA)
        plain = lambda df: {r.query_id: [None if x is None else round(x, 5) for x in r[1:]] for r in df.select(*got.columns).collect()}
        a, b = plain(got), plain(want)
        assert a.keys() == b.keys() and all(x == y or abs(x - y) < 2e-5 for i in a for x, y in zip(a[i], b[i], strict=True))
    for name in ("retrieval_averages", "reranker_averages"):
        assert registry.queries()[name](spark, DATA).count() == 1
    assert registry.queries()["retrieval_averages"](spark, DATA).first().questions == len(lists)


@whole
def test_texts_are_used_whole(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert max(map(len, docs.values())) > 400
    got = {r.doc_id: r for r in registry.queries()["process_text"](spark, DATA).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        long = text * (1 + 22000 // max(1, len(text)))
        assert got[i].plain == long[:20000].strip() and got[i].prompt == (long[:14000] + T.MIDDLE_CUT + long[-6000:]).strip()
    pages = {}
    for i in sorted(docs):
        pages.setdefault((f"f{i // 20}", i // 5 % 4 + 1), []).append(i)
    rows = registry.queries()["hybrid_documents"](spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        ids = pages[r.source_path, r.page]
        text = "\n\n".join(docs[i] for i in ids if i % 3)
        assert r.digest == hashlib.md5(text.strip().encode()).hexdigest() and list(r.images) == [i for i in ids if i % 3 == 0]
        assert list(r.marks) == [f"[Image {i}: {docs[i][:297] + '...' if len(docs[i]) > 300 else docs[i]}]" for i in r.images]
    raw = [(i, f"f{i // 20}", i // 5 % 4 + 1, "pdf" if i % 3 else "pdf_embedded_image", i, docs[i], {"language": "english", "from": str(i)}) for i in docs]
    frame = spark.createDataFrame(raw, "seq long, source_path string, page int, source_type string, image_index int, text string, metadata map<string,string>")
    hashes = lambda df: sorted((r.source_path, r.page, r.chunk_index, r.chunk_hash) for r in df.collect())
    assert hashes(registry.queries()["hybrid_chunks"](spark, DATA)) == hashes(chunking.hybrid_chunks(frame))


class FixedJudge:
    def __init__(self, scores):
        self.scores = scores

    def score(self, criterion, question, context, answer, ground_truth):
        if answer == "raises":
            raise RuntimeError("no service")
        if answer == "lengths":
            return {"faithfulness": len(context) / 4000, "completeness": len(context) / 3000, "answer_relevance": len(question + context + ground_truth) / 1000}[criterion]
        return self.scores[criterion]


def test_judge_metrics_clamp_and_fail_to_zero(spark):
    cases = [("q", "fine", ["c"], "g", False), ("q", "raises", ["c"], "g", False), ("q", "", ["c"], "g", True), ("q", "I cannot answer", None, None, True), ("q", "I cannot answer", None, None, False), ("q" * 900, "lengths", ["c" * 2500, "d" * 2500], "g" * 900, True)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, question string, answer string, contexts array<string>, ground_truth string, unanswerable boolean")
    judge = FixedJudge({"faithfulness": 1.7, "answer_relevance": -3, "completeness": 0.5, "abstention_quality": 0.25})
    got = [tuple(r) for r in evaluation.judge_metrics(rows, judge).orderBy("i").select("faithfulness", "answer_relevance", "completeness", "abstention_quality", "generation_score_v2").collect()]
    assert got[:5] == [(1.0, 0.0, 0.5, 1.0, 0.55), (0.0, 0.0, 0.0, 1.0, 0.05), (0.0,) * 5, (1.0, 0.0, 0.5, 1.0, 0.55), (1.0, 0.0, 0.5, 0.25, 0.5125)]
    assert got[5][:3] == (0.5, 0.5, 0.5)  # 2000 and 1500 characters of context, 500 of the question alone


def test_evaluate_has_judge_metrics_of_answers(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    engine.index(spark.createDataFrame([(1, "red apples grow on trees"), (2, "blue whales swim")], "chunk_id long, chunk_text string"), 1)
    asked = spark.createDataFrame([(1, "where do red apples grow", ["1"], "red apples grow on trees")], "query_id long, text string, relevant array<string>, answer string")
    r = engine.evaluate(asked, 1, 1).first()
    assert r.faithfulness == 1.0 and r.answer_relevance == 0.6 and r.completeness == 0.6 and r.generation_score_v2 == 0.78 and r.precision == 1.0


@whole
def test_judge_scores_every_answer(spark):
    got = registry.queries()["judge_metrics"](spark, DATA)
    assert got.count() == registry.queries()["generation_metrics"](spark, DATA).count() > 0
    assert got.where("faithfulness > 0 and faithfulness < 1").count() > 0


@whole
def test_facts_have_the_proper_nouns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in registry.queries()["facts"](spark, DATA).collect()}
    assert got.keys() == docs.keys() and any(r.proper_nouns for r in got.values())
    for i, text in docs.items():
        assert got[i].proper_nouns == sorted({w for w in re.split(r"\W+", text) if re.fullmatch("[A-Z][a-z]+", w)})
        assert got[i].numbers == sorted(set(re.findall(r"\d+(?:\.\d+)?", text)))
