"""PDF text, image preparation, tables, results files, the approximate index, hosted services, prompts and the agent loop."""

import dataclasses
import enum
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone import registry
from marlstone.operators import rerank, retrieval
from marlstone.plans import graph, hosted, prompts
from marlstone.plans.engine import Engine
from marlstone.plans.providers import ExtractiveModel, OverlapJudge
from marlstone.sources import images, loaders, pdf, results, store

DATA = "/root/testdata/sf0.001"
whole = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


# --- PDF ---


def made_pdf(pages, compressed=True, maps=None, packed=False):
    """A file with these content streams; ``maps`` is the body of a ToUnicode map of font F1; ``packed`` puts dictionaries into an object stream."""
    stream = lambda data: (b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(zlib.compress(data)) + zlib.compress(data) if compressed else b"<< /Length %d >>\nstream\n" % len(data) + data) + b"\nendstream"
    n = len(pages)
    dictionaries = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 4 0 R >> >> >>" % (n, b" ".join(b"%d 0 R" % (10 + 2 * k) for k in reversed(range(n))))}
    dictionaries[4] = b"<< /Type /Font /Subtype /Type0 /BaseFont /X %s >>" % (b"/ToUnicode 5 0 R" if maps else b"")
    for k in range(n):
        dictionaries[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
    streams = {11 + 2 * k: stream(p) for k, p in enumerate(pages)} | ({5: stream(maps)} if maps else {})
    if packed:
        bodies = b" ".join(dictionaries.values())
        heads, at = [], 0
        for number, body in dictionaries.items():
            heads.append(b"%d %d" % (number, at))
            at += len(body) + 1
        head = b" ".join(heads) + b" "
        data = zlib.compress(head + bodies)
        streams[90] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(dictionaries), len(head), len(data)) + data + b"\nendstream"
        dictionaries = {}
    out = b"%PDF-1.5\n"
    for number, body in (dictionaries | streams).items():
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


ONE = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(Sp)20(lit)-300(words)] TJ T* (caf\351) Tj ET"
TWO = b"BT /F1 12 Tf (Second page) Tj ET"


@pytest.mark.parametrize("options", [{}, {"compressed": False}, {"packed": True}])
def test_pdf_pages_in_order_of_the_tree(options):
    assert pdf.page_texts(made_pdf([TWO, ONE], **options)) == ["Hello (big) world\nSplit words\ncafé", "Second page"]


def test_pdf_maps_codes_to_text_and_leaves_what_is_encrypted():
    maps = b"2 beginbfchar <0001> <0416> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    assert pdf.page_texts(made_pdf([b"BT /F1 9 Tf <000100100012> Tj <0002> Tj ET"], maps=maps)) == ["ЖACfi"]
    assert pdf.page_texts(made_pdf([ONE]) + b"/Encrypt 9 0 R") == [] and pdf.page_texts(b"no file at all") == []


def test_pdf_documents(spark):
    rows = spark.createDataFrame([("a.pdf", bytearray(made_pdf([ONE, TWO]))), ("b.pdf", bytearray(b"%PDF broken"))], "path string, content binary")
    got = sorted((r.page, r.total_pages, r.text.split("\n")[0], r.needs_ocr) for r in loaders.office_documents(rows).collect())
    assert got == [(1, 2, "Second page", True), (2, 2, "Hello (big) world", False)]


# --- images and tables ---


def lines_image(size=160):
    image = np.full((size, size), 230.0)
    for y in range(30, size - 30, 12):
        image[y : y + 3, 25 : size - 25] = 30
    return image


@pytest.mark.parametrize("degrees", [0.0, 7.0, -12.0])
def test_skew_is_found_and_undone(degrees):
    flat = images.turned(lines_image(), -degrees)
    assert abs(images.skew(flat) - degrees) <= 0.5
    assert abs(images.skew(images.turned(flat, images.skew(flat)))) <= 0.6


def test_threshold_follows_the_light_and_specks_go():
    light = lines_image() * np.linspace(0.35, 1, 160)[None, :]
    speck = light.copy()
    speck[10, 10] = 0
    flat = images.prepared(np.repeat(speck[..., None], 3, axis=2))
    assert flat.dtype == np.uint8 and set(np.unique(flat)) <= {0, 255} and flat[10, 10] == 255
    assert (flat[31, 30:130] == 0).mean() > 0.9 and (flat[37, 30:130] == 255).mean() > 0.9
    assert images.skew(np.full((5, 5), 255.0)) == 0.0


def test_tables_of_pages(spark):
    page = "<table><tr><th>a<th>b</tr><tr><td>1 &amp; 2<td> </tr><tr><td></td><td></td></tr></table><p>x</p><table><tr><td><table><tr><td>in</td></tr></table></td><td>out</td></tr></table><table></table>"
    rows = loaders.page_tables(spark.createDataFrame([(7, page), (8, None), (9, "none")], "page_id long, html string")).orderBy("number").collect()
    assert [r.text for r in rows] == ["[TABLE: page 7, table 1]\na | b\n1 & 2 | ", "[TABLE: page 7, table 2]\n | out", "[TABLE: page 7, table 3]\nin"]


# --- results files ---


class Kind(enum.Enum):
    A = "first"


@dataclasses.dataclass
class Part:
    kind: Kind
    values: list


class Loose:
    def __init__(self):
        self.x, self._hidden = {Kind.A: np.float64(1.5)}, 2


def test_results_round_trip(spark, tmp_path):
    deep = {"part": Part(Kind.A, [float("nan"), np.array([1, 2]), (True, None)]), "loose": Loose(), "set": {2, 1}}
    assert results.plain(deep) == {"part": {"kind": "first", "values": [None, [1, 2], [True, None]]}, "loose": {"x": {"first": 1.5}}, "set": [1, 2]}
    results.write_results(spark, {"timestamp": "now", "overall_score": 0.5, "total_questions": 3, "config": deep}, f"file://{tmp_path}/r")
    r = results.read_results(spark, f"file://{tmp_path}/r").first()
    assert (r.timestamp, r.overall_score, r.total_questions, r.retrieval_metrics) == ("now", 0.5, 3, None) and '"kind":"first"' in r.config


# --- stores ---


def test_assets_and_stores(spark, tmp_path):
    assets = spark.createDataFrame([(1, 5, "x", "file"), (2, 5, "x", "file"), (3, 6, "x", "url")], "asset_id long, asset_project_id long, asset_name string, asset_type string")
    assert store.asset(assets, 5, "x").first().asset_id == 1 and store.asset(assets, 5, "y").count() == 0
    assert [r.asset_id for r in store.project_assets(assets, 6, "url").collect()] == [3]
    rows, pages = store.project_page(spark.range(23).withColumnRenamed("id", "project_id"), 3)
    assert [r.project_id for r in rows.collect()] == [20, 21, 22] and pages == 3
    assert store.vector_store("qdrant", spark, f"file://{tmp_path}", "EUCLID").metric == "euclidean"
    with pytest.raises(NotImplementedError):
        store.vector_store("milvus", spark, "x")
    with pytest.raises(ValueError):
        store.vector_store("other", spark, "x")


@whole
def test_approximate_index_finds_most(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = retrieval.dense_topk(asked, rows, 10)
    index = store.CellIndex(rows)
    found = index.search(asked, 10)
    assert store.CellIndex.recall(found, exact) >= 0.9
    assert index.index.count() == rows.count()
    all_cells = store.CellIndex(rows, probes=16).search(asked, 10)
    assert store.CellIndex.recall(all_cells, exact) == 1.0
    assert registry.queries()["approximate_neighbours"](spark, DATA).where("exact").count() >= 0.9 * exact.count()


def test_search_by_slices_equals_broadcast(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.standard_normal((300, 8)))], "doc_id long, embedding array<float>").repartition(5)
    asked = rows.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    got = lambda: sorted(map(tuple, retrieval.dense_topk(asked, rows, 4).collect()))
    want = got()
    for name, value in (("QUERY_BLOCK", 7), ("PIECE_BYTES", 100), ("HELD_BLOCKS", 2), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(retrieval, name, value)
        assert got() == want


def test_bm25_paths_agree(spark, monkeypatch, tmp_path):
    r = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r.zipf(1.5, 30) % 50)) for i in range(120)], "doc_id long, text string")
    asked = docs.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    got = lambda **o: sorted(map(tuple, retrieval.Bm25(docs, **o).search(asked, 6).collect()))
    want = got()
    assert got(folder=f"file://{tmp_path}/index") == want
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert got() == want


@pytest.mark.parametrize(("share", "added", "scores", "terms"), [(0.0, 1, 64, 40), (2.0, 5, 1 << 22, 40), (0.05, 3, 100, 10**6)])
def test_bm25_in_rounds_with_dense_and_other_words(spark, monkeypatch, share, added, scores, terms):
    """Any mix of dense words, added postings, slices and rounds gives the plain scores; what is sent at once is bounded by the round."""
    import math
    from collections import Counter

    r = np.random.default_rng(5)
    texts = {i: " ".join(f"w{x}" for x in r.zipf(1.3, 25) % 90) for i in range(150)} | {150: None, 151: ""}
    asked = {i: texts[i] for i in range(0, 60, 5)}
    words = {i: (t or "").split() for i, t in texts.items()}
    df, n, mean = Counter(w for ws in words.values() for w in set(ws)), len(words), sum(map(len, words.values())) / len(words)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    want = []
    for q, text in asked.items():
        own = {d: round(sum(c * idf[w] * part(ws.count(w), len(ws)) for w, c in Counter(text.split()).items() if w in ws), 6) for d, ws in words.items()}
        want += [(q, d, k) for k, (d, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:7]) if s > 0]
    for name, value in (("DENSE_SHARE", share), ("ADDED", added), ("SCORES", scores), ("BROADCAST_TERMS", terms)):
        monkeypatch.setattr(retrieval, name, value)
    sent, ask = [], retrieval.Bm25._by_lookup
    monkeypatch.setattr(retrieval.Bm25, "_by_lookup", lambda self, weights, k: sent.append(weights.count()) or ask(self, weights, k))
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string").repartition(2)
    got = retrieval.Bm25(frame(texts, "doc_id")).search(frame(asked, "query_id"), 7)
    assert sorted((x.query_id, x.doc_id, x.rank) for x in got.collect()) == sorted(want)
    assert len(sent) == (1 if terms == 10**6 else -(-sum(sent) // terms)) and sum(sent) > 100


# --- hosted services ---


class Service:
    def __init__(self, *outcomes):
        self.outcomes, self.calls, self.slept, self.now = list(outcomes), [], [], 0.0

    def __call__(self, key, payload):
        self.calls.append(key)
        out = self.outcomes.pop(0)
        if isinstance(out, Exception):
            raise out
        return out

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds

    def options(self):
        return {"sleep": self.sleep, "clock": lambda: self.now}


LIMIT, BROKEN = RuntimeError("429 Too Many Requests"), RuntimeError("bad request")


@pytest.mark.parametrize(
    ("outcomes", "keys", "calls", "slept", "fails"),
    [
        (["ok"], ["a"], ["a"], [], False),
        ([LIMIT, "ok"], ["a", "b"], ["a", "b"], [], False),
        ([LIMIT, LIMIT, "ok"], ["a"], ["a"] * 3, [20.0, 20.0], False),
        ([LIMIT, LIMIT, "ok"], ["a", "b"], ["a", "b", "b"], [20.0], False),
        ([LIMIT] * 3, ["a", "b", "c", "d"], ["a", "b", "c"], [], True),
        ([BROKEN], ["a", "b"], ["a"], [], True),
    ],
)
def test_attempts_and_keys(outcomes, keys, calls, slept, fails):
    s = Service(*outcomes)
    h = hosted.Hosted(s, keys, **s.options())
    if fails:
        with pytest.raises(hosted.ServiceError):
            h.call({})
    else:
        assert h.call({}) == "ok"
    assert (s.calls, s.slept) == (calls, slept)


def test_requests_stay_within_the_limit():
    s = Service(*["ok"] * 25)
    h = hosted.Hosted(s, ["a"], "rerank", **s.options())
    for _ in range(25):
        h.call({})
    assert len(s.slept) == 2 and all(60 <= x <= 60.2 for x in s.slept)


def test_hosted_reranker_and_its_failure(spark):
    class Client:
        def __init__(self, error=None):
            self.error = error

        def __call__(self, key, payload):
            if self.error:
                raise RuntimeError(self.error)
            return [float(len(d)) for d in payload["documents"]]

    asked = spark.createDataFrame([(1, "q one"), (2, "q two")], "query_id long, query string")
    rows = spark.createDataFrame([(q, r, 10 * q + r, "x" * (r + 1), 0.5) for q in (1, 2) for r in range(4)], "query_id long, rank int, doc_id long, text string, score double").coalesce(1)
    out = rerank.cascade([hosted.HostedReranker(Client(), ["k"])], asked, rows, 2).orderBy("query_id", "rank").collect()
    assert [(r.doc_id, r.source) for r in out] == [(13, "reranked_hosted"), (12, "reranked_hosted"), (23, "reranked_hosted"), (22, "reranked_hosted")]
    out = rerank.cascade([hosted.HostedReranker(Client("no such model"), ["k"])], asked, rows, 2).orderBy("query_id", "rank").collect()
    assert [(r.doc_id, r.source) for r in out] == [(10, "no_rerank"), (11, "no_rerank"), (20, "no_rerank"), (21, "no_rerank")]
    assert not hosted.HostedReranker(Client(), [""]).available()


def test_hosted_model_and_judge():
    chat = Service('Sure: {"need_more": true, "reason": "thin"} ok', BROKEN, '{"score": 0.5}', "no json")
    model = hosted.HostedModel(chat, Service([[1.0], [2.0]], BROKEN), ["k"], batch=2, **chat.options())
    judge = hosted.HostedJudge(model)
    assert judge.need_more("q", "c", "a") == (True, "thin") and judge.need_more("q", "c", "a") == (False, "")
    assert judge.score("faithfulness", "q", "c", "a", "g") == 0.5 and judge.score("faithfulness", "q", "c", "a", "g") is None
    assert model.embed(["a", "b", "c"]) == [[1.0], [2.0], None]


def test_prompts_have_their_fields():
    assert len(prompts.GRAPH) == 6 and len(prompts.AGENT) == 4 and len(prompts.QUESTIONS) == 5 and set(prompts.JUDGE) == {"faithfulness", "answer_relevance", "completeness", "abstention_quality"}
    for name in prompts.ALL:
        text = prompts.filled(name, **{f: f"<{f}>" for f in prompts.fields(name)})
        assert all(f"<{f}>" in text for f in prompts.fields(name)) and "{{" not in text
        assert ('{"score"' in text) == (name.startswith("judge.") or name in ("graph.grade_document", "graph.check_grounding", "graph.check_answer"))
    with pytest.raises(KeyError):
        prompts.filled("retrieval.hyde")


# --- the agent loop ---


class Judge(OverlapJudge):
    def need_more(self, question, context, answer):
        if "broken" in question:
            raise RuntimeError("no service")
        return "enough" not in question, "told"


class Web:
    def search(self, query, most=3):
        if "down" in query:
            raise RuntimeError("no network")
        return [{"title": "t", "snippet": f"web says {query}"}]


def test_agent_asks_another_source_once_and_keeps_what_it_tried(spark):
    texts = {1: "alpha beta gamma", 2: "alpha beta enough", 3: "alpha beta down", 4: "alpha beta broken", 5: "nothing here"}
    questions = spark.createDataFrame([(i, t, "factual") for i, t in texts.items()], "query_id long, question string, question_type string")
    docs = spark.createDataFrame([(100, "alpha beta delta.")], "doc_id long, text string")

    def find(asked):
        hits = asked.where("text like 'alpha%'").withColumn("rank", F.lit(0)).withColumn("score", F.lit(1.0)).drop("text")
        return hits.crossJoin(docs)  # one document

    got = {r.query_id: r for r in graph.answer(questions, find, judge=Judge(), web=Web(), agentic=True).collect()}
    both, lone = ["vector_db", "internet"], ["vector_db"]
    assert {i: (list(r.sources_tried), r.agentic_iterations) for i, r in got.items()} == {1: (both, 1), 2: (lone, 0), 3: (both, 0), 4: (lone, 0), 5: (both, 1)}
    assert got[5].iterations == 1 and got[5].answer != graph.NO_CONTEXT and list(got[5].documents) == []
    assert all(r.decision == "end" for r in got.values()) and len(got) == 5
    classic = {r.query_id: r for r in graph.answer(questions, find, judge=Judge()).collect()}
    assert classic[5].answer == graph.NO_CONTEXT and classic[5].iterations == 1 and all(list(r.sources_tried) == lone for r in classic.values())


class Counting(ExtractiveModel):
    """Writes a line for each prompt to a file of the process."""

    def __init__(self, folder):
        self.folder = folder

    def generate(self, prompts, temperature=0.0):
        with open(f"{self.folder}/{os.getpid()}", "a") as f:
            f.write("".join(f"{len(p)}\n" for p in prompts))
        return super().generate(prompts, temperature)


def test_the_model_is_called_once_for_each_set_of_texts(spark, tmp_path):
    texts = {1: "alpha beta gamma", 2: "alpha beta enough", 3: "alpha beta down", 4: "other", 5: "nothing here"}
    questions = spark.createDataFrame([(i, t, "factual") for i, t in texts.items()], "query_id long, question string, question_type string").repartition(3)
    docs = spark.createDataFrame([(100, "alpha beta delta.")], "doc_id long, text string")

    def find(asked):
        return asked.where("text like 'alpha%'").withColumn("rank", F.lit(0)).withColumn("score", F.lit(1.0)).drop("text").crossJoin(docs)  # one document

    def calls(name, **options):
        (tmp_path / name).mkdir()
        got = graph.answer(questions, find, Counting(str(tmp_path / name)), Judge(), **options)
        rows = [got.count(), got.count()]  # using the result again asks nothing again
        return rows[1], sum(len(p.read_text().splitlines()) for p in (tmp_path / name).iterdir())

    assert calls("plain", rounds=1) == (5, 3)
    rows, made = calls("rewritten")  # questions 4 and 5 never have a context
    assert rows == 5 and made <= 6
    rows, made = calls("agent", web=Web(), agentic=True, rounds=1)
    assert rows == 5 and made == 3 + 3  # question 1 anew, 4 and 5 only with what the other source gave
    e = Engine(spark, str(tmp_path / "store"), model=ExtractiveModel())
    e.index(spark.createDataFrame([(1, "alpha beta delta grow.")], "chunk_id long, chunk_text string"), 1)
    (tmp_path / "engine").mkdir()
    e.model = Counting(str(tmp_path / "engine"))
    answered = e.answer(questions, 1, agentic=True, judge=Judge(), web=Web(), rewrite=lambda c: F.concat(F.lit("alpha "), c)).collect()
    assert len(answered) == 5 and any("internet" in r.sources_tried for r in answered)


def test_fetch_records(spark):
    cases = [("x", "c", "a", ["vector_db"]), ("enough", "c", "a", ["vector_db"]), ("down", "", None, ["vector_db", "internet"]), ("broken", "c", "a", ["vector_db"])]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, question string, context string, answer string, sources_tried array<string>")

    class Model:
        def generate(self, texts, temperature=0.0):
            return [' "short query" ' if "\nx" in t else None for t in texts]

    got = [tuple(r) for r in graph.route_and_fetch(rows, Judge(), Web(), Model()).orderBy("i").select("need_more", "source", "reason", "success").collect()]
    assert got == [(True, "internet", "more details needed", True), (False, None, "told", True), (True, "internet", "already tried", False), (False, None, "no service", True)]
    assert "web says short query" in graph.route_and_fetch(rows, Judge(), Web(), Model()).where("i = 0").first().data


# --- the command line ---


def test_command_line(spark, tmp_path, capsys):
    from marlstone.__main__ import main
    from marlstone.sources.results import read_results

    at = lambda name: f"file://{tmp_path}/{name}"
    rows = [(i, f"Sensor {i} measures the level of the {w} tank every hour. Its limit is {i}0 litres.", f"s{i % 3}") for i, w in enumerate("red blue green black white brown grey pink".split())]
    spark.createDataFrame(rows, "id long, text string, source string").write.parquet(at("chunks"))
    main(["generate-dataset", at("chunks"), at("questions"), "--factual", "4", "--analytical", "2", "--comparative", "2", "--summarization", "1", "--hallucination", "2"])
    assert capsys.readouterr().out.split()[0] == "11"
    main(["evaluate", at("chunks"), at("questions"), at("results"), "--root", at("collections"), "--k", "3"])
    r = read_results(spark, at("results")).first()
    assert r.total_questions == 11 and 0 <= r.overall_score <= 1 and "factual" in r.question_type_breakdown
