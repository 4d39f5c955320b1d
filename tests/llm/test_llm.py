"""Each training-data operator against a plain version on a small fixture, and its edge cases."""

import collections
import hashlib
import math
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import audio, classifier, html, mixing, near_dups, packing, pii, quality_rules, repeats, token_counts, tokens
from marlstone.llm.graph import components
from marlstone.llm.suffix_sort import blind_trie, deep_shallow

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    """Documents with an extra column whose name an operator might use itself."""
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("length", F.lit("x")).repartition(3)


def words(n, seed=0, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = words(300, 1)
    changed = base.split()
    changed[150] = "other"
    half = " ".join(words(150, 2).split() + base.split()[:150])
    return [base, base, " ".join(changed), half, words(200, 3), None, "", "a b", "a b", "x", "say é 漢字 \n\n tab\t.", "z " * 400, "long " * 9000]


# --- tokens, 3, 4 ---


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_tokenizers():
    r = random.Random(5)
    odd = ["", " ", "it's we'll I'm 's ''s 's't", "a  b \n\n c ", "<|endoftext|>", "½ 123 漢字", "🙂 x y"]
    odd += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext", "|>", " \n <|endoftext|>  y", "<|<|endoftext|>|>", "it'<|endoftext|>s", "é<|endoftext|>漢"]
    thue = lambda a, b: "".join(a if i.bit_count() % 2 else b for i in range(4096))  # noqa: E731  equal hashes modulo 2**64
    odd += [thue("a", "b"), thue("b", "a"), thue("b", "a"), thue("a", "b")]
    odd += ["".join(r.choice(" \n\t'sreavmltd1é漢!. ") for _ in range(r.randrange(40))) for _ in range(500)]
    got = []
    for at, end, ids, first in tokens.encoded(pa.array(odd), tokens.default_vocabulary()):
        got += [ids[first[i] : first[i + 1]].tolist() for i in range(end - at)]
    assert got == reference(odd)


def test_packing_round_trip(spark, texts):
    rows = packing.pack_documents(frame(spark, texts), with_ids=True).collect()
    want = [[*ids, 2] for ids in reference(texts)]
    by_doc, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 1024
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, ids in enumerate(want):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for p in parts for x in p.ids] == ids
        assert [p.start for p in parts] == list(np.cumsum([0, *(p.length for p in parts)])[:-1])
        assert all(p.length == 1024 for p in parts[1:]) and (len(ids) > 1024 or len(parts) == 1)
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= sum(map(len, want)) // 1024 + 2


def test_plan_is_whole_and_tight():
    r = random.Random(2)
    for _ in range(40):
        counts = {r.randrange(1, 101): r.randrange(1, 60) for _ in range(r.randrange(1, 30))}
        load, seen = collections.Counter(), collections.defaultdict(list)
        for n, first, count, at, each, offset in packing.plan(counts, 100):
            for k in range(count):
                seen[n].append(first + k)
                load[at + k // each] += n
                assert offset + (k % each + 1) * n <= 100
        assert {n: sorted(x) for n, x in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
        assert max(load.values()) <= 100
    assert packing.plan({}) == []


def test_empty_tables(spark):
    none = frame(spark, ["x"]).limit(0)
    assert packing.pack_documents(none).count() == 0
    assert token_counts.histogram(none).count() == 0
    assert near_dups.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert repeats.without_repeats(none).count() == 0
    assert classifier.classified(none).count() == 0
    assert pii.with_surrogates(none).count() == 0
    assert quality_rules.judged(none, none.select("doc_id")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.main_text(pages).count() == 0
    assert audio.recordings(spark.createDataFrame([], "id long, audio binary")).count() == 0


def test_histogram(spark, texts):
    sizes = [len(x) for x in reference(texts)]
    rows = {r.n_tokens: r for r in token_counts.histogram(frame(spark, texts)).collect()}
    assert {n: r.n_docs for n, r in rows.items()} == dict(collections.Counter(sizes))
    for n, r in rows.items():
        assert (r.docs_ge, r.tokens_ge, r.truncated_total) == (sum(s >= n for s in sizes), sum(s for s in sizes if s >= n), sum(min(s, n) for s in sizes))
        assert r.limit_from == max((s + 1 for s in sizes if s < n), default=0)
        for limit in {r.limit_from, (r.limit_from + n) // 2}:
            assert r.truncated_total - (n - limit) * r.docs_ge == sum(min(s, limit) for s in sizes)
    limits, quantiles = [0, 1, 5, 777, 10**6], [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    answers = {(r.kind, r.x): r.answer for r in token_counts.at_limits(token_counts.histogram(frame(spark, texts)), limits, quantiles).collect()}
    assert all(answers["limit", float(x)] == sum(min(s, x) for s in sizes) for x in limits)
    assert all(answers["quantile", x] == sorted(sizes)[max(1, math.ceil(x * len(sizes))) - 1] for x in quantiles)


# --- 5 ---


def brute_repeats(texts, window=100):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            part = raw[s : s + window]
            if part in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(part)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [100_000, 0])
def test_repeats(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(4)
    passage = words(60, 9)
    more = [words(20, 50 + i) + " " + passage[r.randrange(40) :] + words(15, 70 + i) for i in range(8)] + ["\0" * 250, "\0" * 130 + "x", "ab" * 120]
    cases = [t if t is None or len(t) < 5000 else t[:3000] for t in texts] + more
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.without_repeats(frame(spark, cases)).collect()}
    assert got == brute_repeats(cases)


def test_repeats_of_texts_that_share_an_id(spark):
    shared = [words(90, 5), words(20, 6) + " " + words(90, 5)[150:420] + words(20, 7), "short", words(20, 6) + " " + words(90, 8)[:300]]
    rows = [(1, words(30, 1) + " " + words(90, 5)[50:300]), *((2, t) for t in shared), (2, "short"), (5, shared[1]), (5, None), (7, words(90, 8))]
    order = sorted(set(rows), key=lambda x: (x[0], hashlib.md5((x[1] or "").encode()).hexdigest()))
    want = brute_repeats([t for _, t in order])
    want = sorted((i, *want[k]) for k, (i, t) in enumerate(order) for _ in range(rows.count((i, t))))
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
    assert sum(x[2] for x in want) > 1000


def test_anchors_do_not_depend_on_what_is_around():
    r = np.random.default_rng(2)
    text = r.integers(97, 99, 4000).astype(np.uint8)
    alone = repeats.anchors_of(text, np.array([0, 4000]))[0]
    for before in (1, 5000, 300_000):
        data = np.concatenate((r.integers(97, 99, before).astype(np.uint8), text, r.integers(97, 99, 77).astype(np.uint8)))
        at = repeats.anchors_of(data, np.array([0, before, before + 4000, len(data)]))[0]
        assert (at[(at >= before) & (at < before + 4000)] - before).tolist() == alone.tolist()


def test_deep_shallow():
    r = random.Random(1)
    for _ in range(50):
        n = r.randrange(1, 40)
        rows = [bytes(r.choice(b"\1\1\1\2") for _ in range(r.choice([24, 24, r.randrange(25)]))) for _ in range(n)]
        rows = [rows[r.randrange(n)] if r.random() < 0.3 else x for x in rows]
        group = np.array([r.randrange(2) for _ in rows])
        table = np.array([list(x.ljust(24, b"\0")) for x in rows], np.uint8)
        order, shared = deep_shallow(group, table, np.array(list(map(len, rows))), r.choice([0, 8, 16]))
        keys = [(group[i], rows[i]) for i in order]
        assert keys == sorted(keys)
        for k in range(1, n):
            (ga, a), (gb, b) = keys[k - 1], keys[k]
            common = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert shared[k] == (common if ga == gb else -1)
    assert blind_trie([b"b", b"a", b"b"]) == ([1, 0, 2], [-1, 0, 1])


# --- 6 ---


def test_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=/>menu</a></nav><div class='ad'>buy</div>{}<div id='comments'><p>first!</p></div><footer>f</footer></body></html>"
    good = "<article class='post-{}'><h1>Head &amp; more</h1><p>one <b>two</b> three<br>four<p>five  \n six<script>var x='</p>'</script></article>"
    rows = [(i, "https://h.example.org/x", page.format(good.format(i))) for i in range(4)] + [(9, None, None), (10, "u", ""), (11, "https://h.example.org/y", "just text")]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == "Head & more one two three four five six" for i in range(4))
    assert (got[9].text, got[9].n_chars, got[10].text, got[11].text) == ("", 0, "", "just text")
    assert html.Page("<div><p>a<div>b</p></div>c").inside(0) == "a b c"


class Plain(HTMLParser):
    """The text of the first article or body, block by block, without elements that are boilerplate by tag or whole class."""

    inline = set("a b em i span strong u".split())
    gone = set("nav header footer aside form script style title head button".split())

    def __init__(self, source, within):
        super().__init__(convert_charrefs=True)
        self.within, self.open, self.text = within, [], []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "meta", "img", "hr"):
            self.text.append(" ")
            return
        if tag not in self.inline:
            self.text.append(" ")
            if self.open and tag in ("p", "div", "ul", "h1", "h2", "article", "section", "footer"):  # these close a paragraph
                opened = [t for t, _ in self.open]
                if "p" in opened and not set(opened[len(opened) - opened[::-1].index("p") :]) & {"div", "article"}:
                    del self.open[len(opened) - 1 - opened[::-1].index("p") :]
        marks = {"ad", "comments", "comment", "user-comments-thread", "sidebar", "notice", "site-footer"}
        gone = tag in self.gone and not (tag == "header" and "article" in [t for t, _ in self.open])
        self.open.append((tag, gone or bool(marks & set((dict(attrs).get("class") or "").split()))))

    def handle_endtag(self, tag):
        if tag not in self.inline:
            self.text.append(" ")
        opened = [t for t, _ in self.open]
        if tag in opened:
            del self.open[len(opened) - 1 - opened[::-1].index(tag) :]

    def handle_data(self, data):
        if (not self.within or self.within in [t for t, _ in self.open]) and not any(g for _, g in self.open):
            self.text.append(data)

    def all(self):
        return " ".join("".join(self.text).split())


def test_extraction_equals_a_plain_version(spark):
    r = random.Random(8)
    say = lambda n: " ".join(f"{r.choice(['Über', 'a', 'word', 'x&amp;y', '&lt;b&gt;', '漢字'])}{r.randrange(99)}" for _ in range(n))
    inside = [
        lambda: f"<p>{say(20)} <b>{say(2)}</b>\n {say(9)}</p>", lambda: f"<p>{say(30)}<br>{say(3)}", lambda: f"<h2 class='article-header'>{say(4)}</h2>", lambda: f"<section class=notice-of-motion><p>{say(15)}</p></section>",
        lambda: f'<div class="search-results"><p>{say(12)} <a href=/x>{say(2)}</a></p></div>', lambda: f"<div class='ad'>{say(6)}</div>", lambda: f"<ul><li>{say(5)}<li>{say(5)}</ul>", lambda: f"<aside>{say(4)}</aside>", lambda: f"<div class='notice'>{say(5)}</div>",
        lambda: f"<section class='comments-open'><p>{say(14)}</p></section>", lambda: f'<div title="a > b" data-x=\'"\'>{say(9)}</div>', lambda: f"<div class='user-comments-thread'><p>{say(30)}</p></div>",
    ]
    own = [lambda: f"<header><h1>{say(4)}</h1></header>", lambda: f"<div class='search'>{say(12)}</div>"]
    rows, want = [], []
    for i in range(120):
        parts = "".join(r.choice(inside)() for _ in range(r.randrange(1, 9)))
        body = f"<article>{r.choice(own)()}<h1>{say(5)}</h1>{parts}</article><section id='discussion'><article class='comment'>{say(25)}</article></section>" if i % 3 else f"<div class='intro'><p>{say(40)}</p></div><div class='rest'><p>{say(r.randrange(12, 60))}</p>{parts}</div>"
        page = f"<!DOCTYPE html><html><head><title>{say(3)}</title><style>p{{}}</style></head><body><nav><a href=/>{say(3)}</a></nav><div class=ad>{say(9)}</div>{body}<div class='comments'><p>{say(20)}</p></div><footer class='site-footer'>{say(5)}</footer></body></html>"
        rows.append((i, f"https://h{i % 3}.example.org/{i}", page))
        want.append(Plain(page, "article" if i % 3 else "body").all())
    rows += [(200, "https://h1.example.org/l", f"<article>{'<p>' + say(9) + '</p>'}" + "<div>" * 3000 + say(3) + "</article>"), (201, rows[1][1], rows[1][2]), (202, rows[1][1], rows[1][2])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("path", F.lit("y"))
    got = {x.page_id: x for x in html.main_text(frame).collect()}
    for i, w in enumerate(want):
        assert got[i].text == w and got[i].n_chars == len(w)
    assert got[200].text == Plain(rows[120][2], "article").all() and got[201].text == got[202].text == want[1]


def test_extraction_of_odd_markup():
    text = lambda source: html.Page(source).inside(0)
    assert text("<p>a<![CDATA[ hidden ]]>b</p>") == "ab" and text("a<!-- x > y -->b<!doctype z>c") == "abc"
    assert text("<header>site</header><article><header hidden>no</header><header class=entry><h1>Title</h1></header>x</article>") == "Title x"
    assert text("<div class='search'>find</div><article><div class='search'>about search</div></article>") == "about search"
    assert text("<main class='no-comments'><p>a</p></main><div id='reader-comments-2'>b</div><div class='disqus_thread'>c</div>") == "a"
    assert text("<p don't>it's</p>") == "it's" and text("1 < 2 <b") == "1 < 2 <b" and text('<p t="x>a</p> <i>b</i>') == "a b"
    assert text("<div>a<b>b<section>c</b>d</section>e</b></div>f") == "ab cd e f"


def test_extraction_is_linear_on_hostile_pages():
    hostile = [lambda n: "<div>x " * n, lambda n: "<a " * n, lambda n: '<p title="' * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<b>" + "<div>" * n + "</b>" * n, lambda n: "<b>" * n + "<h1></h1>" * n, lambda n: "<ul>" * n + "<li>x" * n, lambda n: "<script " * n, lambda n: "".join(f'<i class="comment-c{i}">' for i in range(n))]
    for page in hostile:
        spent = []
        for n in (4_000, 64_000):
            began = time.process_time()
            read = html.Page(page(n))
            read.under(read.keys[read.best()])
            spent.append(time.process_time() - began)
        assert spent[1] < 64 * max(spent[0], 0.02), page(1)  # 16 times the length; 256 times the time if quadratic


# --- 7 ---


def test_quality_rules(spark, texts):
    junk = " ".join(f"{w}***" for w in words(120, 30, 60).split())
    clean = [words(120, 100 + i, 60) for i in range(30)]
    cases = [*clean, junk, "one two", None, "a b c d e " * 6, "l1 x\nl1 x\n\nl2 #\nl1 x"]
    docs = frame(spark, cases)
    got = {r.doc_id: r for r in quality_rules.judged(docs, docs.where("doc_id < 25").select("doc_id")).collect()}
    for i, t in enumerate(cases):
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert all(got[i].kept for i in range(30)) and not got[30].kept and not got[32].kept
    assert quality_rules.judged(docs, docs.select("doc_id").limit(0)).where("kept <> (not base_failed)").count() == 0


def test_quality_rules_hash_words_once(spark, monkeypatch):
    """Counting and scoring share one pass over the texts; the stored buckets give the scores that whole hashes give."""
    texts = ["", None, "one", "the cat sat on the mat " * 4, " ".join(f"w{i % 37}" for i in range(300))]
    first = next(i for i in range(100) if hashlib.md5(str(i + 4).encode()).hexdigest() < "8")  # the last text is trusted and counted
    docs = spark.createDataFrame(list(enumerate(texts, first)) + [(None, "no id here")], "doc_id long, text string")
    made, n, hashed = [], 1 << 7, quality_rules.hashed
    monkeypatch.setattr(quality_rules, "hashed", lambda w: made.append(1) or hashed(w))
    got = {r.doc_id: r.score for r in quality_rules.judged(docs, docs.where(f"doc_id = {first + 4}").select("doc_id"), n).collect()}
    assert len(made) == 1 and len(got) == 6
    whole = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:7], 16)
    grams = {}
    for i, t in [*enumerate(texts, first), (None, "no id here")]:
        h = [whole(w) for w in (t or "").split()]
        grams[i] = [x % n for x in h] + [(a * 31 + b * 7 + 13) % n for a, b in zip(h, h[1:])]
    trusted = collections.Counter(grams[first + 4])
    raw = collections.Counter(b for g in grams.values() for b in g)
    p = [(raw[b] + 1) / (raw.total() + n) for b in range(n)]
    weight = [round(1e6 * math.log((trusted[b] + n * p[b]) / (trusted.total() + n) / p[b])) for b in range(n)]
    assert got == {i: int(sum(weight[b] for b in g) / (len(g) + quality_rules.PRIOR)) for i, g in grams.items()}


# --- 8 ---


def test_near_duplicates(spark, texts):
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(frame(spark, texts)).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[7] == got[8] == 7
    assert all(got[i] == i for i in (3, 4, 5, 6, 7, 9, 10, 11, 12))


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate((a[:240], r.integers(0, 2**63, 60).astype(np.uint64)))
    s = near_dups.signatures(np.concatenate((a, b)), np.array([0, 300, 600]), 512)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.08
    heavy = np.concatenate((np.repeat(a[:50], 3), a[50:100]))  # weights 3 and 1 against 1 and 1
    s = near_dups.signatures(np.concatenate((heavy, a[:100])), np.array([0, 200, 300]), 512)
    assert abs((s[0] == s[1]).mean() - 100 / 200) < 0.08


def shingle_counts(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def plain_classes(cases, similarity=0.8):
    """Classes by comparing all pairs."""
    sets = [shingle_counts(t) for t in cases]
    parent = list(range(len(cases)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = (a & sets[j]).total()
            if both and both >= similarity * (a.total() + sets[j].total() - both):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return [root(i) for i in range(len(cases))]


def near_copies():
    """Groups of copies with 0 to 12 edits each, so that pairs lie on both sides of 0.8, among other texts."""
    r = random.Random(21)
    cases = [words(60 + i, 800 + i) for i in range(30)]
    for g in range(3):
        base = words(140, 850 + g).split()
        for _ in range(60):
            w = list(base)
            for _ in range(r.randrange(13)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            cases.append(" ".join(w))
    line = words(12, 77)
    cases += ["\n".join([line] * k + [words(30, 78)]) for k in (20, 21, 22, 60)]  # repeated lines weigh as often as they occur
    r.shuffle(cases)
    return cases


@pytest.mark.parametrize("unit", [4096, 7])
def test_classes_equal_those_of_all_pairs(spark, monkeypatch, unit):
    monkeypatch.setattr(near_dups, "UNIT", unit)
    monkeypatch.setattr(near_dups, "CHUNK_OF_GROUP", 5)
    cases = near_copies()
    want = plain_classes(cases)
    assert 40 < len(set(want)) < len(cases) - 40
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(frame(spark, cases)).collect()}
    assert [got[i] for i in range(len(cases))] == want


def test_links_that_a_unit_passes_on_span_it():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**62, 300).astype(np.uint64))
    lists = [np.sort(np.concatenate((r.choice(base, 250, replace=False), r.integers(0, 2**62, 15).astype(np.uint64)))) for _ in range(50)]
    part = np.arange(50) // 2
    alike = lambda i, j: (lambda n: n >= 0.6 * (len(lists[i]) + len(lists[j]) - n))(len(np.intersect1d(lists[i], lists[j])))
    for unit in (np.zeros(50, np.int64), np.arange(50) % 2):
        y = int(unit.max())
        links = near_dups.spanning(unit, part, lists, 0, y, 0.6)
        label = {p: p for p in part.tolist()}
        for a, b in links:
            assert label[a] != label[b]
            label = {k: label[a] if v == label[b] else v for k, v in label.items()}
        assert all(label[part[i]] == label[part[j]] for i in range(50) for j in range(50) if unit[i] == 0 and unit[j] == y and alike(i, j))
        assert len(links) < 25


def test_near_duplicates_of_shared_and_missing_ids(spark):
    a, b = words(80, 31), words(80, 32)
    rows = [(1, a, "en", "a", 0), (1, b, "en", "a", 0), (None, a + " more", "en", "a", 0), (None, None, "en", "a", 0), (5, b, "en", "a", 0), (6, "w" * 300_000 + " " + words(20_000, 33), "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("part", F.lit(2)).withColumn("_near_dups_row", F.lit(3))
    got = near_dups.near_duplicates(docs).collect()
    assert len(got) == 6 and len({r.class_key for r in got if r.class_key is not None}) == 3
    assert sorted((r.doc_id is None, r.class_id) for r in got if r.class_key is not None) == [(False, 1), (False, 1), (False, 1), (False, 6), (True, 1)]
    kept = near_dups.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, a), (1, b), (0, ""), (6, rows[5][1])])


def test_texts_made_to_share_a_polynomial_hash_stay_apart(spark):
    thue = lambda a, b: "".join(a if i.bit_count() % 2 else b for i in range(4096))  # noqa: E731  equal modulo 2**64 for every base
    texts = [thue("a", "b"), thue("b", "a"), " ".join([thue("c", "d"), words(30, 5)]), " ".join([thue("d", "c"), words(30, 5)]), thue("a", "b")]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in near_dups.near_duplicates(docs).collect()}
    assert got[0].class_id == got[4].class_id == 0 and got[1].class_id == 1 and got[2].exact_id != got[3].exact_id
    assert sorted(r.doc_id for r in near_dups.deduplicated(docs).collect()) == [0, 1, *sorted({got[2].class_id, got[3].class_id})]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


# --- 9 ---


def test_classifier_on_held_out_kinds(spark):
    r = random.Random(3)
    clean = [words(80, 200 + i, 300) for i in range(60)]
    marks = [" ".join(w + r.choice(["***", "&&&"]) for w in words(80, 300 + i, 300).split()) for i in range(8)]
    loud = [words(80, 400 + i, 300).upper() + "!!" for i in range(8)]
    echo = [" ".join(w for w in words(10, 500 + i, 300).split() for _ in range(8)) for i in range(8)]
    cases = [*clean, *marks, *loud, *echo, None, ""]
    got = {x.doc_id: x.kept for x in classifier.classified(frame(spark, cases)).collect()}
    right = sum(got[i] == (i < 60) for i in range(84))
    assert right >= 82 and all(got[i] for i in range(60)) and not got[84] and not got[85]


def test_posteriors_follow_accurate_labellers():
    p = classifier.posteriors({classifier.pattern(np.array([[2] * 8]))[0]: 900, classifier.pattern(np.array([[1] + [2] * 7]))[0]: 60, classifier.pattern(np.array([[2, 1] + [2] * 6]))[0]: 40})
    values = sorted(p.values())
    assert values[-1] > 0.8 and values[0] < 0.5 and classifier.posteriors({}) == {}


# --- 10 ---


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else share * weight[s]
        if not over:
            break
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark):
    names = ["b", "a", None, "c", "d"]
    cases = [words(5 + i % 40, i) if i % 17 else None for i in range(600)]
    docs = frame(spark, cases, names)
    rows = mixing.mix(docs, shards=4).collect()
    sizes = collections.Counter()
    for i, t in enumerate(cases):
        sizes[names[i % 5]] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in rows:
        s = names[r.doc_id % 5]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.shards) == r.copies
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 45 for s in names)
    again = mixing.mix(docs.repartition(5), shards=4).collect()
    assert sorted((r.doc_id, r.taken, r.shards) for r in rows) == sorted((r.doc_id, r.taken, r.shards) for r in again)
    assert mixing.mixed_documents(docs, shards=4).columns == docs.columns
    assert mixing.mixed_documents(docs, shards=4).count() == sum(r.copies for r in rows)


def test_mixing_keeps_any_column_and_every_text(spark):
    names = ["shards", "_id", "_copy", "_shard", "row", "doc", "copy", "shard", "place", "size", "a.b"]
    texts = [words(30, i) for i in range(60)]
    ids = [None, None, 7, 7, *range(10, 66)]
    rows = [(i, t, "en", "a", len(t)) for i, t in zip(ids, texts, strict=True)] + [(7, texts[2], "en", "a", 0), (1, None, None, None, None), (2, "x " * 40_000, "en", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    out = mixing.mixed_documents(docs, shards=3)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert all(r["a.b"] == "a.b" and r.shards == "shards" for r in out.limit(5).collect())
    # the copies are those that mix tells, also for texts without an id or with a shared one
    want = collections.Counter()
    text = {(r.doc_id, r.row): r.text for r in docs.select("doc_id", "text", mixing.row_key().alias("row")).collect()}
    for r in mixing.mix(docs, shards=3).collect():
        want[r.doc_id, text[r.doc_id, r.row]] += r.copies
    assert all(abs(got[k] - want[k]) <= 2 and bool(got[k]) == bool(want[k]) for k in want)
    again = collections.Counter((r.doc_id, r.text) for r in mixing.mixed_documents(docs.repartition(4), shards=3).collect())
    assert again == got


def test_splitting_tree_is_exact():
    big = mixing.split([3 * 10**9, 10**10, 5], 4)
    assert np.array(big).sum(axis=0).tolist() == [3 * 10**9, 10**10, 5] and max(map(sum, big)) - min(map(sum, big)) <= 3
    parts = mixing.split([7, 0, 100, 3], 5)
    assert len(parts) == 5 and np.array(parts).sum(axis=0).tolist() == [7, 0, 100, 3]
    assert max(map(sum, parts)) - min(map(sum, parts)) <= 3


# --- 1 ---


def test_recordings_align_at_their_offset(spark):
    r = np.random.default_rng(1)
    tune = lambda seed: np.random.default_rng(seed).standard_normal(64)
    sound = lambda v, lead: audio.melody([{"id": lead, "embedding": v}])[0]
    pcm = lambda x: (x * 30000).astype("<i2").tobytes()
    a = tune(3)
    rows = [(1, pcm(sound(a, 0))), (2, pcm(sound(a, 3))), (3, pcm(sound(a + 0.05 * r.standard_normal(64), 1))), (4, pcm(sound(tune(4), 0))), (5, pcm(sound(a, 0))), (6, None), (7, b""), (8, b"\0\0" * 9000), (9, b"\0\0" * 9000)]
    got = {x.id: x for x in audio.recordings(spark.createDataFrame(rows, "id long, audio binary")).collect()}
    assert [got[i].class_id for i in (1, 2, 3, 5)] == [1, 1, 1, 1] and [got[i].class_id for i in (4, 6, 7, 8, 9)] == [4, 6, 7, 8, 9]
    assert got[5].exact_id == 1 and got[2].best_match in (1, 3) and got[2].bit_errors <= 0.25 * got[2].bits
    assert got[2].best_offset == (6 if got[2].best_match == 1 else 4)  # frame t of the match is frame t + offset of this recording


def plain_links(prints):
    """Pairs of (id, codes, sound) that are within ERRORS at some offset, by trying all of them."""
    out = {}
    for x, (a, ca, sa) in enumerate(prints):
        for b, cb, sb in prints[x + 1 :]:
            for offset in range(audio.OVERLAP - len(cb), len(ca) - audio.OVERLAP + 1):
                s, n = max(0, offset), min(len(ca) - max(0, offset), len(cb) - max(0, offset) + offset)
                both = sa[s : s + n] & sb[s - offset : s - offset + n]
                rate = np.bitwise_count(ca[s : s + n] ^ cb[s - offset : s - offset + n])[both].sum() / max(1, 32 * both.sum())
                if both.sum() >= audio.OVERLAP and rate <= min(audio.ERRORS, out.get((a, b), 1)):
                    out[a, b] = rate
    return out


def pcm_rows(vectors):
    return [(i, (audio.melody([{"id": 0, "embedding": v}])[0] * 30000).astype("<i2").tobytes()) for i, v in vectors.items()]


def prints_of(rows):
    return [(i, *audio.codes(audio.chroma(np.frombuffer(x, "<i2").astype(np.float32) / 32768))) for i, x in rows]


def test_links_outlast_smaller_ids_that_share_every_key(spark):
    r = np.random.default_rng(7)
    unit = lambda v: (v.reshape(-1, 4) / np.sqrt((v.reshape(-1, 4) ** 2).mean(axis=1, keepdims=True))).reshape(-1)
    tunes = [unit(r.standard_normal(64)) for _ in range(4)]
    # medleys take each part of 16 notes from another tune, with the cuts at four places
    medleys = [np.array([tunes[((n + cut) // 16 + k) % 4][n] for n in range(64)]) for cut in (0, 4, 8, 12) for k in range(4)]
    vectors = dict(enumerate(medleys)) | {100 + i: t for i, t in enumerate(tunes)} | {200 + i: t + 0.03 * r.standard_normal(64) for i, t in enumerate(tunes)}
    rows = pcm_rows(vectors)
    want = plain_links(prints_of(rows))
    assert {(100 + i, 200 + i) for i in range(4)} <= set(want)
    got = {x.id: x for x in audio.recordings(spark.createDataFrame(rows, "id long, audio binary")).collect()}
    partners = {i: [a + b - i for a, b in want if i in (a, b)] for i in vectors}
    assert {i: x.n_links for i, x in got.items()} == {i: len(p) for i, p in partners.items()}
    for i in range(4):
        assert got[100 + i].class_id == got[200 + i].class_id
        assert (got[100 + i].best_match, got[200 + i].best_match) == (200 + i, 100 + i)


@pytest.mark.parametrize("noise", [0.15, 0.3])
def test_links_within_the_error_limit_are_found(spark, noise):
    r = np.random.default_rng(9)
    tunes = r.standard_normal((40, 64))
    vectors = dict(enumerate(tunes)) | {100 + i: t + noise * r.standard_normal(64) for i, t in enumerate(tunes)}
    # an excerpt of the last 40 notes, and one that follows a first occurrence of its beginning
    vectors |= {200 + i: t[24:] + 0.1 * r.standard_normal(40) for i, t in enumerate(tunes[:10])}
    vectors |= {300 + i: np.concatenate((t[:16], t[:48])) for i, t in enumerate(tunes[10:20])}
    rows = pcm_rows(vectors)
    want = plain_links(prints_of(rows))
    assert len(want) > 20
    links = {x.id: x.n_links for x in audio.recordings(spark.createDataFrame(rows, "id long, audio binary")).collect()}
    partners = collections.Counter(i for pair in want for i in pair)
    assert all(links[i] <= partners[i] for i in vectors)
    assert sum(links.values()) >= 0.9 * 2 * len(want)


def test_recordings_without_an_id_and_with_one_id(spark):
    r = np.random.default_rng(3)
    a, b, c = r.standard_normal((3, 64))
    near = lambda v: v + 0.05 * r.standard_normal(64)
    rows = [(None, a), (7, near(a)), (None, b), (None, near(b)), (5, a), (5, c), (5, c), (9, near(c)), (None, np.zeros(64))]
    sounds = [x for _, x in pcm_rows(dict(enumerate(v for _, v in rows)))]
    data = [(i, x) for (i, _), x in zip(rows, sounds, strict=True)] + [(None, None)]
    got = audio.recordings(spark.createDataFrame(data, "id long, audio binary")).collect()
    of = {(x.id, x.crc): x for x in got}
    assert len(got) == len(data)
    crc = [zlib.crc32(audio.codes(audio.chroma(np.frombuffer(x, "<i2").astype(np.float32) / 32768))[0].astype("<u4")) for x in sounds]
    of_row = [of[i, k] for (i, _), k in zip(rows, crc, strict=True)]
    assert [(x.exact_id, x.class_id, x.n_links, x.best_match) for x in of_row[:8]] == [
        (5, 5, 1, 7), (7, 5, 1, 5), (None, None, 1, None), (None, None, 1, None), (5, 5, 1, 7), (5, 5, 1, 9), (5, 5, 1, 9), (9, 5, 1, 5)]
    assert sum(x.n_links == 0 and x.class_id is None for x in got) == 2  # silence and null audio


def test_each_pair_of_blocks_meets_once(spark):
    rows = spark.range(200).select("id", F.array_repeat(F.lit(1), 30).alias("codes"), F.array_repeat(F.lit(True), 30).alias("sound"))
    met = audio.dealt(rows).select("x", "y", "block", "id", F.spark_partition_id().alias("task")).collect()
    assert len(met) == 200 * audio.LEAST_BLOCKS
    assert all(len({m.task for m in met if (m.x, m.y) == pair}) == 1 for pair in {(m.x, m.y) for m in met})
    of = {m.id: m.block for m in met}
    assert collections.Counter((m.id, m.x, m.y) for m in met) == collections.Counter((i, min(k, own), max(k, own)) for i, own in of.items() for k in range(audio.LEAST_BLOCKS))


def test_integral_image_filters():
    image = np.random.default_rng(0).random((30, 12))
    packed, heard = audio.codes(image)
    one, other = audio.filter_boxes(5)
    mean = lambda t, boxes: sum(image[t + a : t + b, c:d].sum() for a, b, c, d in boxes) / sum((b - a) * (d - c) for a, b, c, d in boxes)
    for t in (0, 7):
        ratio = np.log((0.01 + mean(t, one)) / (0.01 + mean(t, other)))
        level = int(ratio > -audio.STEP) + int(ratio > 0) + int(ratio > audio.STEP)
        assert packed[t] >> 10 & 3 == audio.GRAY[level]
    assert heard.all() and audio.codes(np.zeros((5, 12)))[0].size == 0


# --- the pipeline ---


def test_repeats_of_rows_without_an_id(spark):
    a, b, c = (words(120, 900 + i, 500) for i in range(3))
    rows = [(5, a, "en", "a", 0), (None, a, "en", "a", 0), (None, b, "en", "a", 0), (None, c, "en", "a", 0)]
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in repeats.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(False, len(a), 0), (True, len(a), len(a)), (True, len(b), 0), (True, len(c), 0)])


def test_stages_keep_null_and_shared_ids(spark):
    texts = [words(120, 600 + i, 500) for i in range(40)]
    ids = [None, None, 7, 7, *range(10, 46)]  # two texts without an id, two that share one
    rows = [(i, t, "en", "a", len(t)) for i, t in zip(ids, texts, strict=True)]
    rows += [(None, texts[0], "en", "a", len(texts[0])), (99, texts[1], "en", "a", len(texts[1]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lambda df: sorted(r.text for r in df.collect())
    good = classifier.accepted(docs)
    assert got(good) == sorted(r[1] for r in rows)
    one_each = near_dups.deduplicated(good)
    assert got(one_each) == sorted(texts) and {r.doc_id for r in one_each.collect() if r.text == texts[1]} == {99}
    assert set(got(mixing.mixed_documents(one_each))) >= {texts[0]}


def test_pipeline(spark, texts, tmp_path):
    import corpus_pipeline

    clean = [words(120, 600 + i, 500) for i in range(40)]
    junk = [" ".join(f"{w}***" for w in words(100, 700 + i, 300).split()) for i in range(4)]
    cases = [*clean, *junk, clean[0], clean[1] + " mail x.y@z.example.com"]
    frame(spark, cases, ["a", "b"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, f"file://{tmp_path}"))
        if name == "quality":
            assert {r.doc_id for r in docs.collect()} >= set(range(40)) and docs.where("doc_id between 40 and 43").count() == 0
        if name == "near_dedup":
            assert sorted(r.doc_id for r in docs.collect()) == list(range(40))
        if name != "packing":
            assert docs.columns == columns
    assert docs.agg(F.max("length")).first()[0] <= 1024
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == docs.count()
