"""HTML main text by consensus host paths.

Method. One pass over each page's tags builds its blocks of text and its
containers, each known by its parent and a 128-bit hash of its path, a path step being
the tag and its classes with digits generalised; time and memory are linear in the page's
length, however tags nest, stay open or lack a quote. Boilerplate elements (menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles)
are cut while reading: by their tag, or by a class, id or role that is made of such words only ("ad",
"site-footer"). Names with a word of reader comments are cut too ("user-comments-thread"), unless they only say that
an element has or lacks some ("no-comments"), and so is an article whose name says it is a comment. A header inside an article is its own heading and stays; a
mark "search" there is a hint only. A name that merely begins or ends with one ("search-results", "notice-of-motion") is a hint: its
text counts half in the scores, and is cut only if more than half of it is links. Every container on a block's path is scored by the text
below it, less its links, with a bonus for elements that mean an article, and a
small cost for depth above the text, so that siblings which share an article leave it to their parent. Each page votes for its best container's path; votes are
summed for each host in Spark (partial sums per task, so a hot host is a few
rows), and the path with the most votes wins. Pages are read again with their
host's winning path: the text is that of the elements with this path; a page that
lacks it falls back on its own best container.

Votes are a row for each host; they are broadcast only up to BROADCAST_HOSTS
hosts and joined by a shuffle beyond that.

Edge cases: null or empty html gives an empty text; a page without tags is one
block; null urls share one host; unclosed, stray or nested tags close as in
browsers (a block closes an open paragraph; an end tag closes up to its match and is
ignored without one); CDATA is a comment; once a quote is open to the page's end, quotes hide no closing bracket from there on; a last
tag without a closing bracket is text; repeated rows are extracted each; ties between paths go to
the smaller hash; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import stored, table, workers_find_package

BROADCAST_HOSTS = 100_000
OPENER = re.compile(r"</?[a-zA-Z]|<[!?]")
NAME = re.compile(r"[^\s/>]+")
#: A whole tag; only a quote after an equals sign hides a closing bracket.
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Elements whose content is not text, or is boilerplate by meaning.
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes", "template"}
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
DROP = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "map", "datalist"} | RAW
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "frame", "basefont", "bgsound", "keygen"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPH_ENDERS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPES = set("table td th button caption object html body article section div main".split())
#: Words of classes, ids and roles that mark boilerplate.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar submenu breadcrumb breadcrumbs "
    "sidebar sidenav aside header masthead topbar footer colophon cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "comment comments commentlist respond disqus reply replies share sharing social related recommended recommendations recirc pagination pager toolbar widget skip contentinfo complementary search".split()
)
#: Words that say nothing on their own beside a mark.
NEUTRAL = set("box wrap wrapper container block section area list inner outer main page site top bottom left right slot unit bar panel item items group holder zone content row col column module".split())
#: Words of reader comments, words beside them, and words that say that an element only has or lacks some.
COMMENTS = set("comment comments commentlist commenters disqus".split())
BESIDE = set("user users reader readers visitor visitors guest thread threads text author meta date form count body id node post article parent child even odd depth reply replies level".split())
ABOUT = set("has have with without no open closed enabled disabled allow allowed".split())
SOFT = {"search"}  # inside an article such a word may be its subject
OWN_PARTS = {"header"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = dict.fromkeys([*PARAGRAPH_ENDERS, *CLOSES], ("ul", "ol", "dl", "table"))
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HINT, CUT, SOFT_CUT = 1, 2, 3
LEVEL = 0.87  # of its text's worth that each level above a container's parent loses
MEANT = re.compile(r"^(article|main)\b|\.(article|post|entry|story|content|maintext|body)(-?(body|content|text|main))?\b")
LONE = set("article main body html".split())


@functools.lru_cache(maxsize=4096)
def step(tag: str, attributes: str) -> tuple[str, int]:
    """(generalised tag and classes, whether it marks boilerplate: 0, HINT or CUT)."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, CUT if tag in DROP else 0
    found = {}
    for k, v in ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), html.unescape(v.strip("\"'")).lower())
    classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").split()})
    mark = CUT if tag in DROP or "hidden" in found or found.get("aria-hidden") == "true" else 0
    if not mark and tag not in HEADINGS and tag not in ("body", "html"):
        for value in [*found.get("class", "").split(), found.get("id", ""), found.get("role", "")]:
            parts = [x for x in re.split(r"[^a-z]+", value) if x]
            mark = max(mark, _mark(set(parts), {*parts[:1], *parts[-1:]}, tag in LONE), key=(0, HINT, SOFT_CUT, CUT).index)
    return ".".join([tag, *classes]), mark


def _mark(parts: set[str], ends: set[str], alone: bool) -> int:
    """What a name's words say; names of elements that stand ``alone`` tell of reader comments only."""
    if not COMMENTS.isdisjoint(parts) and ABOUT.isdisjoint(parts):
        whole = COMMENTS | BESIDE | NEUTRAL | MARKS >= parts
        if whole or not alone and parts & COMMENTS != {"comment"}:
            return CUT
    if alone or MARKS.isdisjoint(parts):
        return 0
    if MARKS | NEUTRAL >= parts:
        return SOFT_CUT if parts & MARKS <= SOFT else CUT
    return 0 if MARKS.isdisjoint(ends) else HINT


class Page:
    """Blocks of text in page order: ``blocks`` has (text, link characters, container number). Containers are numbered
    in page order, so parents come before children; ``keys`` has a hash of each one's path of steps."""

    def __init__(self, source: str) -> None:
        self.parents, self.names, self.keys, self.hinted = [0], [""], [""], [False]
        self.blocks: list[tuple[str, int, int]] = []
        self._read(source)
        if any(self.hinted):
            self._cut_links()

    def _read(self, source: str) -> None:
        open_: list[tuple[str, int]] = []  # (tag, container number, or 0 for an inline or dropped element)
        places: dict[str, list[int]] = defaultdict(list)  # where in open_ each tag stands
        scopes: list[int] = []  # where the tags of SCOPES stand
        text: list[str] = []
        at, container, linked, links, dropped, quotes = 0, 0, 0, 0, None, True

        def flush() -> None:
            nonlocal text, linked
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((joined, linked, container))
                text = []
            linked = 0

        def put(raw: str) -> None:
            nonlocal linked
            if dropped is None and raw:
                plain = html.unescape(raw) if "&" in raw else raw
                text.append(plain)
                if links:
                    linked += len(plain.strip())

        def close(depth: int) -> None:
            """Close all open elements from ``depth`` on."""
            nonlocal container, links, dropped
            while len(open_) > depth:
                tag, number = open_.pop()
                places[tag].pop()
                if tag in SCOPES:
                    scopes.pop()
                if tag not in INLINE and dropped is None:
                    flush()
                if number:
                    container = self.parents[number]
                links -= tag == "a" and links > 0
            if dropped is not None and depth <= dropped:
                dropped = None

        def last(tags: Iterable[str]) -> int:
            """Where the innermost of these tags stands, -1 without one."""
            return max((places[t][-1] for t in tags if places[t]), default=-1)

        while True:
            m = OPENER.search(source, at)
            if not m:
                put(source[at:])
                break
            put(source[at : m.start()])
            if m[0] in ("<!", "<?"):  # a comment, also with CDATA's name
                sign, skip = ("-->", 4) if source.startswith("<!--", m.start()) else (">", 2)
                end = source.find(sign, m.start() + skip)
                at = len(source) if end < 0 else end + len(sign)
                continue
            found = TAG.match(source, m.start()) if quotes else None
            quotes = quotes and found is not None
            if found:
                tag, attributes, at = found[1].lower(), found[2], found.end()
            else:  # a quote is open to the page's end: from here on, quotes hide nothing
                end = source.find(">", m.end())
                if end < 0:
                    put(source[m.start() :])
                    break
                tag, attributes = NAME.match(source, m.end() - 1, end)[0].lower(), source[m.end() : end]
                attributes, at = attributes[len(tag) - 1 :], end + 1
            if m[0][1] == "/":
                depth = last((tag,))
                if tag == "br" and dropped is None:
                    text.append("\n")
                if depth >= 0 and (tag not in INLINE or not scopes or scopes[-1] < depth):
                    close(depth)
                continue
            if tag in VOID:
                if tag == "br" and dropped is None:
                    text.append("\n")
                elif tag == "hr" and dropped is None:
                    flush()
                continue
            if tag in RAW:
                end = RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in PARAGRAPH_ENDERS or tag in CLOSES:
                same = CLOSES.get(tag, ("p",))
                depth = last(same)
                if depth > max(scopes[-1] if scopes and open_[scopes[-1]][0] not in same else -1, last(t for t in STOPS[tag] if t not in same)):
                    close(depth)
            name, boiler = (step if len(attributes) < 1000 else step.__wrapped__)(tag, attributes)
            if tag in OWN_PARTS and places["article"]:
                boiler = step.__wrapped__("h1", attributes)[1]  # an article's own heading
            elif boiler == SOFT_CUT:
                boiler = HINT if places["article"] else CUT
            if boiler == CUT and dropped is None:
                flush()
                dropped = len(open_)
            places[tag].append(len(open_))
            if tag in SCOPES:
                scopes.append(len(open_))
            if tag in INLINE or dropped is not None:
                open_.append((tag, 0))
                links += tag == "a" and dropped is None
            else:
                flush()
                self.parents.append(container)
                self.keys.append(xxhash.xxh3_128_hexdigest(f"{self.keys[container]}/{name}"))
                self.names.append(name)
                self.hinted.append(self.hinted[container] or boiler == HINT)
                container = len(self.keys) - 1
                open_.append((tag, container))
        if dropped is None:
            flush()

    def _sums(self, worth: list[float], passed: float = 1.0) -> list[float]:
        """Each container's own number and ``passed`` of its children's sums, children's own numbers whole."""
        below, out = list(worth), list(worth)
        for n in range(len(worth) - 1, 0, -1):
            up = self.parents[n]
            out[up] += below[n]
            below[up] += passed * below[n]
        return out

    def _cut_links(self) -> None:
        """Drop the text of hinted containers that is mostly links."""
        excess = [0.0] * len(self.keys)
        for text, linked, number in self.blocks:
            excess[number] += 2 * linked - len(text)
        gone = [x > 0 and h for x, h in zip(self._sums(excess), self.hinted, strict=True)]
        for n in range(1, len(gone)):
            gone[n] = gone[n] or gone[self.parents[n]]
        self.blocks = [b for b in self.blocks if not gone[b[2]]]

    def best(self) -> int:
        """The container with the best score."""
        worth = [0.0] * len(self.keys)
        for text, linked, number in self.blocks:
            worth[number] += max(0, len(text) - 2 * linked) * (0.5 if self.hinted[number] else 1)
        scores = self._sums(worth, LEVEL)
        holds = [False] * len(self.keys)
        for _, _, number in self.blocks:
            holds[number] = True
        for n in range(len(holds) - 1, 0, -1):
            holds[self.parents[n]] |= holds[n]
        return max((n for n in range(len(scores)) if holds[n]), key=lambda n: (scores[n] * (1.5 if MEANT.search(self.names[n]) else 1.0), n), default=0)

    def under(self, key: str) -> str | None:
        """Text of the elements whose path has this hash; None if there are none with text."""
        inside = [k == key for k in self.keys]
        for n in range(1, len(inside)):
            inside[n] = inside[n] or inside[self.parents[n]]
        found = [text for text, _, number in self.blocks if inside[number]]
        return " ".join(found) if found else None

    def inside(self, number: int) -> str:
        below = [n == number for n in range(len(self.keys))]
        for n in range(1, len(below)):
            below[n] = below[n] or below[self.parents[n]]
        return " ".join(text for text, _, own in self.blocks if below[own])


def host() -> Column:
    """The url's host in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): pages whose best container has this path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for own, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                if page.blocks:
                    seen[own, page.keys[page.best()]] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["host", "path", "votes"])

    rows = pages.select(host().alias("host"), "html").mapInArrow(run, "host string, path string, votes long")
    return rows.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winners(votes: DataFrame) -> DataFrame:
    """(host, path): most votes; ties go to the smaller path."""
    most = votes.groupBy("host").agg(F.max("votes").alias("votes"))
    return votes.join(most, ["host", "votes"]).groupBy("host").agg(F.min("path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    workers_find_package(pages.sparkSession)
    won = stored(winners(host_votes(pages)))
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    few = won.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    rows = rows.join(F.broadcast(won) if few else won, "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page = Page(source or "")
                text = page.under(path) if path is not None else None
                out.append(page.inside(page.best()) if text is None else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
