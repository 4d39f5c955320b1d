"""Chunking (C1-C16). Packing and image placement are sequential within a text and run as
Arrow UDFs over batches of texts; everything around them is DataFrame expressions.

A document is a row (source_path, page, text, language, ...). ``chunks`` deduplicates by hash within a
run and carries section headings forward, so it takes the document order from ``seq``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from marlstone.functions.text import heading, language_hint, stripped, text_hash

SIZE, OVERLAP, LEAST = 700, 200, 60
HYBRID = {"size": 512, "overlap": 64}
API = {"size": 100, "overlap": 20}
PIECES_BYTES = 4 << 20  # of chunks, with what they repeat of their rows, that a task makes at a time
# --- Fixed values: sentence and break patterns ---
ARABIC_END = re.compile(r"(?<=[.!?؟،۔])\s+")
ENGLISH_END = re.compile(r"(?<=[.?!])(?=\s)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<!Mr\.)(?<!Mrs\.)(?<!Dr\.)(?<!Prof\.)(?<!Inc\.)(?<!Ltd\.)(?<!Co\.)(?<!Corp\.)(?<!vs\.)(?<!etc\.)\s+")  # what rules out most places comes first
ABBREVIATION = re.compile(r"^[A-Z][a-z]*\.$")
SOFT_BREAK = re.compile(r"[,;:،؛]\s+")
STOPS = ".!?؟۔"
SECTION_END = re.compile(r"(?<=[.!?؟،۔])\s+")


def sentences(text: str, language: str) -> list[str]:
    """Sentences; a fragment under ten characters joins the one before unless it is an abbreviation."""
    out: list[str] = []
    for part in map(str.strip, (ENGLISH_END if language == "english" else ARABIC_END).split(text)):
        if not part:
            continue
        if out and len(part) < 10 and not ABBREVIATION.match(part):
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return out


def halves(sentence: str, size: int) -> list[str]:
    """C4: an oversized sentence once, at the soft break nearest its middle, else between its words."""
    if len(sentence) <= size:
        return [sentence]
    breaks = [m.end() for m in SOFT_BREAK.finditer(sentence)]
    if breaks:
        middle = len(sentence) // 2
        at = min(breaks, key=lambda b: abs(b - middle))
        two = [sentence[:at].strip(), sentence[at:].strip()]
        return two if all(two) else [sentence]
    words = sentence.split()
    return [" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])] if len(words) > 1 else [sentence]


def tail(chunk: str, overlap: int) -> str:
    """What the next chunk repeats: from the next sentence, else the next word, within the last ``overlap`` characters."""
    if len(chunk) <= overlap:
        return chunk
    start = len(chunk) - overlap
    places = range(start, len(chunk))
    stop = next((i for i in places if chunk[i] in STOPS and chunk[i + 1 : i + 2].isspace()), None)
    if stop is not None:
        return chunk[stop + 2 :].strip()
    gap = next((i for i in places if chunk[i].isspace()), None)
    if not overlap:  # no room to search: all but the first word
        return (chunk.partition(" ")[2] or chunk).strip()
    return chunk[(start if gap is None else gap + 1) :].strip()


def packed(parts: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Sentences packed greedily; a chunk begins with the tail of the one before."""
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts:
        if not held and len(part) > size:
            out += halves(part, size)
            continue
        if held and length + len(part) > size:
            out.append(" ".join(held))
            again = tail(out[-1], overlap)
            held, length = ([again] if again.strip() else []), len(again)
        held.append(part)
        length += len(part) + 1
    return [*out, " ".join(held)] if held else out


def split_sentences(text: Column, language: Column) -> Column:
    """C1 as an expression."""

    @pandas_udf("array<string>")
    def split(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([sentences(t or "", lang) for t, lang in zip(texts, languages, strict=True)])

    return split(text, language)


def pieces(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, with_images: bool = False) -> DataFrame:
    """Raw chunks of each row of ``docs``: its columns but the text, ``chunk_index`` and ``chunk_text``. With
    ``with_images`` the marks of ``images`` are placed first. Other columns pass through as Arrow arrays."""
    keep = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_text", T.StringType())])
    shown = keep.index("images") if with_images else None

    def made(batch: pa.RecordBatch, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        rows, places, texts = zip(*found, strict=True)
        arrays = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keep))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(places, pa.int32()), pa.array(texts, pa.string())], [*keep, "chunk_index", "chunk_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, str]] = []
            held = 0
            for i in range(batch.num_rows):
                text, language = (batch.column(len(keep) + k)[i].as_py() for k in (0, 1))
                if with_images:
                    text = merged(text, batch.column(shown)[i].as_py() or [])
                beside = batch.slice(i, 1).nbytes  # each chunk repeats its row's other columns
                for place, part in enumerate(packed(sentences(text, language), size, overlap) if text.strip() else []):
                    found.append((i, place, part))
                    held += beside + len(part)
                    if held >= PIECES_BYTES:
                        yield made(batch, found)
                        found, held = [], 0
            if found:
                yield made(batch, found)

    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"), F.coalesce("language", F.lit("english")).alias("_language"))
    return rows.mapInArrow(run, schema)


def surviving(raw: DataFrame, run: str | None = None, least: int = LEAST, dedup: bool = True, always: Column | None = None) -> DataFrame:
    """C6/C7 after the split: drop short chunks and, within a run (all rows, or those of one ``run`` value), later
    copies; add hash, size, language and the heading carried forward among what survives. Rows of ``always`` are
    kept at any size.

    A copy's first place is a minimum per (run, hash), summed within tasks, so a text copied everywhere is no hot spot. What is told
    from a chunk's text is told before rows are shuffled, so that the text moves only if the caller wants it."""
    enough = F.col("chunk_size") >= least
    rows = raw.withColumn("chunk_size", F.length("chunk_text")).where(enough if always is None else enough | always).withColumn("chunk_hash", text_hash(F.col("chunk_text")))
    rows = rows.withColumn("language", language_hint(F.col("chunk_text"))).withColumn("_heading", F.nullif(heading(F.col("chunk_text")), F.lit("")))
    if dedup:
        scope = [run] if run else []
        first = rows.groupBy(*scope, "chunk_hash").agg(F.min(F.struct("seq", "chunk_index")).alias("_first"))
        rows = rows.join(first, [*scope, "chunk_hash"]).where(F.struct("seq", "chunk_index") == F.col("_first")).drop("_first")
    carried = Window.partitionBy("seq").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chunk_context", F.coalesce(F.last("_heading", ignorenulls=True).over(carried), F.lit(""))).drop("_heading")
    return rows if "language" in raw.columns else rows.select(*[c for c in rows.columns if c != "language"], "language")


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, run: str | None = None, dedup: bool = True) -> DataFrame:
    """Chunks of (seq, text, language, ...)."""
    return surviving(pieces(docs, size, overlap), run, least, dedup)


# --- documents with images ---
def later_wins(a: Column, b: Column) -> Column:
    """Both maps' entries; ``b`` wins where keys meet; null is empty."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    b = F.coalesce(b, none)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def hybrid_documents(raw: DataFrame) -> DataFrame:
    """One row for each (source_path, page) of (seq, source_path, page, source_type, image_index, text, metadata map):
    its texts joined, metadata merged (last wins) and images with text; rows with neither are dropped."""
    image = F.col("source_type").endswith("_embedded_image")
    text = F.when(~image, F.struct("seq", F.when(stripped(F.col("text")) != "", F.col("text")).alias("text"), "metadata"))
    shown = F.when(image & (stripped(F.col("text")) != ""), F.struct(F.coalesce("image_index", F.lit(0)).alias("image_index"), "seq", F.col("text").alias("image_text"), "source_type"))
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    rows = raw.withColumns({"source_path": F.coalesce("source_path", F.lit("")), "page": F.coalesce("page", F.lit(1)), "source_type": F.coalesce("source_type", F.lit(""))})
    out = rows.groupBy("source_path", "page").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(text), by_seq).alias("texts"), F.array_sort(F.collect_list(shown)).alias("images"))
    merge = F.aggregate("texts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, t: later_wins(m, t["metadata"]))
    out = out.select(
        "seq", "source_path", "page",
        stripped(F.array_join(F.filter(F.transform("texts", lambda t: t["text"]), lambda t: t.isNotNull()), "\n\n")).alias("text"),
        F.transform("images", lambda i: F.struct(i["image_index"].cast("int").alias("image_index"), i["image_text"], i["source_type"])).alias("images"),
        merge.alias("metadata"),
    )
    return out.where((F.col("text") != "") | (F.size("images") > 0))


def sections(text: str) -> list[str]:
    """Paragraphs, else lines, else sentences, else two halves, else the whole."""
    for parts, least in ((text.split("\n\n"), 2), (text.split("\n"), 4), (SECTION_END.split(text), 3)):
        found = [p.strip() for p in parts if p.strip()]
        if len(found) >= least:
            return found
    if len(text) > 500:
        ways = [(r"\n\n", re.Match.start), (r"\n", re.Match.start), (r"[.!?؟،۔]\s+", re.Match.end), (r"\s+", re.Match.start)]
        breaks = next((b for p, at in ways if (b := [at(m) for m in re.finditer(p, text)])), [])
        if breaks:
            cut = min(breaks, key=lambda b: abs(b - len(text) // 2))
            two = [text[:cut].strip(), text[cut:].strip()]
            if cut > 100 and len(text) - cut > 100 and all(two):
                return two
    return [text]


def image_mark(image: dict) -> str:
    """C12."""
    shown = image["image_text"].strip()
    return f"[Image {image['image_index']}: {shown if len(shown) <= 300 else shown[:297] + '...'}]"


def image_text(image: Column) -> Column:
    """C12 as an expression."""
    shown = stripped(image["image_text"])
    shown = F.when(F.length(shown) > 300, F.concat(F.substring(shown, 1, 297), F.lit("..."))).otherwise(shown)
    return F.concat(F.lit("[Image "), image["image_index"].cast("string"), F.lit(": "), shown, F.lit("]"))


def spread_images(text: str, images: list[dict]) -> str:
    """C11: images at even distances, each moved to the nearest break around its place."""
    places = []
    for i in range(len(images)):
        target = at = int((i + 1) * len(text) / (len(images) + 1))
        for away in range(min(50, len(text) // 10)):
            near = [p for p in (target - away, target + away) if 0 <= p < len(text) and text[p] in " \n.!?"]
            if near:
                at = near[0]
                if at != target:
                    break
        places.append(at)
    for at, image in sorted(zip(places, images, strict=True), key=lambda x: x[0], reverse=True):
        text = f"{text[:at]}\n\n{image_mark(image)}\n\n{text[at:]}"
    return text


def merged(text: str, images: list[dict]) -> str:
    """Image marks between the sections of a text, evenly."""
    images = sorted(images, key=lambda i: i["image_index"])
    if not images:
        return text
    parts = sections(text)
    if len(parts) <= 1:
        return spread_images(text, images)
    n, s = len(images), len(parts)
    after = [0] * s
    if n >= s:
        after = [n // s + (i < n % s) for i in range(s)]
    else:
        for position in {((k + 1) * s) // (n + 1) for k in range(n)}:
            if position:
                after[position - 1] = 1
    marks = list(map(image_mark, images))
    out: list[str] = []
    for part, count in zip(parts, after, strict=True):
        out += [part, *marks[:count]]
        marks = marks[count:]
    return "\n\n".join(out + marks)


def hybrid_chunks(raw: DataFrame, size: int = HYBRID["size"], overlap: int = HYBRID["overlap"], least: int = LEAST, run: str | None = None) -> DataFrame:
    """Chunks of documents with images. Pages of text and images chunk their merged text; images
    without text are a chunk each; flags and the images that a chunk mentions are columns."""
    docs = hybrid_documents(raw)
    docs = docs.withColumn("language", F.coalesce(F.col("metadata")["language"], F.lit("english")))
    raw_text = pieces(docs.where(F.col("text") != ""), size, overlap, with_images=True).withColumn("is_image_only", F.lit(False))
    alone = docs.where(F.col("text") == "").select("*", F.posexplode("images").alias("chunk_index", "image"))
    alone = alone.select(*[c for c in docs.columns if c not in ("text", "images")], F.array("image").alias("images"), "chunk_index", image_text(F.col("image")).alias("chunk_text"), F.lit(True).alias("is_image_only"))
    rows = raw_text.unionByName(alone)
    mentioned = F.filter("images", lambda i: F.col("is_image_only") | F.col("chunk_text").contains(F.concat(F.lit("[Image "), i["image_index"].cast("string"), F.lit(":"))))
    preview = lambda t: F.when(F.length(t) > 100, F.concat(F.substring(t, 1, 100), F.lit("..."))).otherwise(t)
    # before rows are shuffled, as a page's images with their whole texts stand beside each of its chunks
    shown = F.transform(mentioned, lambda i: F.struct(i["image_index"].alias("image_index"), i["source_type"].alias("source_type"), preview(i["image_text"]).alias("text_preview")))
    rows = surviving(rows.withColumn("referenced_images", shown).drop("images"), run, least, always=F.col("is_image_only"))
    rows = rows.withColumn("chunk_context", F.when(F.col("is_image_only"), "").otherwise(F.col("chunk_context")))
    return rows.select(
        *[c for c in rows.columns if c != "referenced_images"],
        F.lit(True).alias("is_hybrid"),
        "referenced_images",
        F.size("referenced_images").alias("image_count"),
        (F.size("referenced_images") > 0).alias("has_images"),
    )


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """C14: split before each occurrence of the coarsest separator present (which stays with the part that it begins), split
    parts of ``size`` or more by the finer ones, and gather the shorter ones with overlap."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    first, *rest = text.split(sep) if sep else list(text) or [""]
    out: list[str] = []
    held: list[str] = []
    for part in filter(None, [first, *(sep + p for p in rest)]):
        if len(part) < size:
            held.append(part)
            continue
        out += gathered(held, size, overlap)
        held = []
        out += recursive_split(part, size, overlap, finer) if finer else [part]
    return out + gathered(held, size, overlap)


def gathered(parts: list[str], size: int, overlap: int) -> list[str]:
    """Runs of parts of up to ``size`` characters; a run begins with the last parts of the one before, up to ``overlap``."""
    out: list[str] = []
    low, length = 0, 0  # the run is parts[low:high]
    for high, part in enumerate(parts):
        if length + len(part) > size and low < high:
            out.append("".join(parts[low:high]))
            while low < high and (length > overlap or length + len(part) > size):
                length -= len(parts[low])
                low += 1
        length += len(part)
    out.append("".join(parts[low:]))
    return [x for x in map(str.strip, out) if x]


def fallback_udf(size: int, overlap: int):
    """C14 over a text column."""

    @pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([recursive_split(t or "", size, overlap) for t in texts])

    return split


def line_chunks(texts: list[str], size: int) -> list[str]:
    """Lines of all texts, gathered until ``size`` is reached."""
    out, held = [], ""
    for line in (x.strip() for x in " ".join(texts).split("\n")):
        if len(line) <= 1:
            continue
        held += line + "\n"
        if len(held) >= size:
            out.append(held.strip())
            held = ""
    return [*out, held.strip()] if held.strip() else out
