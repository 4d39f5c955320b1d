"""Loaders (S1-S10, S13): files and pages to raw documents (source_path, page, text, source_type, ...)."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import clean_text, is_image_only, language_hint
from marlstone.sources.html import extract_main
from marlstone.sources.images import html_tables
from marlstone.sources.pdf import page_texts

# --- Fixed values: loaders by suffix ---
SUFFIXES = {
    "pdf": [".pdf"], "word": [".docx", ".doc"], "powerpoint": [".pptx", ".ppt"],
    "image": [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp"], "text": [".txt"],
}
#: Where Windows-1252 differs from Latin-1.
_PAIRS = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
CP1252 = ["".join(x) for x in zip(*(p for p in _PAIRS if p[1]), strict=True)]
RAW = "source_path string, page int, total_pages int, text string, source_type string, image_index int, image_data binary"
CONFIDENT = 40
W, A, P = ("{http://schemas.openxmlformats.org/%s/2006/main}" % x for x in ("wordprocessingml", "drawingml", "presentationml"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def loader_of(path: Column) -> Column:
    """The loader for a path; null for suffixes that none reads."""
    out = F
    for name, ends in SUFFIXES.items():
        out = out.when(suffix(path).isin(ends), name)
    return out.otherwise(F.lit(None))


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, content) of a folder's files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content", "length")


def decoded(content: Column) -> tuple[Column, Column]:
    """(text, encoding): UTF-8 if valid, else Windows-1252 unless it has bytes that page leaves open, else Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    open_bytes = F.hex(content).rlike("^(?:..)*(?:81|8D|8F|90|9D)")
    encoding = F.when(utf8.isNotNull(), "utf-8").when(~open_bytes, "cp1252").otherwise("latin-1")
    latin = F.decode(content, "ISO-8859-1")
    other = F.when(~open_bytes, F.translate(latin, CP1252[0], CP1252[1])).otherwise(latin)
    return F.coalesce(utf8, other), encoding


def text_documents(df: DataFrame) -> DataFrame:
    """S5 for (path, content): cleaned texts, empty ones dropped."""
    text, encoding = decoded(F.col("content"))
    out = df.select(F.col("path").alias("source_path"), F.lit(1).alias("page"), clean_text(text).alias("text"), F.lit("text").alias("source_type"), encoding.alias("encoding"))
    return out.where("text <> ''").withColumn("language", language_hint(F.col("text")))


def image_documents(df: DataFrame) -> DataFrame:
    """An empty document for each image, to be read by OCR."""
    return df.select(F.col("path").alias("source_path"), F.lit(1).alias("page"), F.lit("").alias("text"), F.lit("image").alias("source_type"), F.lit(True).alias("needs_ocr"), F.col("content").alias("image_data"))


def _word(path: str, blob: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
        lines = [t for p in body.findall(f"{W}p") if (t := text(p).strip())]
        for row in body.iter(f"{W}tr"):
            cells = [t for c in row.findall(f"{W}tc") if (t := text(c).strip())]
            if cells:
                lines.append(" | ".join(cells))
        if lines:
            yield path, 1, 1, "\n".join(lines), "word", None, None
        for i, name in enumerate(sorted(n for n in z.namelist() if n.startswith("word/media/"))):
            yield path, 1, 1, "", "word_embedded_image", i, z.read(name)


def _slides(path: str, blob: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        lines = lambda name: [t for p in ET.fromstring(z.read(name)).iter(f"{A}p") if (t := "".join(r.text or "" for r in p.iter(f"{A}t")).strip())]
        for k, name in enumerate(names, 1):
            text = lines(name)
            notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
            if notes in z.namelist() and (said := " ".join(lines(notes))):
                text.append(f"[Notes] {said}")
            yield path, k, len(names), "\n".join(text), "powerpoint", None, None
            rels = f"ppt/slides/_rels/slide{number(name)}.xml.rels"
            if rels in z.namelist():
                media = [r.get("Target") for r in ET.fromstring(z.read(rels)) if "/image" in r.get("Type", "")]
                for i, target in enumerate(media):
                    yield path, k, len(names), "", "powerpoint_embedded_image", i, z.read(f"ppt/{target.removeprefix('../')}")


def _pdf(path: str, blob: bytes) -> Iterator[tuple]:
    try:
        import fitz  # optional: images, and fonts that the plain reader cannot map
    except ImportError:
        texts = page_texts(blob)
        yield from ((path, k, len(texts), text, "pdf", None, None) for k, text in enumerate(texts, 1))
        return
    doc = fitz.open(stream=blob, filetype="pdf")
    if doc.is_encrypted and not doc.authenticate(""):
        return
    for k, page in enumerate(doc, 1):
        text = page.get_text("text")
        yield path, k, len(doc), text, "pdf", None, None
        if len(text.strip()) >= 20:
            for i, image in enumerate(page.get_images(full=True)):
                yield path, k, len(doc), "", "pdf_embedded_image", i, doc.extract_image(image[0])["image"]


def office_documents(df: DataFrame) -> DataFrame:
    """S1-S3 for (path, content): a row for each page or slide, and for each image in it. Broken files give no rows."""
    readers = {"word": _word, "powerpoint": _slides, "pdf": _pdf}
    kinds = {s: readers[k] for k, v in SUFFIXES.items() if k in readers for s in v}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, blob in zip(batch["path"], batch["content"], strict=True):
                reader = kinds.get(("." + path.rpartition(".")[2]).lower())
                try:
                    rows = list(reader(path, bytes(blob))) if reader else []
                except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError, ValueError):
                    rows = []
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])

    out = df.select("path", "content").mapInPandas(run, RAW)
    out = out.withColumn("text", clean_text(F.col("text")))
    return out.withColumns({"needs_ocr": is_image_only(F.col("text")) & ((F.col("source_type") == "pdf") | F.col("image_data").isNotNull()), "language": language_hint(F.col("text"))}).where((F.col("text") != "") | F.col("needs_ocr") | (F.col("source_type") == "powerpoint"))


def page_documents(pages: DataFrame) -> DataFrame:
    """S6 for (url, html): main text of HTML pages with http(s) addresses; source is the host."""
    ok = pages.where(F.col("url").rlike("^https?://"))
    out = ok.select(*[c for c in pages.columns if c != "html"], F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("source"), clean_text(extract_main(F.coalesce("html", F.lit("")))).alias("text"))
    return out.where("text <> ''").withColumn("language", language_hint(F.col("text")))


def ocr_text(words: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """(image_id, text) of recognised (image_id, seq, word, conf): confident words in order, joined by blanks."""
    sure = words.where((F.col("conf") >= least) & (F.trim("word") != ""))
    return sure.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x["word"]), " ").alias("text"))


def with_ocr(docs: DataFrame, provider) -> DataFrame:
    """Documents that need it, with recognised text; ``ocr_applied`` tells which; image bytes are dropped."""

    @F.pandas_udf("string")
    def read(images: pd.Series) -> pd.Series:
        found = provider.words([bytes(x) if x is not None else b"" for x in images])
        return pd.Series([" ".join(w for w, conf in ws if conf >= CONFIDENT and w.strip()) for ws in found])

    out = docs.withColumn("ocr_applied", F.col("needs_ocr")).withColumn("text", F.when(F.col("needs_ocr"), clean_text(read("image_data"))).otherwise(F.col("text")))
    return out.withColumn("language", language_hint(F.col("text"))).drop("image_data")


def table_text(rows: Column, page: Column, number: Column) -> Column:
    """A table as text: cells by " | ", null cells empty, rows without content dropped."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    lines = F.transform(F.filter(cells, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, " | "))
    return F.concat(F.lit("[TABLE: page "), page.cast("string"), F.lit(", table "), number.cast("string"), F.lit("]\n"), F.array_join(lines, "\n"))


def page_tables(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """S9 for (key, html): (key, number, rows, text) of every table on a page."""

    @F.pandas_udf("array<array<array<string>>>")
    def found(html: pd.Series) -> pd.Series:
        return html.map(html_tables)

    rows = pages.select(key, F.posexplode(found("html")).alias("at", "rows"))
    return rows.select(key, (F.col("at") + 1).alias("number"), "rows", table_text(F.col("rows"), F.col(key), F.col("at") + 1).alias("text"))
