"""Text functions, Column to Column (T1-T21). Only NFC normalisation needs Python."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- Fixed values: patterns, word lists and thresholds that results depend on ---
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ARABIC, LATIN = r"[؀-ۿ]", r"[A-Za-z]"
ARABIC_ABOVE, ENGLISH_BELOW = 0.65, 0.25
IMAGE_ONLY_BELOW = 20
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # Unicode's White_Space
TOKEN = r"(?U)[\w؀-ۿ]{2,}+"
DOMAINS = {
    "IoT and Technology": ["iot", "internet of things", "sensor", "device"],
    "Legal": ["legal", "law", "contract", "agreement"],
    "Medical": ["medical", "health", "patient", "clinical"],
    "Business": ["business", "management", "strategy"],
}
REFUSALS = [
    "don't have", "don't know", "cannot answer", "not available", "insufficient information", "not found in", "no information", "unable to answer", "not enough information",
    "cannot provide", "not directly relevant", "does not seem to be", "lack sufficient", "cannot determine", "unclear from", "not specified", "i don't have", "i cannot", "i'm unable",
]
ABSTENTIONS = [
    "don't have", "do not have", "cannot answer", "not available", "insufficient information", "not found in", "no information", "unable to answer", "not enough information",
    "cannot provide", "not in the document", "لا تحتوي", "لا يوجد", "غير متاح",
]
RATE_LIMITS = ["429", "toomanyrequests", "rate limit", "quota", "limit exceeded", "too many requests"]
QUERY_PREFIXES = [
    r"^Consider\s+[\"']?[^\"']+[\"']?'?s?\s+privacy\s+policy[;:,]\s*",
    r"^According\s+to\s+[\"']?[^\"']+[\"']?[;:,]\s*",
    r"^In\s+[\"']?[^\"']+[\"']?'?s?\s+policy[;:,]\s*",
    r"^Based\s+on\s+[\"']?[^\"']+[\"']?[;:,]\s*",
]
QUERY_FOCUS = {
    r"\b(passed|shared|exchanged|transferred)\s+(between|among|with)\s+users\b": "user-to-user information sharing",
    r"\b(visible|accessible|available)\s+to\s+(all\s+)?users\b": "information visible to users",
    r"\b(public|publicly\s+available)\b.*\busers?\b": "public user information",
}
MIDDLE_CUT = "\n\n...[MIDDLE CONTENT TRUNCATED DUE TO LENGTH]...\n\n"
CONTEXT_MARKS = {"english": "[Context: ", "arabic": "[السياق: "}
HEADING = r"(?mid)^(?:(?:Article|Section|Chapter|Clause|مادة|باب|فصل|بند)\s*\d+|(?:\d+\.)+\s+|[A-Z][A-Z\s]{2,}$)"
NUMBER, PROPER = r"\d+(?:\.\d+)?", r"\b[A-Z][a-z]+\b"


def stripped(c: Column) -> Column:
    """Without white space (as Unicode has it) at either end."""
    return F.btrim(c, F.lit(SPACES))


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    """Composed form of each text; null where it is the text itself."""
    out = (None if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in (x.as_py() for x in texts))
    return pa.array(out, pa.string())


def nfc(c: Column) -> Column:
    """Composed form. Text below U+0300 is composed already and stays in the JVM's hands: a call in a branch is made for all rows, so such texts are nulls
    to it. Only texts that change come back."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-˿]"), c)), c)


def clean_text(c: Column, compose: bool = True) -> Column:
    """NFC, control characters to blanks, at most one empty line, single blanks, stripped; null is empty."""
    out = F.coalesce(c, F.lit(""))
    out = nfc(out) if compose else out
    for pattern, by in ((CONTROL, " "), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        out = F.regexp_replace(out, pattern, by)
    return stripped(out)


def script_counts(c: Column) -> tuple[Column, Column]:
    return F.regexp_count(c, F.lit(ARABIC)), F.regexp_count(c, F.lit(LATIN))


def language_hint(c: Column) -> Column:
    """Arabic, english, mixed or unknown by the share of Arabic letters."""
    arabic, latin = script_counts(F.coalesce(c, F.lit("")))
    share = arabic / (arabic + latin)
    return F.when(arabic + latin == 0, "unknown").when(share > ARABIC_ABOVE, "arabic").when(share < ENGLISH_BELOW, "english").otherwise("mixed")


def is_image_only(c: Column) -> Column:
    """Under 20 characters after stripping."""
    return F.length(stripped(F.coalesce(c, F.lit("")))) < IMAGE_ONLY_BELOW


def question_language(c: Column) -> Column:
    """T4: ar, en or unknown by the more frequent script."""
    arabic, latin = script_counts(F.coalesce(c, F.lit("")))
    return F.when(arabic > latin, "ar").when(latin > 0, "en").otherwise("unknown")


def contains_any(c: Column, words: list[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def domain(c: Column) -> Column:
    """T5: the first domain of which a word is a substring."""
    out = F
    for name, words in DOMAINS.items():
        out = out.when(contains_any(c, words), name)
    return out.otherwise("General")


def text_hash(c: Column) -> Column:
    """16 hex digits of SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def text_key(c: Column) -> Column:
    """12 hex digits of SHA-256 over the first 200 characters."""
    return F.substring(F.sha2(F.substring(c, 1, 200).cast("binary"), 256), 1, 12)


def truncated(c: Column, n: int) -> Column:
    """T8."""
    return F.substring(c, 1, n)


def fitted(c: Column, limit: int = 20_000, prompt: bool = False) -> Column:
    """Cut to ``limit`` (20,000 at least); a prompt keeps its first 70 % and last 30 %."""
    limit = max(limit, 20_000)
    top, bottom = int(limit * 0.7), int(limit * 0.3)
    cut = F.concat(F.substring(c, 1, top), F.lit(MIDDLE_CUT), F.substring(c, -bottom, bottom)) if prompt else F.substring(c, 1, limit)
    return stripped(F.when(F.length(c) <= limit, c).otherwise(cut))


def bm25_tokens(c: Column) -> Column:
    """Lower-case words of two characters or more; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def simplified_query(c: Column) -> Column:
    """Without context prefixes, with the first matching focus; the original if nothing changed or little is left."""
    out = c
    for p in QUERY_PREFIXES:
        out = F.regexp_replace(out, f"(?i){p}", "")
    focus = F
    for p, name in QUERY_FOCUS.items():
        focus = focus.when(out.rlike(f"(?i){p}"), F.concat(out, F.lit(f" (focus: {name})")))
    out = focus.otherwise(out)
    return F.when((out != c) & (F.length(stripped(out)) > 10), stripped(out)).otherwise(c)


def without_fences(c: Column) -> Column:
    return stripped(F.regexp_replace(c, "```(?:json)?", ""))


def parsed_list(c: Column) -> Column:
    """The strings of a reply that should be a JSON array; else its lines, without numbering."""
    clean = without_fences(F.coalesce(c, F.lit("")))
    texts = lambda s: F.filter(F.transform(F.from_json(s, "array<string>"), stripped), lambda q: q != "")
    inner = F.regexp_extract(clean, r"(?s)\[.*?\]", 0)
    is_list = lambda s: s.rlike(r"(?s)^\s*\[") & F.from_json(s, "array<string>").isNotNull()
    lines = F.filter(F.split(clean, "\n"), lambda x: (stripped(x) != "") & ~stripped(x).rlike(r"^[#\-*\[\]]"))
    lines = F.filter(F.transform(lines, lambda x: stripped(F.regexp_replace(x, r"^\d+[\.\)]\s*", ""))), lambda x: F.length(x) > 5)
    return F.when(is_list(clean), texts(clean)).when(is_list(inner), texts(inner)).otherwise(lines)


def judge_score(c: Column) -> Column:
    """The score of a judge's reply within [0, 1]; else its first number of that form; else 0."""
    clean = without_fences(F.coalesce(c, F.lit("")))
    own = F.get_json_object(clean, "$.score").try_cast("double")
    number = F.regexp_extract(clean, r"\b(0\.\d+|1\.0|0|1)\b", 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(own, number, F.lit(0.0))))


def json_block(c: Column) -> Column:
    """The outermost {...} of a reply, if it is JSON; else null."""
    block = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(block).isNotNull() & (block != ""), block)


def heuristic_verdict(prompt: Column, reply: Column) -> Column:
    """Yes or no from a reply that is not JSON."""
    p, r = F.lower(prompt), F.lower(reply)
    has = lambda x, *words: contains_any(x, list(words))
    return (
        F.when(has(p, "grounded", "hallucinat"), F.when(has(r, "not grounded", "hallucinat", "contradict"), "no").otherwise("yes"))
        .when(has(r, "not relevant", "does not answer", "does not resolve"), "no")
        .when(has(r, "yes", "relevant", "resolves"), "yes")
        .otherwise("no")
    )


def is_rate_limit(c: Column) -> Column:
    """T16."""
    return contains_any(c, RATE_LIMITS)


def refuses(c: Column) -> Column:
    """T17, the evaluator's list."""
    return contains_any(c, REFUSALS)


def abstains(c: Column) -> Column:
    """T17, the metrics' list."""
    return contains_any(c, ABSTENTIONS)


def numbers(c: Column) -> Column:
    """The set of numbers."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0)))


def proper_nouns(c: Column) -> Column:
    """The set of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)" + PROPER), F.lit(0)))


FOOTERS = {
    "factual": "State the fact and name the document it comes from.",
    "analytical": "Reason step by step over the documents before you conclude.",
    "comparative": "Set the alternatives side by side and say where they differ.",
    "summarization": "Give the main points only.",
    "hallucination": "If the documents do not say, answer that they do not.",
}
FOOTER = {"en": "Answer from the documents above only.", "ar": "أجب من المستندات أعلاه فقط."}


def document_block(number: Column, text: Column) -> Column:
    """One numbered document of a prompt."""
    return F.concat(F.lit("## Document No: "), number.cast("string"), F.lit("\n### Content: "), text)


def prompt(question: Column, texts: Column, question_type: Column, language: str = "en") -> Column:
    """Documents, question and the footer of its type; an unknown type or locale takes the default."""
    blocks = F.array_join(F.transform(texts, lambda t, i: document_block(i + 1, t)), "\n\n")
    footer = F
    for kind, words in FOOTERS.items():
        footer = footer.when(question_type == kind, words)
    footer = footer.otherwise(FOOTER.get(language, FOOTER["en"])) if language == "en" else F.lit(FOOTER.get(language, FOOTER["en"]))
    return F.concat_ws("\n\n", blocks, F.concat(F.lit("## Question: "), question), footer)


def excerpt(texts: Column) -> Column:
    """Up to five chunks whole, else the first three and last two."""
    return F.array_join(F.when(F.size(texts) <= 5, texts).otherwise(F.concat(F.slice(texts, 1, 3), F.slice(texts, -2, 2))), "\n\n")


def has_context(c: Column) -> Column:
    return c.contains("[Context:") | c.contains("[السياق:")


def contextualized(text: Column, language: Column, summary: Column, least: int = 80) -> Column:
    """The text with its context in front, unless it has one, is short, or there is no summary."""
    mark = F.when(language == "arabic", CONTEXT_MARKS["arabic"]).otherwise(CONTEXT_MARKS["english"])
    skip = has_context(text) | (F.length(stripped(text)) < least) | F.coalesce(stripped(summary), F.lit("")).eqNullSafe("")
    return F.when(skip, text).otherwise(F.concat(mark, stripped(summary), F.lit("]\n\n"), text))


def heading(c: Column) -> Column:
    """The first structural heading, to the end of its line, up to 120 characters."""
    at = F.regexp_instr(c, F.lit(HEADING))
    line = F.substring_index(c.substr(at, F.length(c)), "\n", 1)
    return F.when(F.regexp_like(c, F.lit(HEADING)), F.substring(stripped(line), 1, 120)).otherwise("")


def clean_file_name(c: Column) -> Column:
    """K9: word characters and dots only."""
    return F.regexp_replace(stripped(c), r"(?U)[^\w.]", "")
