"""Queries over text functions, chunking, sources and stores, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import chunking
from marlstone.session import small_batches
from marlstone.sources import loaders, store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_any(c: str, words: list[str]) -> str:
    return f"list_bool_or(list_transform([{quoted(words)}], lambda p: contains(lower({c}), p)))"


STRIP = r"regexp_replace({0}, '^[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}\x{{3000}}]+|[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '', 'g')"
CLEAN = STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")
ARABIC = r"len(regexp_extract_all({0}, '[\x{{0600}}-\x{{06FF}}]'))"
LATIN = "len(regexp_extract_all({0}, '[A-Za-z]'))"
TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s\x{{0600}}-\x{{06FF}}]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2)"


@query(f"""SELECT doc_id, {CLEAN} AS cleaned, length({CLEAN}) < 20 AS image_only FROM documents""")
def clean_text(spark, d):
    """T1, T3."""
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"), T.is_image_only(F.col("text")).alias("image_only"))


@query(f"""WITH c AS (SELECT doc_id, {ARABIC.format('text')} AS a, {LATIN.format('text')} AS l FROM documents)
SELECT doc_id, CASE WHEN a + l = 0 THEN 'unknown' WHEN a / (a + l) > 0.65 THEN 'arabic' WHEN a / (a + l) < 0.25 THEN 'english' ELSE 'mixed' END AS hint,
    CASE WHEN a > l THEN 'ar' WHEN l > 0 THEN 'en' ELSE 'unknown' END AS question_language FROM c""")
def language_hints(spark, d):
    """T2, T4."""
    return table(spark, d, "documents").select("doc_id", T.language_hint(F.col("text")).alias("hint"), T.question_language(F.col("text")).alias("question_language"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash, substr(sha256(substr(text, 1, 200)), 1, 12) AS key, substr(text, 1, 512) AS head FROM documents")
def text_keys(spark, d):
    """T6, T7, T8."""
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.text_hash(c).alias("hash"), T.text_key(c).alias("key"), T.truncated(c, 512).alias("head"))


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {sql_any('text', w)} THEN '{n}'" for n, w in T.DOMAINS.items()) + " ELSE 'General' END AS domain FROM conversations")
def domains(spark, d):
    """T5."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.domain(F.col("text")).alias("domain"))


@query(f"""WITH t AS (SELECT doc_id, repeat(text, 1 + (22000 // greatest(1, length(text)))) AS text FROM documents)
SELECT doc_id, {STRIP.format("CASE WHEN length(text) <= 20000 THEN text ELSE substr(text, 1, 20000) END")} AS plain,
    {STRIP.format("CASE WHEN length(text) <= 20000 THEN text ELSE substr(text, 1, 14000) || '" + T.MIDDLE_CUT + "' || right(text, 6000) END")} AS prompt FROM t""")
def process_text(spark, d):
    """T9, on documents repeated until they are too long."""
    rows = table(spark, d, "documents").selectExpr("doc_id", "repeat(text, cast(1 + (22000 div greatest(1, length(text))) as int)) as text")
    return rows.select("doc_id", T.fitted(F.col("text")).alias("plain"), T.fitted(F.col("text"), prompt=True).alias("prompt"))


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, md5(array_to_string({TOKENS.format('text')}, ' ')) AS digest FROM documents")
def bm25_tokens(spark, d):
    """T10."""
    ts = T.bm25_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(ts).cast("long").alias("n_tokens"), F.md5(F.array_join(ts, " ").cast("binary")).alias("digest"))


@query("""SELECT item_id, 'is it shared between users ' || text || ' (focus: user-to-user information sharing)' AS simplified, text AS plain FROM benchmark""")
def simplified_queries(spark, d):
    """T11, on benchmark items behind a prefix, with a phrase to focus on; and as they are."""
    asked = F.concat(F.lit('According to "the policy", is it shared between users '), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", T.simplified_query(asked).alias("simplified"), T.simplified_query(F.col("text")).alias("plain"))


@query("""SELECT conv_id, turn, ['first ' || turn, 'second query'] AS fenced, ['inner one'] AS inner_list, ['numbered line', 'another line'] AS lines FROM conversations""")
def parsed_lists(spark, d):
    """T12, on three forms of reply."""
    fenced = F.concat(F.lit('```json\n["first '), F.col("turn").cast("string"), F.lit('", " second query ", ""]\n```'))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", T.parsed_list(fenced).alias("fenced"), T.parsed_list(F.lit('Here you are: ["inner one"] as asked')).alias("inner_list"),
        T.parsed_list(F.lit("1. numbered line\n- skipped line\n2) another line\nshort")).alias("lines"),
    )


@query("""SELECT conv_id, turn, least(1.0, turn / 4.0) AS from_json, 0.75::DOUBLE AS from_text, 0.0::DOUBLE AS from_nothing, '{"a": {"b": 1}}' AS block FROM conversations""")
def judge_scores(spark, d):
    """T13, T14."""
    reply = F.concat(F.lit('```json\n{"score": '), (F.col("turn") / 4.0).cast("string"), F.lit("}\n```"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", T.judge_score(reply).alias("from_json"), T.judge_score(F.lit("I say 0.75 of 1")).alias("from_text"), T.judge_score(F.lit("none")).alias("from_nothing"),
        T.json_block(F.lit('Sure: {"a": {"b": 1}} done')).alias("block"),
    )


@query(f"""WITH t AS (SELECT conv_id, turn, lower(text) AS t, text FROM conversations)
SELECT conv_id, turn,
    CASE WHEN contains(t, 'not grounded') OR contains(t, 'hallucinat') OR contains(t, 'contradict') THEN 'no' ELSE 'yes' END AS grounded,
    CASE WHEN contains(t, 'not relevant') OR contains(t, 'does not answer') OR contains(t, 'does not resolve') THEN 'no'
        WHEN contains(t, 'yes') OR contains(t, 'relevant') OR contains(t, 'resolves') THEN 'yes' ELSE 'no' END AS relevant,
    {sql_any('t', T.RATE_LIMITS)} AS rate_limit, {sql_any('t', T.REFUSALS)} AS refuses, {sql_any('t', T.ABSTENTIONS)} AS abstains FROM t""")
def verdicts(spark, d):
    """T15, T16, T17."""
    c = F.col("text")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", T.heuristic_verdict(F.lit("Is it grounded?"), c).alias("grounded"), T.heuristic_verdict(F.lit("Is it useful?"), c).alias("relevant"),
        T.is_rate_limit(c).alias("rate_limit"), T.refuses(c).alias("refuses"), T.abstains(c).alias("abstains"),
    )


@query(r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?'))) AS numbers,
    list_sort(list_distinct(list_filter(string_split(regexp_replace(text, '[^\p{L}\p{M}\p{N}_]+', '  ', 'g'), '  '), lambda t: regexp_full_match(t, '[A-Z][a-z]+')))) AS proper_nouns FROM documents""")
def facts(spark, d):
    """Numbers and proper nouns."""
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_sort(T.numbers(c)).alias("numbers"), F.array_sort(T.proper_nouns(c)).alias("proper_nouns"))


@query(f"""WITH t AS (SELECT item_id, text, ['alpha ' || item_id, 'beta'] AS docs FROM benchmark)
SELECT item_id, '## Document No: 1' || chr(10) || '### Content: ' || docs[1] || chr(10) || chr(10) || '## Document No: 2' || chr(10) || '### Content: beta' || chr(10) || chr(10) || '## Question: ' || text
    || chr(10) || chr(10) || '{T.FOOTERS["factual"]}' AS prompt FROM t""")
def prompts(spark, d):
    """T19."""
    docs = F.array(F.concat(F.lit("alpha "), F.col("item_id").cast("string")), F.lit("beta"))
    return table(spark, d, "benchmark").select("item_id", T.prompt(F.col("text"), docs, F.lit("factual")).alias("prompt"))


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(CASE WHEN len(t) <= 5 THEN t ELSE t[1:3] || t[-2:] END, chr(10) || chr(10)) AS excerpt FROM c""")
def excerpts(spark, d):
    """T20."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return rows.select("conv_id", T.excerpt(F.col("t")).alias("excerpt"))


@query(f"""WITH t AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'arabic' WHEN 1 THEN 'english' ELSE 'mixed' END AS language FROM documents)
SELECT doc_id, CASE WHEN length({STRIP.format('text')}) < 80 THEN text ELSE (CASE WHEN language = 'arabic' THEN '[السياق: ' ELSE '[Context: ' END) || 'about ' || doc_id || ']' || chr(10) || chr(10) || text END AS text FROM t""")
def context_prefixes(spark, d):
    """T21."""
    language = F.when(F.col("doc_id") % 3 == 0, "arabic").when(F.col("doc_id") % 3 == 1, "english").otherwise("mixed")
    return table(spark, d, "documents").select("doc_id", T.contextualized(F.col("text"), language, F.concat(F.lit(" about "), F.col("doc_id").cast("string"))).alias("text"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?؟،\x{06D4}])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, chr(10) || ' ')), lambda p: p <> '') AS parts FROM documents),
g AS (SELECT doc_id, parts, len(list_filter(parts, lambda p, i: i = 1 OR length(p) >= 10 OR regexp_matches(p, '^[A-Z][a-z]*\.$'))) AS n FROM s)
SELECT doc_id, n::BIGINT AS n_sentences, md5(array_to_string(parts, ' ')) AS digest FROM g""")
def sentences(spark, d):
    """C1, as for mixed text."""
    parts = chunking.split_sentences(F.col("text"), F.lit("mixed"))
    rows = table(spark, d, "documents").select("doc_id", parts.alias("parts"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n_sentences"), F.md5(F.array_join("parts", " ").cast("binary")).alias("digest"))


def lines_of(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text"))
    return rows


@query(r"""WITH p AS (SELECT doc_id AS seq, unnest(range(len(string_split(text, chr(10)))))::INT AS chunk_index, unnest(string_split(text, chr(10))) AS chunk_text FROM documents),
k AS (SELECT *, substr(sha256(chunk_text), 1, 16) AS chunk_hash, row_number() OVER (PARTITION BY sha256(chunk_text) ORDER BY seq, chunk_index) AS n FROM p WHERE length(chunk_text) >= 60),
h AS (SELECT *, nullif(regexp_extract(chunk_text, '(?i)^(?:(?:Article|Section|Chapter|Clause|مادة|باب|فصل|بند)\s*\d+.*|(?:\d+\.)+\s+.*|[A-Z][A-Z\s]{2,}$)'), '') AS heading FROM k WHERE n = 1)
SELECT seq, chunk_index, chunk_hash, length(chunk_text)::INT AS chunk_size,
    coalesce(substr(trim(last_value(heading IGNORE NULLS) OVER (PARTITION BY seq ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)), 1, 120), '') AS chunk_context FROM h""")
def chunk_survivors(spark, d):
    """C2, C6, C7 after the split, with lines as raw chunks."""
    return chunking.surviving(lines_of(spark, d)).select("seq", "chunk_index", "chunk_hash", "chunk_size", "chunk_context")


@query()
def chunks(spark, d):
    """Chunks of all documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text", T.language_hint(F.col("text")).alias("language"))
    return chunking.chunks(docs, **{"size": 512, "overlap": 64})


@query()
def fallback_chunks(spark, d):
    """C14."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.fallback_udf(100, 20)("text")).alias("chunk_index", "chunk_text"))


def raw_pages(spark, d):
    """Documents as pages of 20 and every third as an image with recognised text."""
    none = F.create_map(F.lit("language"), F.lit("english"), F.lit("from"), F.col("doc_id").cast("string"))
    kind = F.when(F.col("doc_id") % 3 == 0, "pdf_embedded_image").otherwise("pdf")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("f"), F.expr("doc_id div 20").cast("string")).alias("source_path"), (F.expr("doc_id div 5") % 4 + 1).cast("int").alias("page"), kind.alias("source_type"),
        F.col("doc_id").cast("int").alias("image_index"), "text", none.alias("metadata"),
    )


@query(f"""WITH r AS (SELECT doc_id AS seq, 'f' || (doc_id // 20) AS source_path, (doc_id // 5 % 4 + 1)::INT AS page, doc_id % 3 = 0 AS image, text FROM documents),
g AS (SELECT source_path, page, min(seq) AS seq, {STRIP.format("coalesce(string_agg(text, chr(10) || chr(10) ORDER BY seq) FILTER (WHERE NOT image), '')")} AS text,
    coalesce(list(seq::INT ORDER BY seq) FILTER (WHERE image), []) AS images, max(seq) FILTER (WHERE NOT image) AS last_text,
    coalesce(list(CASE WHEN length(text) > 300 THEN '[Image ' || seq || ': ' || substr(text, 1, 297) || '...]' ELSE '[Image ' || seq || ': ' || text || ']' END ORDER BY seq) FILTER (WHERE image), []) AS marks FROM r GROUP BY 1, 2)
SELECT source_path, page, seq, md5(text) AS digest, images, last_text::VARCHAR AS merged_from, marks FROM g""")
def hybrid_documents(spark, d):
    """C8, C12."""
    rows = chunking.hybrid_documents(raw_pages(spark, d))
    return rows.select("source_path", "page", "seq", F.md5(F.col("text").cast("binary")).alias("digest"), F.transform("images", lambda i: i["image_index"]).alias("images"), F.col("metadata")["from"].alias("merged_from"), F.transform("images", chunking.image_text).alias("marks"))


@query()
def hybrid_chunks(spark, d):
    """C8-C13, on whole texts."""
    rows = chunking.hybrid_chunks(raw_pages(spark, d))
    return rows.select("source_path", "page", "seq", "chunk_index", "chunk_hash", "chunk_size", "chunk_context", "is_hybrid", "has_images", "image_count", "is_image_only", F.transform("referenced_images", lambda i: i["image_index"]).alias("images"))


TAGS = r"regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<(script|style|nav|footer|header|aside|form|iframe)\b.*?</(script|style|nav|footer|header|aside|form|iframe)>', '', 'g'), '(<[^>]*>)+', chr(10), 'g')"
PLAIN = f"replace(replace(replace(replace(replace(replace(replace({TAGS}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query(f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS source, {PLAIN} AS text FROM pages WHERE regexp_matches(url, '^https?://')),
c AS (SELECT page_id, url, source, {CLEAN} AS text FROM p),
l AS (SELECT *, {ARABIC.format('text')} AS a, {LATIN.format('text')} AS l FROM c)
SELECT page_id, url, source, text, CASE WHEN a + l = 0 THEN 'unknown' WHEN a / (a + l) > 0.65 THEN 'arabic' WHEN a / (a + l) < 0.25 THEN 'english' ELSE 'mixed' END AS language FROM l WHERE text <> ''""")
def page_texts(spark, d):
    """Main text of HTML pages; the SQL reads pages that have an article, and the character references these use."""
    return loaders.page_documents(table(spark, d, "pages"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'pdf' WHEN doc_id % 5 = 1 THEN 'word' WHEN doc_id % 5 = 2 THEN 'image' WHEN doc_id % 5 = 3 THEN NULL ELSE 'text' END AS loader FROM documents""")
def file_loaders(spark, d):
    """S7."""
    names = F.array(*[F.lit(x) for x in ("a.PDF", "b.docx", "c.c.tif", "d", "dir/e.txt")])
    return table(spark, d, "documents").select("doc_id", loaders.loader_of(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int"))).alias("loader"))


@query("SELECT doc_id, text AS decoded, 'utf-8' AS encoding, chr(233) || 'x' AS other, 'cp1252' AS other_encoding FROM documents")
def decoded_files(spark, d):
    """Decoding of UTF-8 and of what is not."""
    text, encoding = loaders.decoded(F.col("text").cast("binary"))
    other, other_encoding = loaders.decoded(F.unhex(F.lit("E978")))
    return table(spark, d, "documents").select("doc_id", text.alias("decoded"), encoding.alias("encoding"), other.alias("other"), other_encoding.alias("other_encoding"))


@query("""SELECT user_id AS image_id, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM events WHERE value >= 40 GROUP BY 1""")
def ocr_words(spark, d):
    """Confident words in order, with events as words."""
    words = table(spark, d, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("word"), F.col("value").alias("conf"))
    return loaders.ocr_text(words)


@query("""SELECT n_nationkey, '[TABLE: page ' || n_nationkey || ', table 1]' || chr(10) || n_name || ' | ' || n_regionkey || chr(10) || ' | x' AS text FROM nation""")
def table_texts(spark, d):
    """S9, the formatting."""
    rows = F.array(F.array("n_name", F.col("n_regionkey").cast("string")), F.array(F.lit(None).cast("string"), F.lit(" ")), F.array(F.lit(None).cast("string"), F.lit("x")))
    return table(spark, d, "nation").select("n_nationkey", loaders.table_text(rows, F.col("n_nationkey"), F.lit(1)).alias("text"))


@query("""SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS chunk_order FROM documents WHERE source <> 'src0'""")
def chunk_orders(spark, d):
    """K1, K2: numbered chunks after one project's deletion."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("source").alias("chunk_asset_id"), F.col("doc_id").alias("seq"), F.lit(0).alias("chunk_index"), F.when(F.col("source") == "src0", 0).otherwise(1).alias("chunk_project_id"))
    return store.numbered(store.without_project(rows, 0)).select("doc_id", "source", "chunk_order")


@query("SELECT doc_id AS chunk_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 50")
def chunk_page(spark, d):
    """The second page of 50."""
    return store.page(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), 2)


@query("SELECT vec_id, len(embedding)::INT AS size, '[' || label || '.0,' || label || '.5]' AS literal FROM embeddings")
def vector_rows(spark, d):
    """Checked vectors and their literal."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return store.checked(rows, 64).select("vec_id", F.size("vector").alias("size"), store.vector_literal(F.array(F.col("label").cast("double"), F.col("label") + 0.5)).alias("literal"))


@query(r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'file_type_not_supported' WHEN p_size * 300000 > 10 * 1048576 THEN 'file_size_exceeded' ELSE 'file_validate_successfully' END AS signal,
    substr(md5(p_partkey::VARCHAR), 1, 12) || '_' || regexp_replace(trim(p_name), '[^\p{L}\p{N}_.]', '', 'g') AS name FROM part""")
def uploads(spark, d):
    """K9, with parts as files."""
    kind = F.when(F.col("p_size") % 2 == 0, "image/gif").otherwise("text/plain")
    return table(spark, d, "part").select("p_partkey", store.upload_signal(kind, F.col("p_size") * 300000).alias("signal"), store.stored_name(F.col("p_name"), F.md5(F.col("p_partkey").cast("string").cast("binary"))).alias("name"))


@query("""WITH e AS (SELECT *, ['PENDING', 'STARTED', 'RETRY', 'SUCCESS', 'FAILURE'][1 + event_id % 5] AS status, (SELECT max(ts) FROM events) AS now FROM events)
SELECT event_id, sha256('{"event_type": "' || event_type || '", "task_name": "index", "user_id": "' || user_id || '"}') AS args_hash,
    CASE WHEN status = 'SUCCESS' THEN false WHEN status = 'FAILURE' THEN true ELSE epoch_us(now) - epoch_us(ts) > 660 * 1000000 END AS run,
    epoch_us(ts) >= epoch_us(now) - 86400000000 AS kept FROM e""")
def task_ledger(spark, d):
    """K10, with events as tasks and the last one's time as now."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.join(F.broadcast(rows.agg(F.max("ts").alias("now"))), how="cross")  # one row
    status = F.element_at(F.array(*[F.lit(x) for x in ("PENDING", "STARTED", "RETRY", "SUCCESS", "FAILURE")]), (F.col("event_id") % 5 + 1).cast("int"))
    args = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"))
    kept = F.unix_micros("ts") >= F.unix_micros("now") - store.RETENTION_SECONDS * 1_000_000
    return rows.select("event_id", store.args_hash(F.lit("index"), args).alias("args_hash"), store.should_execute(status, F.col("ts"), F.col("now")).alias("run"), kept.alias("kept"))
