"""Quality rules with a hashed n-gram log-likelihood ratio.

Method. Words and word pairs fall into BUCKETS hashed buckets. Two multinomials
are counted exactly: the raw corpus (all documents) and the trusted target (one
half, by a hash of the id, of the documents labelled good and not toxic); the target
is smoothed towards the raw one. A bucket's weight is the logarithm of target over raw probability, in whole
millionths. A document's score is the sum of its n-grams' weights over their
number plus PRIOR, which draws very short texts towards 0. It is kept if the base
rules hold and the score is at least the mean of the trusted documents' other half
less SPREAD standard deviations. That half was not counted, so it scores as unlabelled
documents do, at any size of corpus. All sums are of integers, so every run decides alike.

Texts are read, split and hashed once: each document's measures and its words' buckets,
in order, are stored, at about half the size of the compressed texts, until the scores are there. A pair's bucket follows from
those of its words. Counting joins this table with the trusted ids (a broadcast up to
BROADCAST_IDS ids); n-grams are exploded and
summed within their task before anything is shuffled, so a shuffle carries a row
for each bucket. The weights (BUCKETS integers) go out as a
literal; everything is built-in expressions.

Edge cases: null and empty texts have no words and fail the base rules; without
trusted documents all weights are 0 and only the base rules decide; repeated rows
are judged each; repeated or conflicting labels count as trusted if one is;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import release, stored, table

GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
BUCKETS, SMOOTHING, PRIOR, SPREAD = 1 << 15, 1.0, 8, 5.0
MILLION = 1_000_000
BROADCAST_IDS = 1_000_000  # more trusted documents than this are joined by a shuffle


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeated_words(grams: Column) -> Column:
    """Words covered by 5-word windows found twice or more; ``grams`` are the windows' hashes in order."""

    def covered(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        nothing = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"))
        return F.aggregate(starts, nothing, step, lambda a: a["n"])

    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    once = F.size(F.array_distinct(grams)) == F.size(grams)
    return F.when(once, F.lit(0).cast("long")).otherwise(F.transform(F.array(ordered), covered)[0])


def hashed(word: Column) -> Column:
    """28 bits of the word's MD5."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 7), 16, 10).cast("long")


def following(words: Column) -> Column:
    return F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))


def paired(first: Column, second: Column, n: int) -> Column:
    """The bucket of a pair, from those of its words: hashes modulo n do as well as whole ones."""
    return (first * 31 + second * 7 + 13) % n


def measured(docs: DataFrame, n: int = BUCKETS) -> DataFrame:
    """Base measures of each row and its words' buckets ``hs``, in their order."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", words(F.col("text")).alias("ws"))
    rows = rows.select("*", F.transform("ws", lambda w: F.xxhash64(w)).alias("wh"))  # windows are hashed from numbers, words only once
    windows = F.slice("wh", F.lit(1), F.greatest(F.size("wh") - 4, F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        "doc_id", "ws",
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        lines.alias("lines"),
        F.transform(windows, lambda w, i: F.xxhash64(w, *[F.get("wh", i + k) for k in range(1, 5)])).alias("grams"),
    )
    return rows.select(
        "doc_id", "word_chars", "n_symbols",
        F.size("ws").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("grams")).alias("n_repeat_words"),
        F.transform("ws", lambda w: (hashed(w) % n).cast("int")).alias("hs"),
    )


def weights(rows: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> list[int]:
    """Weights of the n buckets in millionths, from ``measured`` rows; ``trusted`` has a column doc_id."""
    ids = trusted.select("doc_id").distinct().withColumn("good", F.lit(True))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.select("doc_id", "hs").join(F.broadcast(ids) if few else ids, "doc_id", "left")
    pairs = F.arrays_zip(F.col("hs").alias("b"), following(F.col("hs")).alias("next"))
    grams = rows.select(F.coalesce("good", F.lit(False)).cast("int").alias("good"), F.explode(pairs).alias("z"))
    grams = grams.select("good", F.explode(F.array("z.b", paired(F.col("z.b"), F.col("z.next"), n))).alias("bucket")).where("bucket is not null")
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()  # at most n rows
    raw, target = [0] * n, [0] * n
    for r in counted:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    all_raw, all_target = sum(raw), sum(target)
    if not all_target:
        return [0] * n
    out = []
    for r, t in zip(raw, target, strict=True):
        p = (r + 1.0) / (all_raw + n)
        out.append(round(MILLION * math.log((t + SMOOTHING * n * p) / (all_target + SMOOTHING * n) / p)))
    return out


def weighed(rows: DataFrame, weight: list[int]) -> DataFrame:
    """``measured`` rows with the number of their n-grams and the sum of these n-grams' weights, without ``hs``."""
    n = len(weight)
    literal = F.from_json(F.lit(json.dumps(weight)), "array<bigint>")
    of = lambda bucket: F.coalesce(F.get(literal, bucket), F.lit(0).cast("long"))
    each = F.zip_with("hs", following(F.col("hs")), lambda b, then: of(b) + of(paired(b, then, n)))  # a last word has none after it: null
    llr = F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x)
    return rows.withColumns({"n_grams": F.greatest(2 * F.col("n_words") - 1, F.lit(0)), "llr": llr}).drop("hs")


def fitted(doc_id: Column) -> Column:
    """Whether a trusted document is counted; the others set the threshold."""
    return F.md5(doc_id.cast("string").cast("binary")) < F.lit("8")


def judged(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS, spread: float = SPREAD) -> DataFrame:
    trusted = trusted.select("doc_id").distinct()
    read = stored(measured(docs, n))
    rows = weighed(read, weights(read, trusted.where(fitted(F.col("doc_id"))), n))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = stored(rows.withColumn("score", F.expr(f"llr div (n_grams + {PRIOR})")))
    release(read)
    good = trusted.where(~fitted(F.col("doc_id")))
    x = F.col("score").cast("decimal(38,0)")
    s = rows.where("not base_failed").join(good, "doc_id", "left_semi").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).first()
    cut = -math.inf
    if s["n"]:
        mean = int(s["s"]) / s["n"]
        cut = mean - spread * math.sqrt(max(0.0, int(s["q"]) / s["n"] - mean * mean))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score").cast("double") >= F.lit(cut))).alias("kept"),
        "score",
    )


def trusted_rows(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), trusted_rows(table(spark, sf_dir, "labels")))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
trusted AS (SELECT DISTINCT doc_id, md5(doc_id::VARCHAR) < '8' AS fitted FROM labels WHERE quality = 1 AND toxic = 0),
good AS (SELECT doc_id FROM trusted WHERE fitted),
w AS (SELECT doc_id, i, ws[i] AS word, ws[i + 1] AS following,
        ('0x' || substr(md5(ws[i]), 1, 7))::BIGINT AS h1, ('0x' || substr(md5(ws[i + 1]), 1, 7))::BIGINT AS h2
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
g AS (SELECT doc_id, h1 % {BUCKETS} AS bucket FROM w
    UNION ALL SELECT doc_id, (h1 * 31 + h2 * 7 + 13) % {BUCKETS} FROM w WHERE h2 IS NOT NULL),
c AS (SELECT b.bucket, count(g.bucket) AS raw, count(good.doc_id) AS target FROM (SELECT unnest(range({BUCKETS})) AS bucket) b
    LEFT JOIN g ON g.bucket = b.bucket LEFT JOIN good ON good.doc_id = g.doc_id GROUP BY 1),
t AS (SELECT sum(raw)::DOUBLE AS r, sum(target)::DOUBLE AS t FROM c),
p AS (SELECT bucket, raw, target, (raw + 1.0::DOUBLE) / (t.r + {BUCKETS}) AS p, t.t FROM c, t),
x AS (SELECT bucket, CASE WHEN t = 0 THEN 0 ELSE round_even({MILLION} * ln((target + {SMOOTHING} * {BUCKETS}::DOUBLE * p) / (t + {SMOOTHING} * {BUCKETS}::DOUBLE) / p), 0)::BIGINT END AS weight FROM p),
s AS (SELECT doc_id, sum(weight)::BIGINT AS llr, count(*) AS n FROM g JOIN x USING (bucket) GROUP BY 1),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 4]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM f, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, trunc(coalesce(s.llr, 0)::DOUBLE / (coalesce(s.n, 0) + {PRIOR}))::BIGINT AS score
    FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
q AS (SELECT count(*) AS n, sum(score)::DOUBLE / count(*) AS mean, sum(score::HUGEINT * score)::DOUBLE / count(*) AS sq
    FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM trusted WHERE NOT fitted))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND (q.n = 0 OR score >= q.mean - {SPREAD}::DOUBLE * sqrt(greatest(0, q.sq - q.mean * q.mean))) AS kept, score
FROM b, q
"""
