"""Quality classifier from weak labels.

Method. Eight heuristic labellers look at each whole text and vote good (2), bad
(1) or abstain (0). Their joint votes are counted over all documents (at most 3**8
patterns) and expectation-maximisation on these counts estimates each labeller's
accuracy by class and the share of good texts, which gives every pattern a
posterior. Posteriors are the soft labels that train a hashed linear scorer: words, word
pairs and word shapes fall into BUCKETS buckets, whose weights are, in closed form and one pass (no loss is
minimised step by step), the smoothed log-odds of posterior-weighted counts over *all* documents. A text's score is the
mean weight of its features; the cut is the score (in CELLS cells) that agrees best
with the posteriors, again counted over all documents.

Counts are integers (posteriors in whole thousandths, weights in millionths), so
every run decides alike. The driver receives patterns, buckets and cells, all of
fixed number; a task holds one chunk of text and two arrays of BUCKETS numbers.

Edge cases: null and empty texts have no features, score below every cut and are
rejected; repeated rows score alike; an empty table gives an empty result; other
columns are ignored. Constant votes leave the share of good texts at its prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import joined, mix, prefix_hash, released, row_key, shingles, slices, span_hash, stored, table, words, workers_find_package

BUCKETS, CELLS = 1 << 16, 2000
LABELLERS = ["symbols", "capitals", "echoes", "repeats", "variety", "bars", "word_length", "length"]
ROUNDS = 60


def _count(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[at[1:]] - total[at[:-1]]).astype(float)


_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 symbol
_KIND[ord("A") : ord("Z") + 1], _KIND[ord("a") : ord("z") + 1] = 1, 2
_KIND[[ord(c) for c in "#*$%&|<>!"]] = 3


class Texts:
    """Word-level arrays of one chunk of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.start, self.end, self.at = words(data, offsets)
        self.n = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.hash = span_hash(prefix_hash(data), self.start, self.end)
        kind = _KIND[data]
        inside = lambda flags: (lambda c: c[self.end] - c[self.start])(np.concatenate(([0], np.cumsum(flags))))
        self.upper, self.lower, self.symbols = (inside(kind == k) for k in (1, 2, 3))
        self.chars = inside((data & 0xC0) != 0x80)
        self.echo = np.zeros(len(self.hash), bool)
        self.echo[1:] = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.bar = np.zeros(len(self.hash), bool)
        single = self.end - self.start == 1
        self.bar[single] = data[self.start[single]] == ord("|")


def votes(t: Texts) -> np.ndarray:
    """One column for each labeller: 2 good, 1 bad, 0 abstains."""
    n, some = np.maximum(t.n, 1), t.n > 0

    def by(measure: np.ndarray, bad: float, good: float, applies: np.ndarray = some) -> np.ndarray:
        return np.where(applies, np.where(measure >= bad, 1, np.where(measure <= good, 2, 0)), 0)

    letters = _count_sum(t.upper + t.lower, t.at)
    grams, first = shingles(t.hash, t.at, 5)
    own = np.repeat(np.arange(len(t.n)), np.diff(first))
    order = np.lexsort((grams, own))
    g, o = grams[order], own[order]
    again = np.zeros(len(g), bool)
    again[1:] = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
    repeated = np.bincount(o[again], minlength=len(t.n)) / np.maximum(np.diff(first), 1)
    order = np.lexsort((t.hash, t.doc))
    h, d = t.hash[order], t.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=len(t.n)) / np.minimum(n, 500)
    mean = _count_sum(t.chars, t.at) / n
    return np.stack(
        [
            by(_count_sum(t.symbols, t.at) / n, 0.3, 0.05),
            by(_count_sum(t.upper, t.at) / np.maximum(letters, 1), 0.5, 0.2, letters >= 10),
            by(_count(t.echo, t.at) / n, 0.15, 0.03, t.n >= 5),
            by(repeated, 0.4, 0.1, t.n >= 20),
            by(-distinct, -0.2, -0.4, t.n >= 50),
            by(_count(t.bar, t.at) / n, 0.1, 0.01, t.n >= 5),
            by(np.abs(mean - 5.5), 4.5, 2.0, t.n >= 5),
            np.where(t.n >= 40, 2, 0),
        ],
        axis=1,
    )


def _count_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def posteriors(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = ROUNDS) -> dict[int, float]:
    """P(good) of each vote pattern by expectation-maximisation, starting from majority votes."""
    if not counts:
        return {}
    keys = np.array(sorted(counts))
    mass = np.array([counts[k] for k in keys.tolist()], float)
    v = keys[:, None] // 3 ** np.arange(labellers) % 3
    good, bad = (v == 2).sum(1), (v == 1).sum(1)
    p = np.where(bad > 0, (0.5 + 0.1 * good) / (1 + 0.1 * good + 2.0 * bad), np.where(good > 0, 0.95, 0.5))
    for _ in range(rounds):
        share = np.clip((p * mass).sum() / mass.sum(), 0.02, 0.98)
        log = np.stack([np.full(len(p), np.log1p(-share)), np.full(len(p), np.log(share))])
        for j in range(labellers):
            for c, own in enumerate((1 - p, p)):
                spoke = (v[:, j] > 0) * own * mass
                right = ((v[:, j] == c + 1) * own * mass).sum()
                # a labeller sees one defect of many: it may pass most bad texts, but its thresholds
                # are lax enough to call at most one good text in a thousand bad
                accuracy = np.clip((right + 0.5) / (spoke.sum() + 1.0), (0.02, 0.999)[c], 0.9999)
                log[c] += np.where(v[:, j] == 0, 0, np.where(v[:, j] == c + 1, np.log(accuracy), np.log(1 - accuracy)))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return dict(zip(keys.tolist(), p.tolist(), strict=True))


def features(t: Texts, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of words, word pairs and word shapes."""
    size = np.uint64(n)
    pair = np.flatnonzero(t.doc[1:] == t.doc[:-1])
    shape = (t.symbols > 0) + 2 * ((t.upper > 1) & (t.lower == 0)) + 4 * t.echo + 8 * t.bar
    code = mix(shape.astype(np.uint64) + np.uint64(0xABCDEF))
    b = np.concatenate((t.hash % size, mix(t.hash[pair] * np.uint64(31) + t.hash[pair + 1]) % size, code % size))
    return b.astype(np.int64), np.concatenate((t.doc, t.doc[pair], t.doc))


def train(docs: DataFrame, n: int = BUCKETS) -> tuple[np.ndarray, dict[int, float]]:
    """Weights of the hashed scorer in millionths, and the posteriors of vote patterns."""

    def count_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                total += np.bincount(pattern(votes(Texts(data, offsets))), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["pattern", "n"])

    seen = docs.select("text").mapInArrow(released(count_votes), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    known = posteriors({r["pattern"]: r["n"] for r in seen})
    soft = np.zeros(3 ** len(LABELLERS), np.int64)
    for k, p in known.items():
        soft[k] = round(1000 * p)

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, both = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                t = Texts(data, offsets)
                b, d = features(t, n)
                label = soft[pattern(votes(t))]
                good += np.bincount(b, label[d], minlength=n).astype(np.int64)
                both += np.bincount(b, minlength=n)
        used = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(good[used]), pa.array(1000 * both[used] - good[used])], ["bucket", "good", "bad"])

    sums = docs.select("text").mapInArrow(released(count_features), "bucket long, good long, bad long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    good, bad = np.ones(n) * 1000, np.ones(n) * 1000
    for r in sums.collect():  # at most n rows
        good[r["bucket"]] += r["good"]
        bad[r["bucket"]] += r["bad"]
    return np.round(1e6 * (np.log(good / good.sum()) - np.log(bad / bad.sum()))).astype(np.int64), known


def scored(docs: DataFrame, weight: np.ndarray, known: dict[int, float]) -> DataFrame:
    """(doc_id, score in millionths, null without words; posterior in thousandths)."""
    soft = np.zeros(3 ** len(LABELLERS), np.int64)
    for k, p in known.items():
        soft[k] = round(1000 * p)
    sent = docs.sparkSession.sparkContext.broadcast(weight)  # len(weight) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for at, end, data, offsets in slices(batch.column(1)):
                t = Texts(data, offsets)
                b, d = features(t, len(w))
                total = np.bincount(d, w[b], minlength=end - at).astype(np.int64)
                count = np.bincount(d, minlength=end - at)
                score = pa.array(total // np.maximum(count, 1), mask=count == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), score, pa.array(soft[pattern(votes(t))])], ["doc_id", "score", "posterior"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, score long, posterior long")


def best_cut(cells: list[tuple[int, int, int]]) -> int | None:
    """The cell from which on to keep, out of (cell, good mass, bad mass); ties keep more."""
    cells = sorted(cells)
    gain = 0
    best, cut = 0, cells[0][0] if cells else None  # keeping all
    for i, (_, good, bad) in enumerate(cells):
        gain += bad - good
        if gain > best:
            best, cut = gain, cells[i + 1][0] if i + 1 < len(cells) else cells[i][0] + 1
    return cut


def classified(docs: DataFrame, n: int = BUCKETS) -> DataFrame:
    """(doc_id, score, posterior, kept) for every row."""
    workers_find_package(docs.sparkSession)
    weight, known = train(docs, n)
    rows = stored(scored(docs, weight, known))
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    if low is None:
        return rows.withColumn("kept", F.lit(False))
    width = max(1, -(-(high - low + 1) // CELLS))
    cell = F.expr(f"(score - ({low})) div {width}")
    cells = rows.where("score is not null").groupBy(cell.alias("cell")).agg(F.sum("posterior").alias("good"), F.sum(1000 - F.col("posterior")).alias("bad"))
    cut = best_cut([tuple(r) for r in cells.collect()])  # at most CELLS rows
    return rows.withColumn("kept", F.coalesce(F.col("score") >= low + cut * width, F.lit(False)))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the classifier keeps. Each row is judged by its own text, also where ids are null or shared."""
    row = "_classifier_row"
    keyed = docs.withColumn(row, row_key())
    bad = classified(keyed.select(F.col(row).alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias(row)).distinct()
    return joined(keyed, bad, row, "left_anti").select(*docs.columns)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"))
