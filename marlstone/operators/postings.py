"""BM25 over a stored index of postings that grows by segments.

A segment holds the documents added at one time: each document's length and term counts, and the postings of each term in blocks of BLOCK documents, best first, with
the block's largest count and smallest length. Those two bound a block's scores whatever the corpus statistics have become. Texts are split into words once, when they are added. Deleting
documents writes a segment of their ids, lengths and terms; an id that is added again replaces what was there before. Document frequencies, the number of documents and their mean length are
the sums over the segments less those of what was deleted or replaced, so results equal those of an index built anew.

A search reads the postings of its own terms only. It first scores every term's leading blocks alone: the k-th of these partial scores is a floor for a query. A
block that cannot lift its documents to the floor, even if they had the best of all the query's other terms, is skipped. What is left is scored exactly.
Common terms are parted by SPREAD documents, so no task gathers all postings of a term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import bm25_tokens
from marlstone.operators.retrieval import BROADCAST_TERMS, DIGITS, EPSILON, K1, B, top
from marlstone.session import kept

BLOCK, SPREAD = 64, 16_384
LEADING = 2  # blocks of a term's part whose scores make the floor
SLACK = 1e-5  # scores are rounded to DIGITS
FORWARD = "doc_id long, dl int, counts map<string,int>"
LISTS = "term string, part int, block int, most_tf int, least_dl int, docs array<struct<doc_id:long,tf:int,dl:int>>"
GONE = "doc_id long, before int"
TERMS = "term string, df long"
SIZES = "n long, words long"


class StoredBm25:
    """The index at ``path``. Segments are numbered; each operation writes one and touches none that is there."""

    def __init__(self, spark: SparkSession, path: str, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> None:
        self.spark, self.path, self.k1, self.b, self.epsilon = spark, path, k1, b, epsilon

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        """Numbers of the segments that are complete."""
        path, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        mark = lambda n: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/sizes/_SUCCESS")  # noqa: E731  written last
        return sorted(int(n.removeprefix("segment=")) for n in names if n.startswith("segment=") and fs.exists(mark(n)))

    def _next(self) -> tuple[str, int]:
        number = max(self.segments(), default=-1) + 1
        return f"{self.path}/segment={number}", number

    def _read(self, kind: str, schema: str) -> DataFrame:
        """One kind of table of all segments, with the segment's number."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/segment={n}/{kind}").withColumn("segment", F.lit(n)) for n in self.segments()]
        out = self.spark.createDataFrame([], f"{schema}, segment int")
        for p in parts:
            out = out.unionByName(p)
        return out

    def live(self) -> DataFrame:
        """(doc_id, dl, counts, segment) of the documents that searches see."""
        forward = self._read("forward", FORWARD)
        gone = self._read("gone", GONE).groupBy("doc_id").agg(F.max("before").alias("before"))
        return forward.join(gone, "doc_id", "left").where("before is null or segment >= before").drop("before")

    def _withdrawn(self, folder: str, number: int, ids: DataFrame) -> DataFrame:
        """Write what leaves with the live documents among ``ids``, which counts against later segments' sums."""
        leaving = kept(self.live().join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))
        leaving.select("doc_id").distinct().withColumn("before", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/gone")
        return leaving

    def add(self, docs: DataFrame) -> StoredBm25:
        """Index (doc_id, text); null texts have no words. An id that is there already is replaced; of several rows of an id in one addition
        the greatest text counts, and rows without an id are left out."""
        folder, number = self._next()
        whole = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("text").alias("text"))
        words = whole.select("doc_id", F.coalesce(bm25_tokens(F.col("text")), F.array().cast("array<string>")).alias("ts"))
        counted = words.select("doc_id", F.size("ts").alias("dl"), F.explode_outer("ts").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
        entry = F.map_from_entries(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))))
        counted.groupBy("doc_id", "dl").agg(entry.alias("counts")).write.mode("overwrite").parquet(f"{folder}/forward")
        forward = self.spark.read.schema(FORWARD).parquet(f"{folder}/forward")
        leaving = self._withdrawn(folder, number, forward)
        rows = forward.select("doc_id", "dl", F.explode("counts").alias("term", "tf"))
        terms = rows.groupBy("term").agg(F.count("*").alias("df"))
        parts = terms.select("term", F.ceil(F.col("df") / SPREAD).cast("int").alias("parts"))
        dealt = rows.join(parts, "term").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        best = Window.partitionBy("term", "part").orderBy((F.col("tf") / (F.col("tf") + F.col("dl"))).desc(), "doc_id")
        placed = dealt.withColumn("block", ((F.row_number().over(best) - 1) / BLOCK).cast("int"))
        lists = placed.groupBy("term", "part", "block").agg(F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct("doc_id", "tf", "dl")).alias("docs"))
        lists.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/lists")
        self._sums(folder, terms, forward, leaving)
        return self

    def delete(self, ids: DataFrame) -> StoredBm25:
        """Take documents (doc_id) out; unknown ids are ignored."""
        folder, number = self._next()
        leaving = self._withdrawn(folder, number, ids)
        for kind, schema in (("forward", FORWARD), ("lists", LISTS)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{kind}")
        self._sums(folder, self.spark.createDataFrame([], TERMS), self.spark.createDataFrame([], FORWARD), leaving)
        return self

    def _sums(self, folder: str, terms: DataFrame, forward: DataFrame, leaving: DataFrame) -> None:
        """What a segment adds to and takes from the document frequencies and the corpus' size."""
        less = leaving.select(F.explode(F.map_keys("counts")).alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
        size = forward.select(F.lit(1).alias("n"), "dl").unionByName(leaving.select(F.lit(-1).alias("n"), "dl"))
        size.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.col("n") * F.col("dl")), F.lit(0)).cast("long").alias("words")).write.mode("overwrite").parquet(f"{folder}/sizes")

    def idf(self) -> tuple[DataFrame, int, float]:
        """(term, df, idf) over the live documents, their number and their mean length."""
        n, words = self._read("sizes", SIZES).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        df = self._read("terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = kept(df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
        mean = raw.agg(F.avg("raw")).first()[0] or 0.0
        return raw.select("term", "df", F.when(F.col("raw") < 0, self.epsilon * mean).otherwise(F.col("raw")).alias("idf")), n, words / n if n else 0.0

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """As ``Bm25.search``."""
        return self.explained(queries, k)[0]

    def explained(self, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """The result, and each block that a query's term has with whether it was skipped: (query_id, term, segment, part, block, skipped)."""
        idf, n, mean = self.idf()
        part = lambda tf, dl: tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / F.lit(mean or 1.0)))
        words = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        weights = kept(words.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
        terms = weights.select("term").distinct()
        few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        lists = kept(self._read("lists", LISTS).join(F.broadcast(terms) if few else terms, "term", "left_semi"))
        best = lists.groupBy("term").agg(F.max(part(F.col("most_tf"), F.col("least_dl"))).alias("best"))
        bounds = weights.join(best, "term").withColumn("top", F.greatest(F.col("weight") * F.col("best"), F.lit(0.0)))
        # a block's documents may have the best of all other terms of the query
        bounds = kept(bounds.withColumn("others", F.sum("top").over(Window.partitionBy("query_id")) - F.col("top")).withColumn("least", F.sum(F.least("weight", F.lit(0.0))).over(Window.partitionBy("query_id"))))
        gone = self._read("gone", GONE).groupBy("doc_id").agg(F.max("before").alias("before"))
        if gone.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
            gone = F.broadcast(gone)  # else it is shuffled to meet the postings, not all their products with queries
        alive = lambda rows: rows.join(gone, "doc_id", "left").where("before is null or segment >= before") if len(self.segments()) > 1 else rows

        rounds = max(1, -(-bounds.count() // BROADCAST_TERMS))
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def scored(some: DataFrame, asked: DataFrame) -> DataFrame:
            """Scores of ``asked`` (bounds, floor) by blocks ``some``. Postings are dealt by document and queries' terms are sent to all tasks, in rounds, whatever
            their files' sizes suggest: a task adds up its documents' products of postings and queries, which are neither shuffled nor sent."""
            each = alive(some.select("term", "segment", "most_tf", "least_dl", F.inline("docs"))).repartition(spread, "doc_id")
            out = None
            for r in range(rounds):
                part_of = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)
                rows = each.join(F.broadcast(part_of), "term").where(~skipped).groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * part(F.col("tf"), F.col("dl"))).alias("score"))
                out = rows if out is None else out.unionByName(rows)
            return out

        reach = F.col("weight") * part(F.col("most_tf"), F.col("least_dl")) + F.col("others")
        # terms of negative weight may take something from the floor, and are never skipped
        skipped = F.coalesce((F.col("weight") > 0) & (F.col("least") == 0) & (reach < F.col("floor") - SLACK), F.lit(False))
        open_ = bounds.where("weight > 0").withColumn("floor", F.lit(None).cast("double"))
        floor = top(scored(lists.where(F.col("block") < LEADING), open_), k, [F.desc("score"), F.asc("doc_id")]).where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("floor"))
        asked = kept(bounds.join(floor, "query_id", "left").select("query_id", "term", "weight", "others", "least", "floor"))
        total = scored(lists, asked).withColumn("score", F.round("score", DIGITS)).where("score > 0")
        blocks = lists.drop("docs").join(asked, "term").select("query_id", "term", "segment", "part", "block", skipped.alias("skipped"))
        return top(total, k, [F.desc("score"), F.asc("doc_id")]), blocks
