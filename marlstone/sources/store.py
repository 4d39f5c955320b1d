"""Chunk tables, vector collections, upload checks and the task ledger.

A collection is a Parquet folder (id, text, vector, metadata JSON, chunk_id) under a root; listing and existence ask
the folder's file system through Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import clean_file_name
from marlstone.operators.retrieval import dense_topk
from marlstone.sources.proximity import ProximityIndex

LIMIT_SECONDS, GRACE_SECONDS, RETENTION_SECONDS = 600, 60, 86_400
# --- Fixed values: upload limits and signals ---
ALLOWED_TYPES = ["text/plain", "application/pdf"]
MEGABYTE = 1_048_576
SIGNALS = {"type": "file_type_not_supported", "size": "file_size_exceeded", "ok": "file_validate_successfully"}


def numbered(chunks: DataFrame) -> DataFrame:
    """K1: ``chunk_order`` from 1 within each asset."""
    return chunks.withColumn("chunk_order", F.row_number().over(Window.partitionBy("chunk_asset_id").orderBy("seq", "chunk_index")))


def append_chunks(chunks: DataFrame, path: str) -> None:
    """K1: append, one folder for each project."""
    chunks.write.mode("append").partitionBy("chunk_project_id").parquet(path)


def delete_project(spark: SparkSession, path: str, project: int) -> int:
    """K2: remove a project's folder and return how many rows it had."""
    folder = f"{path}/chunk_project_id={project}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return 0
    n = spark.read.parquet(folder).count()
    fs.delete(where, True)
    return n


def without_project(chunks: DataFrame, project: int) -> DataFrame:
    """K2 as an expression: what a delete leaves."""
    return chunks.where(~F.col("chunk_project_id").eqNullSafe(F.lit(project)))


def page(rows: DataFrame, number: int, size: int = 50, by: str = "chunk_id") -> DataFrame:
    """One page (from 1), in a total order."""
    return rows.orderBy(by).offset((number - 1) * size).limit(size)


def asset(assets: DataFrame, project: int, name: str) -> DataFrame:
    """The asset of a project by name; the first by id if there are several."""
    return assets.where((F.col("asset_project_id") == project) & (F.col("asset_name") == name)).orderBy("asset_id").limit(1)


def project_assets(assets: DataFrame, project: int, kind: str) -> DataFrame:
    """A project's assets of one type."""
    return assets.where((F.col("asset_project_id") == project) & (F.col("asset_type") == kind))


def project_page(projects: DataFrame, number: int = 1, size: int = 10) -> tuple[DataFrame, int]:
    """One page of projects, and how many pages there are."""
    return page(projects, number, size, "project_id"), -(-projects.count() // size)


def checked(rows: DataFrame, size: int) -> DataFrame:
    """K4: rows whose vector has ``size`` numbers; any other fails the job."""
    ok = F.assert_true(F.size("vector") == size, F.lit(f"a vector must have {size} numbers"))
    return rows.withColumn("vector", F.when(ok.isNull(), F.col("vector")))


def vector_literal(vector: Column) -> Column:
    """K4: [a,b,...]."""
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


class Collections:
    """K3-K7: vector collections below ``root``."""

    def __init__(self, spark: SparkSession, root: str, metric: str = "cosine") -> None:
        self.spark, self.root, self.metric = spark, root, metric
        self._jvm = spark.sparkContext._jvm

    @staticmethod
    def name(size: int, project: int) -> str:
        return f"collection_{size}_{project}"

    def _path(self, name: str = ""):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def all(self) -> list[str]:
        path, fs = self._path()
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if not n.startswith(".")) if fs.exists(path) else []

    def create(self, name: str, size: int, reset: bool = False) -> bool:
        """False if it is there already and ``reset`` is not asked for."""
        if self.exists(name):
            if not reset:
                return False
            self.delete(name)
        empty = self.spark.createDataFrame([], "id long, text string, vector array<float>, metadata string, chunk_id long")
        empty.write.parquet(f"{self.root}/{name}")
        return True

    def delete(self, name: str) -> bool:
        for part in (f".indexes/{name}", name):
            path, fs = self._path(part)
            gone = fs.delete(path, True) if fs.exists(path) else False
        return gone

    def info(self, name: str) -> dict | None:
        return {"name": name, "rows": self.scan(name).count()} if self.exists(name) else None

    def insert(self, name: str, rows: DataFrame, size: int) -> None:
        """Append (id, text, vector, metadata, chunk_id); null metadata is {}."""
        out = checked(rows, size).select("id", "text", F.col("vector").cast("array<float>"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), "chunk_id")
        out.write.mode("append").parquet(f"{self.root}/{name}")

    def scan(self, name: str) -> DataFrame:
        """All rows."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def search(self, name: str, queries: DataFrame, k: int = 10) -> DataFrame:
        """R1 over the collection."""
        rows = self.scan(name)
        hits = dense_topk(queries, rows.select(F.col("id").alias("doc_id"), F.col("vector").alias("embedding")), k, self.metric)
        return hits.join(rows.select(F.col("id").alias("doc_id"), "text", "chunk_id"), "doc_id")

    def index(self, name: str) -> ProximityIndex:
        return ProximityIndex(self.spark, f"{self.root}/.indexes/{name}", self.metric)

    def create_index(self, name: str) -> ProximityIndex:
        """K5: index the collection's vectors; those that the index has are left as they are."""
        index, rows = self.index(name), self.scan(name).select(F.col("id").alias("doc_id"), F.col("vector").alias("embedding"))
        return index.add(rows.join(index.ids(), "doc_id", "left_anti") if index.exists() else rows)

    def search_index(self, name: str, queries: DataFrame, k: int = 10, **options) -> DataFrame:
        """K5: ``search`` by the index."""
        rows = self.scan(name).select(F.col("id").alias("doc_id"), "text", "chunk_id")
        return self.index(name).search(queries, k, **options).join(rows, "doc_id")


#: K7: vector stores by name; the first two are this package's collections.
STORES = {"PGVECTOR": True, "QDRANT": True, "PINECONE": False, "WEAVIATE": False, "MILVUS": False}
METRICS = {"cosine": "cosine", "dot": "dot", "euclidean": "euclidean", "euclid": "euclidean", "l2": "euclidean"}


def vector_store(kind: str, spark: SparkSession, root: str, metric: str = "cosine") -> Collections:
    """K6, K7: the store of this name. All that are built share one interface and backend; the metric is a parameter."""
    if kind.upper() not in STORES:
        raise ValueError(f"no vector store is called {kind}")
    if not STORES[kind.upper()]:
        raise NotImplementedError(kind)
    return Collections(spark, root, METRICS[metric.lower()])


class CellIndex:
    """K5: an approximate index. Centres are fitted on a hashed sample of up to ``sample`` unit vectors (k-means on the driver), every
    vector is indexed under its nearest centre, and a query asks its ``probes`` nearest cells; candidates are scored
    exactly. Whether to use it or exact search is the caller's choice; ``recall`` tells what it finds."""

    def __init__(self, vectors: DataFrame, cells: int = 16, probes: int = 11, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> None:
        held = vectors.where("embedding is not null").select("doc_id", "embedding").orderBy(F.xxhash64("doc_id", F.lit(seed))).limit(sample)
        points = unit(np.array([r["embedding"] for r in held.select("embedding").collect()], float))  # ``sample`` rows at most
        self.probes, self.centres = probes, centres(points, min(cells, max(1, len(points))), rounds, seed)
        self.index = self._cells(vectors, "doc_id", 1)

    def _cells(self, rows: DataFrame, key: str, n: int) -> DataFrame:
        """(key, embedding, cell) for the ``n`` nearest cells of each row."""
        c = self.centres

        @F.pandas_udf("array<int>")
        def nearest(vs: pd.Series) -> pd.Series:
            near = np.argsort(-(unit(np.stack(vs.tolist()).astype(float)) @ c.T), axis=1, kind="stable")[:, :n]
            return pd.Series(list(near.astype(np.int32)))

        out = rows.where("embedding is not null").select(key, "embedding", nearest("embedding").alias("near"))
        return out.select(key, "embedding", F.explode("near").alias("cell"))

    def search(self, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
        asked = self._cells(queries, "query_id", self.probes)
        return dense_topk(asked, self.index, k, metric, by="cell")

    @staticmethod
    def recall(found: DataFrame, exact: DataFrame) -> float:
        """The share of exact neighbours (query_id, doc_id) that were found."""
        hits = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
        return hits.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True)) if v.size else np.zeros((len(v), 1))
    return v / np.where(norm > 0, norm, 1)


def centres(points: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm on unit vectors."""
    if not len(points):
        return np.zeros((1, 1))
    c = points[np.random.default_rng(seed).choice(len(points), n, replace=False)]
    for _ in range(rounds):
        own = (points @ c.T).argmax(axis=1)
        c = unit(np.stack([points[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(n)]))
    return c


def upload_signal(content_type: Column, size: Column, most_mb: int = 10, allowed: list[str] | None = None) -> Column:
    """K9: what an upload is answered."""
    return F.when(~content_type.isin(allowed or ALLOWED_TYPES), SIGNALS["type"]).when(size > most_mb * MEGABYTE, SIGNALS["size"]).otherwise(SIGNALS["ok"])


def stored_name(name: Column, prefix: Column) -> Column:
    """K9: a prefix of its own and the cleaned name."""
    return F.concat(F.substring(prefix, 1, 12), F.lit("_"), clean_file_name(name))


def args_hash(task: Column, args: Column) -> Column:
    """SHA-256 over the arguments (map<string,string>) and the task's name as JSON with sorted keys."""
    entries = F.array_sort(F.map_entries(F.map_concat(F.map_filter(args, lambda k, v: k != "task_name"), F.create_map(F.lit("task_name"), task))))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    body = F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"]))), ", ")
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")).cast("binary"), 256)


def should_execute(status: Column, started: Column, now: Column, limit: int = LIMIT_SECONDS) -> Column:
    """Run a task unless it succeeded or is still within its time; null status means it is unknown."""
    stuck = started.isNotNull() & ((F.unix_micros(now) - F.unix_micros(started)) > (limit + GRACE_SECONDS) * 1_000_000)
    return F.when(status.isNull(), True).when(status == "SUCCESS", False).when(status.isin("PENDING", "STARTED", "RETRY"), F.coalesce(stuck, F.lit(False))).otherwise(True)


def kept_records(ledger: DataFrame, now: Column, retention: int = RETENTION_SECONDS) -> DataFrame:
    """What the clean-up leaves."""
    return ledger.where(F.unix_micros("created_at") >= F.unix_micros(now) - retention * 1_000_000)


DATASET = (
    "name string, description string, version string, created_at string, "
    "questions array<struct<id:string,question:string,reference_answer:string,question_type:string,difficulty:string,language:string,source_chunks:array<string>,source_documents:array<string>,metadata:map<string,string>,created_at:string>>, "
    "retrieval_examples array<struct<id:string,query:string,relevant_chunks:array<string>,irrelevant_chunks:array<string>,language:string,difficulty:string,metadata:map<string,string>>>, statistics string"
)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation dataset file."""
    return spark.read.schema(DATASET).option("multiLine", True).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """K8: one JSON object a row."""
    rows.write.mode("overwrite").json(path)
