"""Session builder with the settings the package relies on, and tables kept in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Unless the session says how large Arrow batches may be, they are small: each task holds some in the JVM and, several times over, in Python."""
    if ARROW_BYTES not in dict(spark.conf.getAll):
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def session(app: str = "marlstone", **settings: str) -> SparkSession:
    """A session; keyword settings use __ for dots (spark__master="local[8]"). On a cluster, spark.checkpoint.dir must name a
    folder that all executors share; operators keep intermediate tables there."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def kept_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is not set, one of this machine's, but only if the whole job runs on it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/marlstone-kept"
    return f"{base}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once: written to the shared folder and read back, so that several readers do not compute it again."""
    path = kept_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
