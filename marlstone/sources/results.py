"""Evaluation results as JSON files."""

from __future__ import annotations

import dataclasses
import datetime
import enum
import json
import math

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

FIELDS = ["timestamp", "overall_score", "total_questions", "retrieval_metrics", "generation_metrics", "end_to_end_metrics", "question_type_breakdown", "language_breakdown", "detailed_results", "config"]


def plain(value):
    """``value`` as JSON has it, at any depth: enums by value, rows, data classes and objects by their public fields, numbers that are none as null."""
    if isinstance(value, enum.Enum):
        return plain(value.value)
    if isinstance(value, Row):
        return plain(value.asDict())
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, dict):
        return {str(plain(k)): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset | np.ndarray):
        return [plain(v) for v in (sorted(value, key=repr) if isinstance(value, set | frozenset) else value)]
    if isinstance(value, np.generic):
        return plain(value.item())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value is None or isinstance(value, str | int | bool):
        return value
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return {k: plain(v) for k, v in vars(value).items() if not k.startswith("_")} if hasattr(value, "__dict__") else str(value)


def write_results(spark: SparkSession, results: dict, path: str) -> None:
    """K8: one file's worth of results; parts that are missing are null."""
    body = json.dumps({f: plain(results.get(f)) for f in FIELDS}, ensure_ascii=False)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, overall_score, total_questions, and a JSON string for each part) of every file."""
    rows = spark.read.text(path, wholetext=True)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    kinds = {"overall_score": "double", "total_questions": "long"}
    return rows.select(*[field(n).cast(kinds.get(n, "string")).alias(n) for n in FIELDS])
