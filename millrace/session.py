"""A session with the settings that the jobs of this package assume."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A SparkSession with SETTINGS; `settings` come on top, with dots written as double underscores."""
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; without that setting a local master takes a temporary one, a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and re.fullmatch(r"local(\[[^]]*])?", spark.sparkContext.master):
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: it is computed once, and lost executors lose none of it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of few rows, so that a task's Python objects stay few however large its texts are; at the end unused memory goes back."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()
