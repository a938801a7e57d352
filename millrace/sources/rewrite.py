"""Changes of stored tables by folders: only folders that hold a changed row are written anew.

A table is Parquet under one folder for each value of its partition column. A change is staged first: the new rows
of the touched folders, then their list, whose _SUCCESS file marks the stage as whole. Then the folders are
replaced by a dynamic overwrite, empty ones are deleted, and the stage goes. If that is broken off, `recover` (which
every change calls first) repeats it from the stage; a stage without its mark is thrown away. Files of other folders
aren't touched. One writer at a time; names that begin with `_` are hidden from readers.

Folders are handled through Hadoop's file system in the driver's JVM, so a classic session is needed, not Spark Connect.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGE = "_rewrite"


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.spark, self.text, self.path = spark, path, jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path)) if self.exists() else []

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def __truediv__(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.text.rstrip('/')}/{name}")


def store(df: DataFrame, path: str, part: str) -> None:
    """A new table with a folder, and one file, for each value of `part`."""
    df.repartition(part).write.partitionBy(part).parquet(path)


def recover(spark: SparkSession, path: str) -> None:
    """Finishes a change that was broken off after it had been staged as a whole."""
    for name in (Folder(spark, path) / STAGE).names():
        stage = Folder(spark, path) / STAGE / name
        if (stage / "touched" / "_SUCCESS").exists():
            _swap(spark, path, stage)
        else:
            stage.delete()


def _swap(spark: SparkSession, path: str, stage: Folder) -> None:
    touched = spark.read.parquet(f"{stage.text}/touched").collect()
    part = touched[0].part
    rows = spark.read.parquet(f"{stage.text}/rows")
    rows.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    filled = set(_values(rows, part))
    for r in touched:
        if r.value not in filled:
            (Folder(spark, path) / f"{part}={r.value if r.value is not None else '__HIVE_DEFAULT_PARTITION__'}").delete()
    stage.delete()


def rewrite(spark: SparkSession, path: str, part: str, rows: DataFrame, touched: list[str | None]) -> None:
    """`rows` (with the string column `part`) become the whole content of the folders of the `touched` values; those without rows go.

    The driver holds the list of touched folders.
    """
    if not touched:
        return
    stage = Folder(spark, path) / STAGE / uuid.uuid4().hex
    rows.repartition(part).write.parquet(f"{stage.text}/rows")
    spark.createDataFrame([(part, v) for v in touched], "part string, value string").write.parquet(f"{stage.text}/touched")
    _swap(spark, path, stage)


def stored(spark: SparkSession, path: str, part: str, values: list[str | None] | None = None) -> DataFrame:
    """The table, or its folders of some values; `part` is a string."""
    rows = spark.read.parquet(path)
    rows = rows.withColumn(part, F.col(part).cast("string")) if dict(rows.dtypes)[part] != "string" else rows
    if values is None:
        return rows
    named = F.col(part).isin([v for v in values if v is not None])
    return rows.filter(named | F.col(part).isNull() if None in values else named)


def _values(df: DataFrame, part: str) -> list[str | None]:
    return [r[0] for r in df.select(part).distinct().collect()]


def remove(spark: SparkSession, path: str, part: str, gone: Column) -> None:
    """Deletes the rows where `gone` holds (null counts as not)."""
    recover(spark, path)
    gone = F.coalesce(gone, F.lit(False))
    touched = _values(stored(spark, path, part).filter(gone), part)
    rewrite(spark, path, part, stored(spark, path, part, touched).filter(~gone), touched)


def remove_ids(spark: SparkSession, path: str, part: str, ids: DataFrame, key: str = "id") -> None:
    """Deletes the rows whose key is in `ids` (a column of that name)."""
    recover(spark, path)
    wanted = ids.select(key).distinct()
    touched = _values(stored(spark, path, part).join(wanted, key, "left_semi"), part)
    rewrite(spark, path, part, stored(spark, path, part, touched).join(wanted, key, "left_anti"), touched)


def drop_folders(spark: SparkSession, path: str, part: str, values: DataFrame) -> None:
    """Deletes whole folders, those of the values in the only column of `values`."""
    recover(spark, path)
    rewrite(spark, path, part, stored(spark, path, part).limit(0), _values(values.toDF(part), part))


def upsert(spark: SparkSession, path: str, part: str, rows: DataFrame, key: str) -> None:
    """Rows replace those of their key, or are added; a key never changes its folder. A table that isn't there is made."""
    if any("=" in name for name in Folder(spark, path).names()):
        recover(spark, path)
        touched = _values(rows, part)
        old = stored(spark, path, part, touched).join(rows.select(key), key, "left_anti")
        rewrite(spark, path, part, old.select(*rows.columns).unionByName(rows), touched)
    else:
        rows.repartition(part).write.mode("overwrite").partitionBy(part).parquet(path)
