"""Registered queries of sources.rewrite: stored tables of which only folders with changed rows are written anew.

Each returns, for every folder that was there, the rows that are left and whether its files were written anew
(by names and modification times).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import NOW, oracle, table
from ..operators import activity, parcels
from ..session import scratch, written
from ..sources import rewrite as w
from .parcels import QUERIES as P
from .parcels import THEN


def _files(spark: SparkSession, path: str, part: str) -> DataFrame:
    seen = spark.read.parquet(path).select(F.col(part).cast("string"), "_metadata.file_name", F.col("_metadata.file_modification_time").alias("at"))
    return written(seen.distinct())


def changed(spark: SparkSession, rows: DataFrame, part: str, change: Callable[[str], None], *more: Column) -> DataFrame:
    """(`part`, n, rewritten, more...) after `change(path)` of a table of `rows`."""
    path = scratch(spark)
    w.store(rows, path, part)
    before = _files(spark, path, part)
    change(path)
    gone = before.join(_files(spark, path, part), [part, "file_name", "at"], "left_anti").select(part).distinct().withColumn("gone", F.lit(True))
    left = w.stored(spark, path, part).groupBy(part).agg(F.count(F.lit(1)).alias("n"), *more)
    out = before.select(part).distinct().join(left, part, "left").join(gone, part, "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "rewritten": F.coalesce("gone", F.lit(False))}).drop("gone")


def _month(at: str) -> Column:
    return F.coalesce(F.date_format(at, "'m'yyyy-MM"), F.lit("none"))


def _records(s, d):
    return table(s, d, "records").withColumn("month", _month("created_at"))


def _packages(s, d):
    return table(s, d, "packages").withColumn("month", _month("created_at"))


def _apply(s, d):
    """Counts of good claims go into the ledger; only months with a parcel that a claim used up are rewritten."""
    used = written(parcels.used_up(table(s, d, "packages"), table(s, d, "claims")))

    def change(path: str) -> None:
        w.recover(s, path)
        months = [r[0] for r in w.stored(s, path, "month").join(used, F.col("code") == F.col("c"), "left_semi").select("month").distinct().collect()]
        w.rewrite(s, path, "month", parcels.apply_used(w.stored(s, path, "month", months), used), months)

    burnt = F.count_if((F.col("burn_after") == 1) & (F.col("text_payload") == "") & (F.col("stored_rel") == ""))
    return changed(s, _packages(s, d), "month", change, F.sum("download_count").cast("long").alias("used"), burnt.alias("burnt"))


def _folders(s, d):
    """Files in folders that are named by the first day of their month."""
    return table(s, d, "files").withColumn("day", F.concat(F.substring("day", 1, 7), F.lit("-01")))


def _drop_days(s, d):
    days = activity.expired_days(_folders(s, d), NOW, 400).select("day")
    return changed(s, _folders(s, d), "day", lambda path: w.drop_folders(s, path, "day", days))


def _picked(s, d):
    return table(s, d, "records").filter("input_bytes % 50000 = 7").select("id")


_MONTH = "coalesce(strftime(created_at, 'm%Y-%m'), 'none') AS month"
_CUT = f"created_at IS NULL OR created_at < TIMESTAMP '{NOW}' - INTERVAL '400' DAY"


def _left(rows: str, gone: str) -> str:
    return f"SELECT month, count(*) FILTER (WHERE NOT gone) AS n, count(*) FILTER (WHERE gone) > 0 AS rewritten FROM (SELECT {_MONTH}, coalesce({gone}, false) AS gone FROM {rows}) GROUP BY 1"


QUERIES = {
    "a8_retain_rewrite": (lambda s, d: changed(s, _records(s, d), "month", lambda path: w.remove(s, path, "month", activity._expired(NOW, 400))), _left("$records", _CUT)),
    "a9_drop_days": (
        _drop_days,
        f"""SELECT day, CASE WHEN gone THEN 0 ELSE n END AS n, gone AS rewritten FROM (
        SELECT concat(substr(day, 1, 7), '-01') AS day, count(*) AS n, concat(substr(day, 1, 7), '-01') < strftime(TIMESTAMP '{NOW}' - INTERVAL '400' DAY, '%Y-%m-%d') AND max(mtime) < TIMESTAMP '{NOW}' - INTERVAL '400' DAY AS gone FROM $files GROUP BY 1)""",
    ),
    "a13_delete_rewrite": (lambda s, d: changed(s, _records(s, d), "month", lambda path: w.remove_ids(s, path, "month", _picked(s, d))), _left("$records", "input_bytes % 50000 = 7")),
    "p6_purge_rewrite": (lambda s, d: changed(s, _packages(s, d), "month", lambda path: w.remove(s, path, "month", ~F.coalesce(F.col("expires_at") > F.lit(THEN).cast("timestamp_ntz"), F.lit(False)))), _left("$packages", f"(expires_at > TIMESTAMP '{THEN}') IS NOT TRUE")),
    "p12_apply_rewrite": (
        _apply,
        f"""SELECT month, count(*) AS n, CAST(sum(a.download_count) AS BIGINT) AS used, count(*) FILTER (WHERE p.burn_after = 1 AND p.text_payload = '' AND a.stored_rel = '') AS burnt, max(a.download_count - p.download_count) > 0 AS rewritten
        FROM (SELECT *, {_MONTH} FROM $packages) p JOIN ({P["p12_apply_claims"][1]}) a ON a.id = p.id GROUP BY 1""",
    ),
}
QUERIES = {k: (f, oracle(sql)) for k, (f, sql) in QUERIES.items()}
