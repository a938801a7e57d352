"""Streams replayed from a table of several files that are out of order lose no row."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.fixtures import table
from millrace.operators import jobs, requests
from millrace.operators.catalog import tool_from_path
from millrace.plans import streams as plans
from millrace.plans.requests import DAY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events as files of which the first to be read is the last in time."""
    path = str(tmp_path_factory.mktemp("shuffled"))
    events = table(spark, SF, "events")
    for part in (2, 0, 3, 1):
        span = F.ntile(4).over(Window.orderBy("ts", "event_id"))
        events.withColumn("part", span).filter(F.col("part") == part + 1).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return path


def _rows(frame, *columns):
    return sorted(tuple(map(str, r)) for r in frame.select(*columns).collect())


def _closed(frame, last, *columns):
    """Rows of the windows that the watermark has passed; windows are made of all rows first."""
    return sorted(tuple(str(r[c]) for c in columns) for r in frame.collect() if r["end"] <= last)


def test_windows(spark, folder):
    r = table(spark, folder, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    last = r.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    day = F.window("ts", "1 day")
    want = r.groupBy(day.alias("w"), "client").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), F.col("w.end").alias("end"), "client", "n")
    assert _rows(plans.QUERIES["r5_fixed_window_stream"][0](spark, folder), "start", "client", "n") == _closed(want, last, "start", "client", "n")
    session = F.session_window("ts", f"{6 * 3600 + 1} seconds")
    want = r.groupBy(session.alias("w"), "client").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.col("w.end").alias("end"), "client", "n")
    assert _rows(plans.QUERIES["r6_idle_session_stream"][0](spark, folder), "start", "client", "n") == _closed(want, last, "start", "client", "n")
    want = r.groupBy(day.alias("w"), tool_from_path(F.col("path")).alias("tool")).agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("status") >= 500).alias("errors"), F.max("ms").alias("max_ms")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tool", "hits", "errors", "max_ms")
    assert _rows(plans.QUERIES["r9_rollup_stream"][0](spark, folder), "start", "tool", "hits", "errors", "max_ms") == _closed(want, last, "start", "tool", "hits", "errors", "max_ms")


def test_verdicts(spark, folder):
    r = table(spark, folder, "requests")
    got = {tuple(x) for x in plans.QUERIES["r2_sliding_stream"][0](spark, folder).collect()}
    assert got == {tuple(x) for x in requests.sliding_check(r, 3, DAY).collect()}
    got = {tuple(x) for x in plans.QUERIES["r4_lockout_stream"][0](spark, folder).collect()}
    assert got == {tuple(x) for x in requests.lockouts(r.withColumn("ok", F.col("method") == "GET"), 3, 2 * DAY, 3 * DAY).collect()}
    got = {tuple(x) for x in plans.QUERIES["j3_throttle_stream"][0](spark, folder).collect()}
    rows = table(spark, folder, "job_updates").withColumn("progress", F.col("progress_permille") / 1000)
    assert got == {tuple(x) for x in jobs.throttle_progress(rows, 0.2, 6 * 3600.0).collect()}
