"""Streams replayed to the end equal their batch forms."""

from pyspark.sql import functions as F

from millrace.fixtures import table
from millrace.operators import jobs, parcels, requests
from millrace.plans import streams as plans
from millrace.plans.requests import DAY
from millrace.streaming import streams

SF = "/root/testdata/sf0.001"


def test_sliding_stream(spark):
    got = {tuple(r) for r in plans.QUERIES["r2_sliding_stream"][0](spark, SF).collect()}
    want = {tuple(r) for r in requests.sliding_check(table(spark, SF, "requests"), 3, DAY).collect()}
    assert got == want and sum(not r[2] for r in got) > 0


def test_lockout_stream(spark):
    got = {tuple(r) for r in plans.QUERIES["r4_lockout_stream"][0](spark, SF).collect()}
    tried = table(spark, SF, "requests").withColumn("ok", F.col("method") == "GET")
    assert got == {tuple(r) for r in requests.lockouts(tried, 3, 2 * DAY, 3 * DAY).collect()}


def test_settle_stream(spark):
    got = {tuple(r) for r in plans.QUERIES["r10_settle_claims_stream"][0](spark, SF).select("claim_id", "outcome").collect()}
    want = {tuple(r) for r in parcels.settle_claims(table(spark, SF, "packages"), table(spark, SF, "claims")).select("claim_id", "outcome").collect()}
    assert got == want


def test_throttle_stream(spark):
    got = {tuple(r) for r in plans.QUERIES["j3_throttle_stream"][0](spark, SF).collect()}
    rows = table(spark, SF, "job_updates").withColumn("progress", F.col("progress_permille") / 1000)
    assert got == {tuple(r) for r in jobs.throttle_progress(rows, 0.2, 6 * 3600.0).collect()}


def test_fixed_window_stream(spark):
    got = {(r.start, r.client, r.n) for r in plans.QUERIES["r5_fixed_window_stream"][0](spark, SF).collect()}
    batch = requests.fixed_window(table(spark, SF, "requests"), 2, DAY).groupBy("bucket", "client").agg(F.max("nth").alias("n"))
    want = {(r.start, r.client, r.n) for r in batch.select(F.date_format(F.timestamp_seconds(F.col("bucket") * DAY), "yyyy-MM-dd").alias("start"), "client", "n").collect()}
    assert got and got <= want  # the last buckets are still open


def test_retain_batch(spark, tmp_path):
    path = str(tmp_path / "kept")
    records = table(spark, SF, "records").filter("created_at is not null")
    run = streams.retain_batch(path, 400, lambda batch: "1999-06-01")
    run(records, 0)
    kept = spark.read.parquet(path)
    assert kept.count() == records.filter("created_at >= timestamp_ntz '1998-04-27'").count()
