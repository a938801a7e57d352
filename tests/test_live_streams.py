"""Deduped ingest, J1, R7, R10 and R11 as live streams: state, timers, late rows, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.fixtures import table
from millrace.operators import jobs, parcels
from millrace.streaming import streams
from test_oracles import SF, duck, rows  # noqa: F401

STREAMS = ["io8_event_stream_deduped", "r4_lockout_stream", "r5_deduped_window_stream", "r6_idle_session_stream", "r7_idle_sweep_stream", "r10_settle_claims_resumed", "r11_retain_stream", "j1_current_jobs_stream", "j3_throttle_stream"]
START = 1_700_000_000


@pytest.mark.parametrize("name", [n for n in STREAMS if n.endswith("_stream")])
def test_stream_oracle(spark, duck, name):  # noqa: F811
    import __spark_entry__ as entry

    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


def _replay(spark, tmp_path, batches, schema):
    """A stream of batches, a micro-batch each."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return found.withColumn("ts", F.timestamp_seconds(F.col("s") + START)).drop("s")


def _run(stream, tmp_path, mode="append"):
    streams.stateful(stream.sparkSession)
    name = f"t{random.randrange(10**9)}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name), query


def test_deduplicated(spark, tmp_path):
    batches = [[(1, 0), (2, 10), (1, 0)], [(2, 10), (3, 60)], [(3, 60), (4, 10_000)], [(4, 10_000)], [(5, 10_001), (1, 0)]]
    out, query = _run(streams.deduplicated(_replay(spark, tmp_path, batches, "event_id long, s long"), late="1 hour"), tmp_path)
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 4, 5]
    assert streams.dropped_rows(query) == 1  # the repeat that came behind the watermark


def test_idle_keys_leave_and_come_back(spark, tmp_path):
    batches = [[("a", 0), ("b", 0)], [("a", 50)], [("c", 500)], [("c", 501)], [("a", 600)], [("c", 900)], [("c", 901)]]
    out, _ = _run(streams.idle_sweep_stream(_replay(spark, tmp_path, batches, "client string, s long"), 100, late="10 seconds"), tmp_path)
    told = sorted((r.key, r.last // 1_000_000 - START) for r in out.collect())
    assert told == [("a", 50), ("a", 600), ("b", 0)]


def test_current_jobs_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    updates = [(f"j{rng.randrange(5)}", i, rng.randrange(50), rng.choice([None, "queued", "done"]), rng.choice([None, 1, 2]), rng.choice([None, "e"])) for i in range(120)]
    schema = "job_id string, seq long, s long, status string, progress_permille long, error string"
    stream = _replay(spark, tmp_path, [updates[i::4] for i in range(4)], schema)
    streams.stateful(spark)
    streams.run_batches(streams.current_jobs_stream(stream), streams.upsert_batch(f"{tmp_path}/jobs", "job_id"), f"{tmp_path}/state", "update")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/jobs").select("job_id", "status", "progress_permille", "error", "t").collect()}
    batch = jobs.current_jobs(spark.createDataFrame(updates, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + START)))
    want = {tuple(r) for r in batch.select("job_id", "status", F.col("progress_permille").cast("string"), "error", F.unix_micros("updated_at")).collect()}
    assert got == want


def test_current_jobs_need_no_python_state(spark, tmp_path):
    stream = _replay(spark, tmp_path, [[("j", 1, 5, "a", None, None)], [("j", 2, 4, "b", 7, None)], [(None, 3, 9, "c", 8, "e")]], "job_id string, seq long, s long, status string, progress_permille long, error string")
    current = streams.current_jobs_stream(stream)
    assert "TransformWithState" not in current._jdf.queryExecution().logical().toString()
    out, query = _run(current, tmp_path, "update")
    assert [tuple(r)[:4] for r in out.orderBy(F.col("progress_permille").desc_nulls_last()).collect()] == [("j", "a", "7", None), ("j", "a", None, None)]
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_a_file_of_a_stream_is_read_by_many(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from millrace.plans.streams import _file

    rows = spark.range(0, 3_000_000, 1, 4).select(F.xxhash64("id").alias("a"))
    _file(rows, f"{tmp_path}/in")
    (path,) = glob.glob(f"{tmp_path}/in/*.parquet")
    assert pq.ParquetFile(path).num_row_groups > 1 and pq.ParquetFile(path).metadata.num_rows == 3_000_000


def _parcels(spark):
    made = [("111111", 0, 2, 0, ""), ("222222", 1, 0, 1, ""), ("333333", 0, 0, 0, "")]
    ends = F.timestamp_seconds(F.lit(START) + 5000)
    return spark.createDataFrame([(c, b, m, n, t, "rel") for c, b, m, n, t in made], "code string, burn_after int, max_downloads int, download_count int, text_payload string, stored_rel string").withColumn("expires_at", ends)


def test_claims_go_on_from_a_ledger(spark, tmp_path):
    packages = _parcels(spark)
    first = spark.createDataFrame([("ok", "11 1111"), ("ok", "333333"), ("exhausted", "111111"), ("ok", None)], "outcome string, code string")
    settled = streams.ledger(first, packages)
    assert {tuple(r) for r in settled.collect()} == {("111111", 1, False), ("333333", 1, False)}
    claims = [[("111111", 1, 10), ("11 1111", 2, 11), ("333333", 3, 12)], [("222222", 4, 20)]]
    stream = _replay(spark, tmp_path, claims, "code string, claim_id long, s long")
    out, _ = _run(streams.settle_claims_stream(packages, stream, settled=settled), tmp_path)
    assert sorted(map(tuple, out.collect())) == [(1, "111111", "ok"), (2, "11 1111", "exhausted"), (3, "333333", "ok"), (4, "222222", "exhausted")]


def test_codes_share_buckets_and_parcels_share_codes(spark, tmp_path):
    rng = random.Random(3)
    made = [(f"p{i:03}", f"1234{rng.randrange(60):02}", rng.randrange(4), int(rng.random() < 0.2), rng.choice(["", "rel", "rel"])) for i in range(90)]
    packages = spark.createDataFrame(made, "id string, code string, max_downloads int, burn_after int, stored_rel string").selectExpr("*", "0 AS download_count", "'' AS text_payload", "timestamp'2030-01-01' AS expires_at")
    claims = [(f"1234{rng.randrange(64):02}", i, i) for i in range(400)]
    stream = _replay(spark, tmp_path, [claims[:200], claims[200:]], "code string, claim_id long, s long")
    out, query = _run(streams.settle_claims_stream(packages, stream), tmp_path)
    whole = spark.createDataFrame(claims, "code string, claim_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + START))
    want = parcels.settle_claims(packages, whole).select("claim_id", "code", "outcome").collect()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want)) and len(want) > 500
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # a bucket, not a row for each code


def _shared(spark):
    rng = random.Random(4)
    made = [(f"p{i:03}", f"1234{rng.randrange(9):02}", rng.randrange(7), int(rng.random() < 0.2), rng.choice(["", "rel", "rel"]), START + rng.randrange(500)) for i in range(60)]
    packages = spark.createDataFrame(made, "id string, code string, max_downloads int, burn_after int, stored_rel string, e long").selectExpr("*", "0 AS download_count", "'' AS text_payload", "timestamp_seconds(e) AS expires_at")
    return packages, [(f"1234{rng.randrange(10):02}", i, i) for i in range(400)]


def test_a_ledger_counts_good_claims_of_parcels_that_share_a_code(spark, tmp_path):
    packages, claims = _shared(spark)
    first = spark.createDataFrame(claims[:20], "code string, claim_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + START))
    before = parcels.settle_claims(packages, first)
    settled = streams.ledger(before, packages, first)
    out, _ = _run(streams.settle_claims_stream(packages, _replay(spark, tmp_path, [claims[20:]], "code string, claim_id long, s long"), settled=settled), tmp_path)
    whole = spark.createDataFrame(claims, "code string, claim_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + START))
    want = parcels.settle_claims(packages, whole).select("claim_id", "code", "outcome").collect()
    got = [*out.collect(), *before.select("claim_id", "code", "outcome").collect()]
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.outcome for r in want}) == 5


def test_claims_pass_the_state_once_however_many_parcels_share_their_code(spark, tmp_path):
    packages, claims = _shared(spark)
    claims.append((None, 400, 400))
    out, query = _run(streams.settle_claims_stream(packages, _replay(spark, tmp_path, [claims], "code string, claim_id long, s long")), tmp_path)
    whole = spark.createDataFrame(claims, "code string, claim_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + START))
    want = parcels.settle_claims(packages, whole).select("claim_id", "code", "outcome").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(out.collect(), key=key) == sorted(want, key=key) and len(want) > 1000
    plan = query._jsq.explainInternal(False)
    behind, before = plan.split("TransformWithState", 1)
    assert "Generate" in behind and "Generate" not in before


def test_late_claims_are_dropped_and_counted_and_state_goes(spark, tmp_path):
    claims = [[("111111", 1, 100), ("333333", 2, 100)], [("333333", 3, 9000)], [("111111", 5, 9001)], [("333333", 4, 200), ("333333", 6, 9100)]]
    stream = _replay(spark, tmp_path, claims, "code string, claim_id long, s long")
    out, query = _run(streams.settle_claims_stream(_parcels(spark), stream, expire=True, late="10 minutes"), tmp_path)
    assert sorted((r.claim_id, r.outcome) for r in out.collect()) == [(1, "ok"), (2, "ok"), (3, "expired"), (5, "expired"), (6, "expired")]
    assert streams.dropped_rows(query) == 1


def test_the_throttle_outlives_a_restart(spark, tmp_path):
    path, now = str(tmp_path / "kept"), ["2024-03-10T00:00:00"]
    rows_of = lambda *days: spark.createDataFrame([(d,) for d in days], "day string").select(F.to_timestamp("day").alias("created_at"))
    streams.retain_batch(path, 5, lambda b: now[0])(rows_of("2024-03-09", None), 0)
    now[0] = "2024-03-10T00:04:00"
    streams.retain_batch(path, 5, lambda b: now[0])(rows_of("2024-03-01"), 1)  # a new process within 300 seconds: nothing is removed
    assert spark.read.parquet(path).count() == 2
    now[0] = "2024-03-10T00:05:00"
    streams.retain_batch(path, 5, lambda b: now[0])(rows_of("2024-03-08"), 2)
    assert sorted(str(r.created_at)[:10] for r in spark.read.parquet(path).collect()) == ["2024-03-08", "2024-03-09"]


def test_settled_in_two_runs_is_settled_at_once(spark, duck):  # noqa: F811
    from millrace.plans import streams as plans

    got = {tuple(r) for r in plans.QUERIES["r10_settle_claims_resumed"][0](spark, SF).select("claim_id", "outcome").collect()}
    assert got == {tuple(r) for r in parcels.settle_claims(table(spark, SF, "packages"), table(spark, SF, "claims")).select("claim_id", "outcome").collect()}
