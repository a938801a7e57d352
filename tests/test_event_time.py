"""State of live streams goes by event time; batches of R11 that are replayed are stored once."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from millrace.operators import jobs, requests
from millrace.streaming import streams

#: Micro-batches of (key, seconds, progress): an outage of a day lies before the second one. Rows behind the
#: watermark are dropped from the second batch on after the one that moved it.
BATCHES = [[("a", 0, 0.0), ("a", 1, 0.1), ("a", 2, 0.5), ("c", 2, 0.1)], [("a", 5, 0.52), ("b", 90_000, 0.1)], [("a", 90_001, 0.53), ("b", 90_002, 0.11)], [("b", 90_003, 0.12)]]
LATE = ("a", 3, 0.9)


def _frame(spark, rows, first):
    made = spark.createDataFrame([(k, s, p, first + i) for i, (k, s, p) in enumerate(rows)], "client string, s long, progress double, event_id long")
    return made.select("client", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "progress", "event_id", F.lit(False).alias("ok"), F.col("client").alias("job_id"), F.col("event_id").alias("seq"))


FORMS = {
    "sliding": (lambda r: streams.sliding_stream(r, 2, 10), lambda r: requests.sliding_check(r, 2, 10)),
    "lockout": (lambda r: streams.lockout_stream(r, 3, 10, 20), lambda r: requests.lockouts(r, 3, 10, 20)),
    "throttle": (lambda r: streams.throttle_stream(r, 0.2, 60.0), lambda r: jobs.throttle_progress(r, 0.2, 60.0)),
}

VARIABLES = {"sliding": "live", "lockout": "state", "throttle": "last"}


@pytest.mark.parametrize("form", FORMS)
def test_state_goes_by_event_time(spark, tmp_path, form):
    streams.stateful(spark)
    stream, batch = FORMS[form]
    folder = str(tmp_path / "in")
    for n, rows in enumerate(BATCHES):
        _frame(spark, [*rows, *([LATE] if n == 3 else [])], 10 * n).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream(source).writeStream.format("memory").queryName(f"kept_{form}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    whole = reduce(lambda a, b: a.unionByName(b), [_frame(spark, rows, 10 * n) for n, rows in enumerate(BATCHES)])
    assert sorted(map(tuple, spark.table(f"kept_{form}").collect())) == sorted(map(tuple, batch(whole).collect()))  # the late row is dropped
    left = spark.read.format("statestore").option("stateVarName", VARIABLES[form]).load(str(tmp_path / "state"))
    assert {r.key.key for r in left.collect()} == {"a", "b"}  # nothing that can still come depends on c


def test_retain_replayed(spark, tmp_path):
    path = str(tmp_path / "kept")
    now = ["2024-03-10T00:00:00"]
    run = streams.retain_batch(path, 5, lambda batch: now[0])
    rows = spark.createDataFrame([(1, "2024-03-01"), (2, "2024-03-06"), (3, "2024-03-09")], "id long, day string").select("id", F.to_timestamp("day").alias("created_at"))
    run(rows, 0)
    run(rows.filter("id > 1"), 1)
    run(rows.filter("id > 1"), 1)
    ids = lambda: sorted(r.id for r in spark.read.parquet(path).collect())
    assert ids() == [2, 2, 3, 3]
    now[0] = "2024-03-12T00:00:00"
    run(rows.filter("id = 3"), 2)
    assert ids() == [3, 3, 3]
    now[0] = "2024-03-12T00:04:00"  # within the throttle: what has run out stays for now
    run(rows.filter("id = 1"), 3)
    assert ids() == [1, 3, 3, 3]
    now[0] = "2024-03-12T00:05:00"
    run(rows.filter("id = 3"), 4)
    assert ids() == [3, 3, 3, 3]
