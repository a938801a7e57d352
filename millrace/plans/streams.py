"""Registered queries of streaming.streams: a table's files are replayed as a stream until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import oracle, table
from ..operators.catalog import tool_from_path
from ..session import scratch
from ..sources.files import event_stream
from ..streaming import streams as st
from .requests import DAY

_FIXED = f"SELECT start, client, n FROM (SELECT strftime(make_timestamp(CAST(floor(epoch(ts) / {DAY}) AS BIGINT) * {DAY}000000), '%Y-%m-%d') AS start, client, count(*) AS n FROM $requests GROUP BY 1, 2) WHERE CAST(start AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM $requests)"


PARTS = 4


def _file(rows: DataFrame, folder: str) -> None:
    """One more file of a stream: found by many tasks, and in small row groups, so that many read it."""
    rows.repartition(1).write.mode("append").option("parquet.block.size", 8 << 20).parquet(folder)


def _parts(df: DataFrame, ts: str, back: str = "0 seconds") -> DataFrame:
    """A stream of a table's rows, a file a micro-batch in order of time: as many equal spans of time, each file with
    the last rows of the one before it (of `back`) once more. Rows without time are in the first."""
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    low, high = (x.timestamp() if x else 0.0 for x in df.agg(F.min(F.col(ts).cast("timestamp")), F.max(F.col(ts).cast("timestamp"))).first())
    span = max(1.0, (high - low) / PARTS)
    for i in range(PARTS):
        at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
        again = F.expr(f"INTERVAL '{back}'") if i else F.expr("INTERVAL '0 seconds'")
        after = (F.col(ts).cast("timestamp") + again).cast("timestamp")
        fine = (F.unix_micros(after) / 1e6 >= low + i * span) & ((at < low + (i + 1) * span) | F.lit(i == PARTS - 1))
        _file(df.filter(fine | (F.col(ts).isNull() & F.lit(i == 0))), folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _deduped(s: SparkSession, d: str) -> DataFrame:
    """IO8 with repeats: each file repeats the last two days of the one before it, and each row counts once."""
    stream = st.deduplicated(_parts(table(s, d, "requests"), "ts", "2 days"), late="3 days")
    return _out(s, stream).groupBy("client", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))


def _deduped_windows(s: SparkSession, d: str) -> DataFrame:
    """R5 behind the dedupe: windows of rows that the source delivers twice count each once."""
    stream = st.deduplicated(_parts(table(s, d, "requests"), "ts", "2 days"), late="3 days")
    days = stream.groupBy(F.window("ts", f"{DAY} seconds"), "client").agg(F.count(F.lit(1)).alias("n"))
    return _out(s, days.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "client", "n"))


def _current(s: SparkSession, d: str) -> DataFrame:
    """J1 from files that come in no order of time, upserted into a stored table batch by batch."""
    updates, folder = table(s, d, "job_updates"), scratch(s)
    for i in (2, 0, 3, 1):
        _file(updates.filter(F.pmod(F.xxhash64("seq"), F.lit(PARTS)) == i), f"{folder}/in")
    stream = s.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    st.stateful(s)
    st.run_batches(st.current_jobs_stream(stream), st.upsert_batch(f"{folder}/jobs", "job_id"), f"{folder}/state", "update")
    return s.read.parquet(f"{folder}/jobs").select("job_id", "status", F.col("progress_permille").cast("long").alias("progress_permille"), "error")


def _resumed(s: SparkSession, d: str) -> DataFrame:
    """R10 in two runs: the second begins with the ledger of the first."""
    packages, claims = table(s, d, "packages"), table(s, d, "claims")
    middle = claims.agg(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0.5)).cast("long")).first()[0] or 0
    early = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) <= middle, F.lit(True))
    runs, folder = [], scratch(s)
    for name, half in (("first", claims.filter(early)), ("second", claims.filter(~early))):
        half.write.parquet(f"{folder}/{name}")
        stream = s.readStream.schema(claims.schema).parquet(f"{folder}/{name}")
        settled = st.ledger(runs[0], packages, s.read.parquet(f"{folder}/first")) if runs else None
        runs.append(_out(s, st.settle_claims_stream(packages, stream, settled=settled)))
    return runs[0].unionByName(runs[1])


def _retained(s: SparkSession, d: str) -> DataFrame:
    """Uploads stored as they come; what is left by month when all have come. The clock is each batch's newest row."""
    folder = scratch(s)
    clock = lambda batch: str(batch.agg(F.max("created_at")).first()[0])
    stream = _parts(table(s, d, "records").withColumn("created_at", F.date_trunc("month", "created_at")), "created_at")
    st.run_batches(stream, st.retain_batch(f"{folder}/kept", 400, clock), f"{folder}/state")
    return s.read.parquet(f"{folder}/kept").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("input_bytes").alias("input_bytes"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO8: the requests view over a stream of the events' files."""
    events = table(spark, sf_dir, "events")
    stream = event_stream(spark, f"{sf_dir}/events*.parquet", events.schema.simpleString()[7:-1].replace(":", " "))
    return stream.select(
        "event_id",
        F.col("user_id").cast("string").alias("client"),
        "ts",
        F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        F.when(F.col("event_type") == "click", "/tools/html2md/convert").when(F.col("event_type") == "purchase", "/tools/express/pickup").when(F.col("event_type") == "signup", "/tools/json/format").when(F.col("event_type") == "view", "/static/app.css").otherwise("/tools/regex/test?x=1").alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.floor("value").cast("long").alias("ms"),
    )


def _out(spark: SparkSession, stream: DataFrame) -> DataFrame:
    st.stateful(spark)
    folder = scratch(spark)
    return st.to_parquet(stream, f"{folder}/out", f"{folder}/state")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as a stream: written once as a file, for the view's numbering needs all rows."""
    folder = scratch(spark)
    claims = table(spark, sf_dir, "claims")
    claims.write.parquet(f"{folder}/claims")
    return spark.readStream.schema(claims.schema).parquet(f"{folder}/claims")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir)
    return r.select(F.col("client").alias("job_id"), F.col("event_id").alias("seq"), "ts", (F.col("ms") / 1000).alias("progress"))


def _settled() -> str:
    from .parcels import QUERIES as P

    return P["p10_settle_claims"][1]


def _sliding() -> str:
    from .requests import QUERIES as R

    return R["r2_sliding_check"][1].replace("event_id, allowed, retry_after, remaining FROM s", "event_id AS id, allowed, retry_after, remaining FROM s")


def _of(module: str, name: str) -> str:
    from . import jobs, requests

    return {"jobs": jobs, "requests": requests}[module].QUERIES[name][1]


_LAST = "(SELECT max(ts) FROM $requests)"
_SESSIONS = f"""SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, client, count(*) AS n FROM (
        SELECT client, ts, sum(fresh) OVER (PARTITION BY client ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY client ORDER BY ts, event_id) < 21601000000 THEN 0 ELSE 1 END AS fresh FROM $requests))
        GROUP BY client, session HAVING max(ts) + INTERVAL 21601 SECOND <= {_LAST} - INTERVAL 1 HOUR"""

#: Windowed streams give out the windows that the watermark (an hour behind the last row) has passed; so does their SQL.
QUERIES = {
    "io8_event_stream": (lambda s, d: _out(s, _requests(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n")), "SELECT status, count(*) AS n FROM $requests GROUP BY 1"),
    "io8_event_stream_deduped": (_deduped, "SELECT client, status, count(*) AS n, count(DISTINCT event_id) AS events FROM $requests GROUP BY 1, 2"),
    "r2_sliding_stream": (lambda s, d: _out(s, st.sliding_stream(_requests(s, d), 3, DAY, expire=False)), _sliding()),
    "r4_lockout_stream": (lambda s, d: _out(s, st.lockout_stream(_requests(s, d).withColumn("ok", F.col("method") == "GET"), 3, 2 * DAY, 3 * DAY, expire=False)), f"SELECT key, event_id AS id, state FROM ({_of('requests', 'r4_lockouts')})"),
    "r5_fixed_window_stream": (lambda s, d: _out(s, st.fixed_window_stream(_requests(s, d), DAY)).withColumn("start", F.date_format("start", "yyyy-MM-dd")), _FIXED),
    "r5_deduped_window_stream": (_deduped_windows, _FIXED.replace("INTERVAL 1 HOUR", "INTERVAL 3 DAY")),
    "r6_idle_session_stream": (lambda s, d: _out(s, st.idle_session_stream(_requests(s, d), 6 * 3600)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), _SESSIONS),
    "r7_idle_sweep_stream": (lambda s, d: _out(s, st.idle_sweep_stream(_requests(s, d), 6 * 3600)).select(F.col("key").alias("client")), f"SELECT client FROM $requests GROUP BY 1 HAVING max(ts) + INTERVAL 6 HOUR < {_LAST} - INTERVAL 1 HOUR"),
    "r9_rollup_stream": (lambda s, d: _out(s, st.rollup_stream(_requests(s, d), tool_from_path(F.col("path")), "1 day")), None),
    "r10_settle_claims_stream": (lambda s, d: _out(s, st.settle_claims_stream(table(s, d, "packages"), _claims(s, d))), _settled()),
    "r10_settle_claims_resumed": (_resumed, _settled()),
    "r11_retain_stream": (_retained, "SELECT month, n, input_bytes FROM (SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n, CAST(sum(input_bytes) AS BIGINT) AS input_bytes FROM $records WHERE created_at IS NOT NULL GROUP BY 1) WHERE CAST(concat(month, '-01') AS DATE) >= CAST(date_trunc('month', (SELECT max(created_at) FROM $records)) - INTERVAL 400 DAY AS DATE)"),
    "j1_current_jobs_stream": (_current, _of("jobs", "j1_current_jobs")),
    "j3_throttle_stream": (lambda s, d: _out(s, st.throttle_stream(_updates(s, d), 0.2, 6 * 3600.0, expire=False)), f"SELECT job_id AS key, seq AS id FROM ({_of('jobs', 'j3_throttle_progress')})"),
}
QUERIES = {k: (f, sql and oracle(sql)) for k, (f, sql) in QUERIES.items()}
