"""Streaming forms: keyed state with time-outs and watermarked windows.

Keyed operators use transformWithStateInPandas with the RocksDB state store: `stateful(spark)` sets it.
Rows of a key are taken in order of time within a micro-batch; a row that comes in a later batch than
a younger one is taken as it comes. State is small: counters, or the last accepted times. With `expire`
the rows get a watermark of `late`, rows behind it are dropped, and a key's state goes by a timer in event
time, once no row that can still come depends on it: an outage, however long, loses none that counts.
Without it all rows are taken and state stays.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import parcels
from ..operators.jobs import FIELDS
from ..session import written
from ..sources import rewrite


def stateful(spark: SparkSession) -> None:
    """Set the state store that keyed operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Expiring(StatefulProcessor):
    """State that a timer in event time clears; `ends` tells the time (microseconds) from which no row depends on it."""

    expire = False

    def keep(self, value: tuple) -> None:
        self.state.update(value)
        if self.expire:
            self.handle.registerTimer(self.ends(value) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a later row has moved the end, and registered a timer of its own
        if self.state.exists() and self.ends(self.state.get()) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, processor: _Expiring, result: str, late: str) -> DataFrame:
    """The processor on rows by key, with a watermark on their times where state expires."""
    if processor.expire:
        rows = rows.withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(processor, result, "append", "EventTime" if processor.expire else "None")


def _sorted(rows, *by: str) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts, ignore_index=True).sort_values(list(by), ignore_index=True)


class _Sliding(_Expiring):
    """R2: state is the accepted times within the window, at most `limit`."""

    def __init__(self, limit: int, window_s: int, expire: bool):
        self.limit, self.window, self.expire = limit, window_s * 1_000_000, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("live", "times array<bigint>")

    def ends(self, value: tuple) -> int:
        return max(value[0], default=0) + self.window

    def handleInputRows(self, key, rows, timerValues):
        live = list(self.state.get()[0]) if self.state.exists() else []
        out = []
        for t, i in _sorted(rows, "t", "id")[["t", "id"]].itertuples(index=False):
            live = [x for x in live if x >= t - self.window]
            full = len(live) >= self.limit
            out.append((key[0], int(i), not full, max(1, (self.window - (t - live[0])) // 1_000_000 + 1) if full else 0, 0 if full else self.limit - len(live) - 1))
            if not full:
                live.append(int(t))
        self.keep((live,))
        yield pd.DataFrame(out, columns=["key", "id", "allowed", "retry_after", "remaining"])


def sliding_stream(requests: DataFrame, limit: int, window_s: int, key: str = "client", order: str = "event_id", expire: bool = True, late: str = "1 hour") -> DataFrame:
    """R2 on a stream: (key, id, allowed, retry_after, remaining)."""
    rows = requests.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col(order).cast("long").alias("id"))
    return _keyed(rows, _Sliding(limit, window_s, expire), "key string, id long, allowed boolean, retry_after long, remaining long", late)


class _Lockout(_Expiring):
    """State is the recent failures and the end of a lock."""

    def __init__(self, limit: int, window_s: int, lock_s: int, expire: bool):
        self.limit, self.window, self.lock, self.expire = limit, window_s * 1_000_000, lock_s * 1_000_000, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "times array<bigint>, until bigint")

    def ends(self, value: tuple) -> int:
        return max([0, value[1], *(x + self.window for x in value[0])])

    def handleInputRows(self, key, rows, timerValues):
        live, until = (list(x[0]), x[1]) if self.state.exists() and (x := self.state.get()) else ([], -(1 << 62))
        out = []
        for t, i, ok in _sorted(rows, "t", "id")[["t", "id", "ok"]].itertuples(index=False):
            if t < until:
                state = "locked"
            elif ok:
                state, live, until = "cleared", [], -(1 << 62)
            else:
                live = [x for x in live if x >= t - self.window] + [int(t)]
                state = "tripped" if len(live) >= self.limit else "counted"
                if state == "tripped":
                    live, until = [], int(t) + self.lock
            out.append((key[0], int(i), state))
        self.keep((live, until))
        yield pd.DataFrame(out, columns=["key", "id", "state"])


def lockout_stream(attempts: DataFrame, limit: int = 8, window_s: int = 600, lock_s: int = 900, key: str = "client", order: str = "event_id", expire: bool = True, late: str = "1 hour") -> DataFrame:
    """R4 on a stream of attempts with `ok`: (key, id, state)."""
    rows = attempts.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col(order).cast("long").alias("id"), "ok")
    return _keyed(rows, _Lockout(limit, window_s, lock_s, expire), "key string, id long, state string", late)


class _Throttle(_Expiring):
    """State is the last update that was kept."""

    def __init__(self, step: float, seconds: float, expire: bool):
        self.step, self.gap, self.expire = step, seconds * 1_000_000, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", "p double, t bigint")

    def ends(self, value: tuple) -> int:
        return int(value[1] + self.gap)

    def handleInputRows(self, key, rows, timerValues):
        last = self.state.get() if self.state.exists() else None
        out = []
        for t, i, p in _sorted(rows, "t", "id")[["t", "id", "p"]].itertuples(index=False):
            if last is None or not (p - last[0] < self.step and t - last[1] < self.gap):
                last = (float(p), int(t))
                out.append((key[0], int(i)))
        if last is not None:
            self.keep(tuple(last))
        yield pd.DataFrame(out, columns=["key", "id"])


def throttle_stream(updates: DataFrame, step: float = 0.02, seconds: float = 1.0, expire: bool = True, late: str = "1 hour") -> DataFrame:
    """J3 on a stream: (key, id) of the updates that are kept."""
    rows = updates.filter("progress is not null").select(F.col("job_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("seq").cast("long").alias("id"), F.col("progress").cast("double").alias("p"))
    return _keyed(rows, _Throttle(step, seconds, expire), "key string, id long", late)


def deduplicated(stream: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Rows of a source that delivers some twice, each once: a repeat that comes within `late` is dropped.

    The watermark on `ts` holds for what follows too; rows behind it are dropped. State is one key for each row
    that is not yet `late` behind.
    """
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def current_jobs_stream(updates: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """J1 on a stream: the whole row of each job (fields as strings, t in microseconds) whenever it changes, for `upsert_batch`.

    The last write of a field wins by (ts, seq), in whatever order updates come. Updates without job_id or ts are
    dropped. State is a row for each job: for each field its last value, and when that was written.
    """
    rows = updates.filter("job_id is not null and ts is not null").select("job_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("seq").cast("long").alias("seq"), *(F.col(f).cast("string") for f in fields))
    lasts = (F.max(F.when(F.col(f).isNotNull(), F.struct("t", "seq", F.col(f).alias("v")))).alias(f) for f in fields)
    return rows.groupBy("job_id").agg(*lasts, F.max("t").alias("t")).select("job_id", *(F.col(f)["v"].alias(f) for f in fields), "t")


def upsert_batch(path: str, key: str, folders: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that replaces a table's rows by those of a batch; only folders (hash slices of keys) with a change are written.

    A replayed batch writes the same rows again.
    """
    def run(batch: DataFrame, number: int) -> None:
        kept = written(batch.withColumn("slice", F.concat(F.lit("s"), F.pmod(F.xxhash64(key), F.lit(folders)).cast("string"))))
        if not kept.isEmpty():
            rewrite.upsert(batch.sparkSession, path, "slice", kept, key)

    return run


class _Idle(StatefulProcessor):
    """State is a key's last time; a timer in event time gives the key out when it has been idle for so long."""

    def __init__(self, idle_s: int):
        self.idle = idle_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows, timerValues):
        last = max([*(int(part["t"].max()) for part in rows), *([self.state.get()[0]] if self.state.exists() else [])])
        self.state.update((last,))
        self.handle.registerTimer((last + self.idle) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.state.get()[0] if self.state.exists() else None
        if last is not None and (last + self.idle) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield pd.DataFrame([(key[0], last)], columns=["key", "last"])

    def close(self) -> None:
        pass


def idle_sweep_stream(requests: DataFrame, idle_s: int = 3600, key: str = "client", late: str = "1 hour") -> DataFrame:
    """R7 on a stream: (key, last in microseconds) once a key has been idle for `idle_s` seconds by the watermark; its state goes.

    A key that comes back is given out again after its next pause.
    """
    rows = requests.filter("ts is not null").select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col("ts").cast("timestamp").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Idle(idle_s), "key string, last long", "append", "EventTime")


#: Digits of a code that name its bucket: 10,000 of them, of a hundred six-digit codes each.
BUCKET = 4


class _Settle(StatefulProcessor):
    """R10 by buckets of codes: state is how many good claims each capped code has had beyond its ledger's count, and its parcels' end.

    A claim comes once, with the number of its code's parcels it is good for, and goes on with the count before it.
    A bucket is read and written once for a micro-batch, not once for each code. With `expire` timers take codes out
    whose end the watermark has passed: later claims find them expired anyway. Claims of codes without a capped parcel
    need no state; their keys begin with `~`.
    """

    def __init__(self, expire: bool):
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("used", "codes array<string>, used array<bigint>, ends array<bigint>")

    def load(self) -> dict[str, tuple[int, int]]:
        return {c: (int(n), int(end)) for c, n, end in zip(*self.state.get(), strict=True)} if self.state.exists() else {}

    def save(self, own: dict[str, tuple[int, int]]) -> None:
        if own:
            self.state.update((list(own), [n for n, _ in own.values()], [end for _, end in own.values()]))
            if self.expire:
                self.handle.registerTimer(min(end for _, end in own.values()) // 1000 + 1)
        else:
            self.state.clear()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        own = self.load()
        for x in initialState.itertuples(index=False):
            own[x.code] = own.get(x.code, (0, 0))[0] + max(int(x.used), int(x.burnt)), int(x.ends)
        self.save(own)

    def handleInputRows(self, key, rows, timerValues):
        if key[0].startswith("~"):
            for part in rows:
                yield part[["claim_id", "c", "raw", "t"]].assign(before=0)
            return
        own, claims = self.load(), _sorted(rows, "t", "claim_id")
        by = claims.groupby("c", sort=False)
        before = by["good"].cumsum() - claims["good"] + claims["c"].map({c: n for c, (n, _) in own.items()}).fillna(0).astype("int64")
        changed = False
        for c, good, end in by.agg({"good": "sum", "ends": "max"}).itertuples():
            if good:
                used, last = own.get(c, (0, int(end)))
                own[c], changed = (used + int(good), max(int(end), last)), True
        if changed:
            self.save(own)
        yield claims[["claim_id", "c", "raw", "t"]].assign(before=before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            self.save({c: x for c, x in self.load().items() if x[1] // 1000 >= expiredTimerInfo.getExpiryTimeInMs()})
        return iter(())

    def close(self) -> None:
        pass


def ledger(outcomes: DataFrame, packages: DataFrame, claims: DataFrame | None = None, kind: str = "file") -> DataFrame:
    """(code, used, burnt) of settled claims: the state from which a stream of further ones goes on.

    Where parcels share codes, outcomes don't tell how many good claims a code has had (one that finds a parcel
    exhausted is good for it all the same): there the settled `claims` are needed, which are then counted instead.
    """
    burn = packages.select(F.col("code").alias("c"), (F.col("burn_after") == 1).alias("burn")).groupBy("c").agg(F.bool_or("burn").alias("burn"))
    ok = outcomes.filter("outcome = 'ok'").select(parcels.valid_code(F.col("code")).alias("c")).filter("c is not null").join(burn, "c", "left")
    settled = ok.groupBy(F.col("c").alias("code")).agg(F.count(F.lit(1)).alias("used"), F.coalesce(F.bool_or("burn"), F.lit(False)).alias("burnt"))
    if claims is None:
        return settled
    good = parcels.good_claims(packages, claims, kind).select(F.col("c").alias("code"), F.col("n").alias("used"))
    return good.join(settled.select("code", "burnt"), "code", "left").withColumn("burnt", F.coalesce("burnt", F.lit(False)))


def settle_claims_stream(packages: DataFrame, claims: DataFrame, kind: str = "file", settled: DataFrame | None = None, expire: bool = False, late: str = "1 hour") -> DataFrame:
    """P10 on a stream of claims, joined to the table of parcels; keyed by buckets of codes.

    settled: a `ledger` to go on from. With `expire`, claims behind the watermark are dropped (`dropped_rows` counts
    them), and a code's state goes when the watermark has passed its end. Claims of one code, however written, meet.
    They are counted as claims, and meet each parcel of their code behind the state, so what is shuffled grows with
    claims, not with claims times the parcels that share a code.
    """
    known = parcels.by_code(packages, kind)
    micros = lambda at: F.unix_micros(at.cast("timestamp"))
    never = F.lit(-(1 << 63))  # of claims without time
    claims = claims.withColumn("at", F.col("ts").cast("timestamp"))
    claims = claims.withWatermark("at", late) if expire else claims
    rows = claims.withColumn("c", parcels.valid_code(F.col("code"))).join(known.select("c", "goods", "most", "last"), "c", "left")
    bucket = lambda code: F.left(code, F.lit(BUCKET))
    apart = F.concat(F.lit("~"), F.pmod(F.xxhash64("claim_id"), F.lit(256)).cast("string"))
    rows = rows.select(
        F.when(F.col("most").isNotNull(), bucket(F.col("c"))).otherwise(apart).alias("key"),
        "c",
        F.when(F.col("c") != F.col("code"), F.col("code")).when(F.col("c").isNull(), F.col("code")).alias("raw"),
        F.coalesce(micros(F.col("ts")), never).alias("t"),
        F.col("claim_id").cast("long").alias("claim_id"),
        parcels.later("goods", F.col("ts")).cast("long").alias("good"),
        F.coalesce(micros(F.col("last")), F.lit(0)).alias("ends"),
        *(["at"] if expire else []),
    )
    start = None
    if settled is not None:
        ends = known.filter("most is not null").select(F.col("c").alias("code"), F.coalesce(micros(F.col("last")), F.lit(0)).alias("ends"))
        start = settled.join(ends, "code").select(bucket(F.col("code")).alias("key"), "code", F.col("used").cast("long").alias("used"), "burnt", "ends").groupBy("key")
    counted = rows.groupBy("key").transformWithStateInPandas(_Settle(expire), "claim_id long, c string, raw string, t long, before long", "append", "EventTime" if expire else "None", initialState=start)
    micro = known.select("c", "most", micros(F.col("until")).alias("until"), F.transform("parcels", lambda p: p.withField("ends", micros(p["ends"]))).alias("parcels"))
    return parcels.outcomes(counted.join(micro, "c", "left"), F.nullif("t", never), "claim_id", F.coalesce("raw", "c").alias("code"))


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that a query's keyed operators have dropped behind the watermark, by its recent progress."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def fixed_window_stream(requests: DataFrame, window_s: int, key: str = "client", late: str = "1 hour") -> DataFrame:
    """R5 on a stream: requests of each key and bucket, once the watermark has passed it."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{window_s} seconds"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def idle_session_stream(requests: DataFrame, window_s: int, key: str = "client", late: str = "1 hour") -> DataFrame:
    """R6 on a stream: requests of each session that a pause of window + 1 seconds ends."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", f"{window_s + 1} seconds").alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), key, "n")


def rollup_stream(requests: DataFrame, tool: Column, every: str, late: str = "1 hour") -> DataFrame:
    """R9 on a stream: hits, errors and times by tool and window; percentiles are approximate."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", every), tool.alias("tool"))
    return grouped.agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("status") >= 500).alias("errors"), F.percentile_approx("ms", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.max("ms").alias("max_ms")).select(F.col("window.start").alias("start"), "tool", "hits", "errors", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "max_ms")


def retain_batch(path: str, days: int, clock: Callable[[DataFrame], str], every_s: int = 300) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores a batch and, at most once in `every_s` seconds, removes day folders that have run out.

    `clock` gives the current time for a batch. Folders older than the day of the cutoff are removed, and so is that
    of rows without time. The time is noted in the folder's `_stamp`, beside the data, only when that has worked: a
    failed removal is tried again with the next batch, and a restarted query knows when the last one was. A replayed
    batch replaces its own folders, so its rows are stored once.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.withColumn("day", F.date_format("created_at", "yyyy-MM-dd")).withColumn("_batch", F.lit(number))
        kept.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "_batch").parquet(path)
        now, root = datetime.fromisoformat(clock(batch)), rewrite.Folder(spark, path)
        stamp = root / "_stamp"
        last = max((name for name in stamp.names() if name[:1] == "t"), default=None)
        if last and (now - datetime.strptime(last, "t%Y%m%d-%H%M%S.%f")).total_seconds() < every_s:
            return
        cutoff = str((now - timedelta(days=max(1, days))).date())
        for name in root.names():
            if name.startswith("day=") and (name[4:] < cutoff or name == "day=__HIVE_DEFAULT_PARTITION__"):
                (root / name).delete()
        fresh = stamp / now.strftime("t%Y%m%d-%H%M%S.%f")
        fresh.fs.mkdirs(fresh.path)
        for name in stamp.names():
            if name < fresh.text.rpartition("/")[2]:
                (stamp / name).delete()

    return run


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, as a table in memory: for tests and small replays."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that a stream has now, batch by batch through a foreachBatch function."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, written to Parquet exactly once, and read again."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
