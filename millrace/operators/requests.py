"""Requests: scopes, rate limits in batch, lockouts, log roll-ups."""

from __future__ import annotations

import re
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Fold, folded, keyed, unkeyed

# Markers of limited paths, prefixes of noisy ones.
MARKERS = ["/convert-async", "/convert-batch-async", "/convert-batch", "/convert", "/compress", "/send", "/pickup", "/lookup", "/regex/test", "/regex/replace"]
NOISY = ["/static/", "/health", "/sw.js", "/manifest.webmanifest", "/favicon"]


def _any(path: Column, parts: list[str]) -> Column:
    return path.rlike("(" + "|".join(re.escape(p) for p in parts) + ")")


def limited_scope(method: Column, path: Column) -> Column:
    """Whether a request counts against the limit: posts to limited paths, and what is fetched from them."""
    bare = F.regexp_replace(path, r"[?#].*$", "")
    download = bare.rlike("/download/*$")
    limited = _any(bare, MARKERS) | bare.startswith("/api/jobs") & download
    return limited & ((method == "POST") | (method == "GET") & (download | bare.contains("/pickup")))


def _micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _judged(rows: DataFrame, fold: Fold, order: str, result: str, key: str, *extra: Column) -> DataFrame:
    """Rows folded by key and time, as (key, `order`, verdicts). A row without time counts as one at the epoch."""
    own = rows.select(keyed(key).alias("key"), F.coalesce(_micros(), F.lit(0)).alias("t"), F.col(order).cast("long").alias("id"), *extra)
    out = folded(own, fold, own.columns[3:], result)
    return out.select(unkeyed("key").alias("key"), F.col("id").alias(order), *out.columns[2:])


class Sliding(Fold):
    """R2: state is the accepted times within the window, at most `limit`; denied rows are passed over by search."""

    def __init__(self, limit: int, window_s: int):
        self.limit, self.gap = limit, window_s * 1_000_000

    def start(self) -> list:
        return []

    def run(self, state: list, t: np.ndarray) -> tuple[list[np.ndarray], list]:
        live, i = deque(state), 0
        allowed, retry, remaining = np.ones(len(t), bool), np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        while i < len(t):
            while live and live[0] < t[i] - self.gap:
                live.popleft()
            if len(live) < self.limit:
                live.append(int(t[i]))
                remaining[i] = self.limit - len(live)
                i += 1
            else:
                j = int(np.searchsorted(t, live[0] + self.gap, "right"))
                allowed[i:j] = False
                retry[i:j] = np.maximum(1, (self.gap - (t[i:j] - live[0])) // 1_000_000 + 1)
                i = j
        return [allowed, retry, remaining], list(live)


def sliding_check(requests: DataFrame, limit: int, window_s: int, key: str = "client", order: str = "event_id") -> DataFrame:
    """R2: verdict of each request; a denied one is not recorded and so doesn't count later."""
    if limit <= 0:
        return requests.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias(order), F.lit(True).alias("allowed"), F.lit(0).cast("long").alias("retry_after"), F.lit(-1).cast("long").alias("remaining"))
    return _judged(requests, Sliding(limit, window_s), order, "allowed boolean, retry_after long, remaining long", key)


def sliding_record(requests: DataFrame, limit: int, window_s: int, key: str = "client") -> DataFrame:
    """Every request is recorded; `exceeded` from the limit-th within the closed window on."""
    within = Window.partitionBy(key).orderBy("_us").rangeBetween(-window_s * 1_000_000, 0)
    return requests.withColumn("_us", _micros()).withColumn("hits", F.count(F.lit(1)).over(within)).withColumn("exceeded", F.col("hits") >= limit).drop("_us")


class Lockout(Fold):
    """State is the end of a lock (or null) and the recent failures; locked rows are passed over by search."""

    def __init__(self, limit: int, window_s: int, lock_s: int):
        self.limit, self.window, self.lock = limit, window_s * 1_000_000, lock_s * 1_000_000
        self.gap = max(self.window, self.lock)

    def start(self) -> list:
        return [None]

    def run(self, state: list, t: np.ndarray, ok: np.ndarray) -> tuple[list[np.ndarray], list]:
        until, live, i = state[0], deque(state[1:]), 0
        out = np.full(len(t), "locked", object)
        while i < len(t):
            if until is not None and t[i] < until:
                i = int(np.searchsorted(t, until, "left"))
                continue
            if ok[i]:
                live.clear()
                until, out[i] = None, "cleared"
            else:
                while live and live[0] < t[i] - self.window:
                    live.popleft()
                live.append(int(t[i]))
                out[i] = "counted" if len(live) < self.limit else "tripped"
                if len(live) >= self.limit:
                    live.clear()
                    until = int(t[i]) + self.lock
            i += 1
        return [out], [until, *live]


def lockouts(attempts: DataFrame, limit: int = 8, window_s: int = 600, lock_s: int = 900, key: str = "client", order: str = "event_id") -> DataFrame:
    """State of each attempt (ok boolean): locked, tripped (this failure locks), counted, or cleared by a success.

    While a key is locked nothing is counted.
    """
    return _judged(attempts, Lockout(limit, window_s, lock_s), order, "state string", key, F.coalesce("ok", F.lit(False)).alias("ok"))


def fixed_window(requests: DataFrame, limit: int, window_s: int, key: str = "client", order: str = "event_id") -> DataFrame:
    """Number of each request in its bucket of `window_s`, whether it is allowed, seconds to the bucket's end."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    bucket = F.floor(t / window_s).cast("long")
    out = requests.withColumn("bucket", bucket)
    nth = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("ts", order))
    return out.withColumns({"nth": nth, "allowed": nth <= limit, "retry_after": F.when(nth <= limit, 0).otherwise((F.col("bucket") + 1) * window_s - t).cast("long")})


def idle_gap_counter(requests: DataFrame, limit: int, window_s: int, key: str = "client", order: str = "event_id") -> DataFrame:
    """A counter that only a pause of window + 1 seconds resets: session, number in it, and whether it is allowed."""
    by = Window.partitionBy(key).orderBy("ts", order)
    gap = _micros() - F.lag(_micros()).over(by)
    fresh = F.coalesce((gap >= (window_s + 1) * 1_000_000).cast("int"), F.lit(1))
    out = requests.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
    nth = F.row_number().over(Window.partitionBy(key, "session").orderBy("ts", order))
    return out.withColumns({"nth": nth, "allowed": nth <= limit})


def idle_sweep(requests: DataFrame, now: str, idle_s: int = 3600, key: str = "client") -> DataFrame:
    """Keys without a request in the last `idle_s` seconds."""
    last = requests.groupBy(key).agg(F.max("ts").alias("last"))
    return last.filter(F.col("last") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {idle_s} SECONDS")).select(key)


def log_level(path: Column, status: Column) -> Column:
    """Level of an access line."""
    return F.when(status >= 500, "ERROR").when(path.rlike("^(" + "|".join(re.escape(p) for p in NOISY) + ")"), "DEBUG").otherwise("INFO")


def log_rollup(requests: DataFrame, tool: Column, every: str) -> DataFrame:
    """Hits, errors and times by tool and tumbling window; percentiles are exact."""
    grouped = requests.groupBy(F.window(F.col("ts").cast("timestamp"), every).start.alias("start"), tool.alias("tool"))
    return grouped.agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("status") >= 500).alias("errors"), F.percentile("ms", F.lit(0.5)).alias("p50"), F.percentile("ms", F.lit(0.95)).alias("p95"), F.max("ms").alias("max_ms"))


def deny_summary(verdicts: DataFrame, key: str = "client") -> DataFrame:
    """By key: requests, denied ones, when first and last, and the most in one bucket."""
    buckets = verdicts.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("allowed")).alias("denied"), F.min(F.when(~F.col("allowed"), F.col("event_id"))).alias("first"), F.max(F.when(~F.col("allowed"), F.col("event_id"))).alias("last"))
    return buckets.groupBy(key).agg(F.sum("n").alias("total"), F.sum("denied").alias("denied"), F.min("first").alias("first_denied"), F.max("last").alias("last_denied"), F.max("n").alias("max_burst"))
