"""Folds and numbers over slices equal one pass in order, with a key that holds most rows, dense and sparse times, nulls and ties."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import activity, jobs, ordered, requests

START = 1_700_000_000


def _log(seed: int, dense: bool):
    """(client, seconds, id, ok, progress): half of the rows have one key; dense: no pause in it frees the state."""
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(3000):
        t += rng.choice([0, 1, 2]) if dense else rng.choice([0, 1, 3, 40, 200])
        rows.append((rng.choice(["hot"] * 5 + ["a", "b", None, "", "c"]), START + t, i, rng.random() < 0.2, rng.random()))
    return rows


def _frame(spark, rows):
    made = spark.createDataFrame(rows, "client string, s long, event_id long, ok boolean, progress double").repartition(6)
    return made.select("client", F.timestamp_seconds("s").alias("ts"), "event_id", "ok", "progress", F.col("client").alias("job_id"), F.col("event_id").alias("seq"))


def _by_key(rows):
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by[r[0]].append(r)
    return by


def _sliding(rows, limit, window):
    for key, own in _by_key(rows).items():
        live = []
        for _, t, i, *_ in own:
            live = [x for x in live if x >= t - window]
            full = len(live) >= limit
            yield key, i, not full, max(1, window - (t - live[0]) + 1) if full else 0, 0 if full else limit - len(live) - 1
            if not full:
                live.append(t)


def _lockouts(rows, limit, window, lock):
    for key, own in _by_key(rows).items():
        live, until = [], None
        for _, t, i, ok, _ in own:
            if until is not None and t < until:
                state = "locked"
            elif ok:
                live, until, state = [], None, "cleared"
            else:
                live = [x for x in live if x >= t - window] + [t]
                state = "tripped" if len(live) >= limit else "counted"
                if state == "tripped":
                    live, until = [], t + lock
            yield key, i, state


def _throttled(rows, step, seconds):
    for key, own in _by_key(rows).items():
        last = None
        for _, t, i, _, p in own:
            if key is not None and (last is None or not (p - last[0] < step and t - last[1] < seconds)):
                last = (p, t)
                yield key, i


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_folds(spark, seed, dense):
    rows = _log(seed, dense)
    frame = _frame(spark, rows)
    told = lambda got: sorted(map(tuple, got.collect()), key=str)
    assert told(requests.sliding_check(frame, 4, 60)) == sorted(_sliding(rows, 4, 60), key=str)
    assert told(requests.lockouts(frame, 3, 30, 50)) == sorted(_lockouts(rows, 3, 30, 50), key=str)
    assert told(jobs.throttle_progress(frame, 0.6, 30.0)) == sorted(_throttled(rows, 0.6, 30.0), key=str)


def test_a_hot_key_is_many_tasks(spark):
    frame = _frame(spark, _log(3, True))
    table = ordered.sliced(frame.select(ordered.keyed("client").alias("key"), F.unix_micros("ts").alias("t"), F.col("event_id").alias("id")), "key", ["t", "id"])
    hot = table.filter("key = '=hot'").groupBy("slice").count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 0.7 * sum(r["count"] for r in hot)
    for out in (requests.sliding_check(frame, 4, 60), requests.lockouts(frame, 3, 30, 50), jobs.throttle_progress(frame)):
        plan = out._jdf.queryExecution().toString()
        assert "rangepartitioning(slice" in plan and "hashpartitioning(key" not in plan


def test_no_rows(spark):
    empty = _frame(spark, []).filter("client = 'x'")
    assert requests.sliding_check(empty, 4, 60).count() == 0 and jobs.throttle_progress(empty).count() == 0
    assert activity.dedupe_names(empty.withColumn("name", F.lit("x")), "client", "name", "event_id").count() == 0


def test_numbered(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 7919) % 5000, i) for i in range(5000)]
    got = ordered.numbered(spark.createDataFrame(rows, "key string, o long, i long").repartition(7), "key", ["o", "i"]).collect()
    want = {}
    for key in {r[0] for r in rows}:
        want |= {r[2]: n for n, r in enumerate(sorted(x[1:] + (x[0],) for x in rows if x[0] == key), 1) for r in [(key, r[0], r[1])]}
    assert {r.i: r.n for r in got} == want and len(got) == len(rows)


def _unique(rows):
    taken, out = collections.defaultdict(set), {}
    for group, name, i in sorted(rows, key=lambda r: r[2]):
        found = name
        if name is not None:
            dot, n = name.rfind("."), 0
            stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
            while found.lower() in taken[group]:
                n += 1
                found = f"{stem}_{n}{ext}"
            taken[group].add(found.lower())
        out[i] = found
    return out


def test_dedupe_names(spark):
    rng = random.Random(6)
    names = ["scan.pdf", "Scan.PDF", "scan_1.pdf", "scan_2.pdf", "scan_1_1.pdf", "SCAN_01.pdf", "scan", "scan_1", ".env", ".env_1", "a.b_1", "a_1.b_1", "a.b", "a_3.b", "_1", "_", "x.", "x_1.", "", None, "7.txt", "_2.txt", "ÄÖ.txt", "äö.TXT"]
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["g", None, ""]), rng.choice(names), i) for i in range(1500)]
    rows += [("solo", "only.pdf", 2000 + i) for i in range(800)]
    got = activity.dedupe_names(spark.createDataFrame(rows, "g string, name string, i long").repartition(5), "g", "name", "i")
    assert {r.i: r.unique_name for r in got.collect()} == _unique(rows)
    assert got.columns == ["g", "name", "i", "unique_name"]
