"""Registered queries of operators.requests and of the access log, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, table
from ..operators import requests as r
from ..operators.catalog import tool_from_path
from ..sources.files import parse_access_log

DAY = 86_400


def _q(s, d):
    return table(s, d, "requests")


#: Requests, each with other paths beside its own.
_MORE = "concat('/api/jobs/', client, '/download/'), concat(replace(path, '?x=1', ''), '/download'), '/tools/x/download', '/sw.js', '/healthz', '/manifest.webmanifest', '/tools/express/lookup'"
_PATHS = f"(SELECT method, status, unnest([path, {_MORE}]) AS path FROM $requests)"


def _paths(s, d):
    return _q(s, d).selectExpr("method", "status", f"explode(array(path, {_MORE})) AS path")


_TOOL = "CASE regexp_extract(path, '^/tools/([^/?#]+)', 1) WHEN '' THEN NULL WHEN 'json' THEN 'code-format' ELSE regexp_extract(path, '^/tools/([^/?#]+)', 1) END"
_FIXED = f"(SELECT event_id, client, CAST(floor(epoch(ts)) AS BIGINT) // {DAY} AS bucket, row_number() OVER (PARTITION BY client, CAST(floor(epoch(ts)) AS BIGINT) // {DAY} ORDER BY ts, event_id) AS nth, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM $requests)"

QUERIES = {
    "io4_access_log": (
        lambda s, d: parse_access_log(table(s, d, "access_log").withColumnRenamed("line", "value")).groupBy("method", "path", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"), F.count("request_id").alias("with_id")),
        "SELECT method, path, status, count(*) AS n, CAST(sum(ms) AS DOUBLE) AS ms, count(*) FILTER (WHERE event_id % 11 <> 0) AS with_id FROM $requests GROUP BY 1, 2, 3",
    ),
    "r1_limited_scope": (
        lambda s, d: _paths(s, d).groupBy("method", "path", r.limited_scope(F.col("method"), F.col("path")).alias("limited")).agg(F.count(F.lit(1)).alias("n")),
        f"""SELECT method, path, (path LIKE '%/convert%' OR path LIKE '%/compress%' OR path LIKE '%/send%' OR path LIKE '%/pickup%' OR path LIKE '%/lookup%' OR path LIKE '%/regex/test%' OR path LIKE '%/regex/replace%' OR path LIKE '/api/jobs%' AND rtrim(path, '/') LIKE '%/download')
        AND (method = 'POST' OR method = 'GET' AND (rtrim(path, '/') LIKE '%/download' OR path LIKE '%/pickup%')) AS limited, count(*) AS n FROM {_PATHS} GROUP BY 1, 2, 3""",
    ),
    "r2_sliding_check": (
        lambda s, d: r.sliding_check(_q(s, d), 3, DAY),
        f"""WITH RECURSIVE q AS (SELECT client, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS n FROM $requests),
        s(client, n, event_id, live, allowed, retry_after, remaining) AS (
        SELECT client, n, event_id, [t], true, 0::BIGINT, 2::BIGINT FROM q WHERE n = 1
        UNION ALL SELECT q.client, q.n, q.event_id, CASE WHEN len(l) >= 3 THEN l ELSE list_append(l, q.t) END, len(l) < 3, CASE WHEN len(l) >= 3 THEN greatest(1, ({DAY}000000 - (q.t - l[1])) // 1000000 + 1) ELSE 0 END, CASE WHEN len(l) >= 3 THEN 0 ELSE 2 - len(l) END
        FROM (SELECT s.client, s.n, list_filter(s.live, lambda x: x >= q2.t - {DAY}000000) AS l FROM s JOIN q q2 ON q2.client = s.client AND q2.n = s.n + 1) p JOIN q ON q.client = p.client AND q.n = p.n + 1)
        SELECT client AS key, event_id, allowed, retry_after, remaining FROM s""",
    ),
    "r3_sliding_record": (
        lambda s, d: r.sliding_record(_q(s, d), 3, DAY).select("event_id", "hits", "exceeded"),
        "SELECT event_id, count(*) OVER w AS hits, count(*) OVER w >= 3 AS exceeded FROM $requests WINDOW w AS (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)",
    ),
    "r4_lockouts": (
        lambda s, d: r.lockouts(_q(s, d).withColumn("ok", F.col("method") == "GET"), 3, 2 * DAY, 3 * DAY),
        f"""WITH RECURSIVE q AS (SELECT client, event_id, epoch_us(ts) AS t, method = 'GET' AS ok, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS n FROM $requests),
        s(client, n, event_id, live, until, state) AS (
        SELECT client, n, event_id, CASE WHEN ok THEN [] ELSE [t] END, NULL::BIGINT, CASE WHEN ok THEN 'cleared' ELSE 'counted' END FROM q WHERE n = 1
        UNION ALL SELECT client, n, event_id, CASE state WHEN 'locked' THEN live WHEN 'counted' THEN l ELSE [] END, CASE state WHEN 'tripped' THEN t + {3 * DAY}000000 WHEN 'cleared' THEN NULL ELSE until END, state FROM (
        SELECT q.client, q.n, q.event_id, q.t, s.live, s.until, list_append(list_filter(s.live, lambda x: x >= q.t - {2 * DAY}000000), q.t) AS l,
         CASE WHEN coalesce(q.t < s.until, false) THEN 'locked' WHEN q.ok THEN 'cleared' WHEN len(list_filter(s.live, lambda x: x >= q.t - {2 * DAY}000000)) + 1 >= 3 THEN 'tripped' ELSE 'counted' END AS state
        FROM s JOIN q ON q.client = s.client AND q.n = s.n + 1))
        SELECT client AS key, event_id, state FROM s""",
    ),
    "r5_fixed_window": (lambda s, d: r.fixed_window(_q(s, d), 2, DAY).select("event_id", "bucket", "nth", "allowed", "retry_after"), f"SELECT event_id, bucket, nth, nth <= 2 AS allowed, CASE WHEN nth <= 2 THEN 0 ELSE (bucket + 1) * {DAY} - t END AS retry_after FROM {_FIXED}"),
    "r6_idle_gap_counter": (
        lambda s, d: r.idle_gap_counter(_q(s, d), 2, 6 * 3600).select("event_id", "session", "nth", "allowed"),
        """SELECT event_id, session, nth, nth <= 2 AS allowed FROM (SELECT event_id, session, row_number() OVER (PARTITION BY client, session ORDER BY ts, event_id) AS nth FROM (
        SELECT *, CAST(sum(fresh) OVER (PARTITION BY client ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
        SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY client ORDER BY ts, event_id) < 21601000000 THEN 0 ELSE 1 END AS fresh FROM $requests)))""",
    ),
    "r7_idle_sweep": (lambda s, d: r.idle_sweep(_q(s, d), "2024-01-30", 6 * 3600), "SELECT client FROM $requests GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30' - INTERVAL 6 HOUR"),
    "r8_log_level": (lambda s, d: _paths(s, d).groupBy(r.log_level(F.col("path"), F.col("status")).alias("level")).agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE WHEN status >= 500 THEN 'ERROR' WHEN path LIKE '/static/%' OR path LIKE '/health%' OR path LIKE '/sw.js%' OR path LIKE '/manifest.webmanifest%' OR path LIKE '/favicon%' THEN 'DEBUG' ELSE 'INFO' END AS level, count(*) AS n FROM {_PATHS} GROUP BY 1"),
    "r9_log_rollup": (
        lambda s, d: r.log_rollup(_q(s, d), tool_from_path(F.col("path")), "1 day").withColumn("start", F.date_format("start", "yyyy-MM-dd")),
        f"SELECT strftime(ts, '%Y-%m-%d') AS start, {_TOOL} AS tool, count(*) AS hits, count(*) FILTER (WHERE status >= 500) AS errors, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, max(ms) AS max_ms FROM $requests GROUP BY 1, 2",
    ),
    "r12_deny_summary": (
        lambda s, d: r.deny_summary(r.fixed_window(_q(s, d), 2, DAY)),
        f"SELECT client, CAST(sum(n) AS BIGINT) AS total, CAST(sum(denied) AS BIGINT) AS denied, min(first) AS first_denied, max(last) AS last_denied, max(n) AS max_burst FROM (SELECT client, bucket, count(*) AS n, count(*) FILTER (WHERE nth > 2) AS denied, min(event_id) FILTER (WHERE nth > 2) AS first, max(event_id) FILTER (WHERE nth > 2) AS last FROM {_FIXED} GROUP BY 1, 2) GROUP BY 1",
    ),
}
QUERIES = {k: (f, sql and oracle(sql)) for k, (f, sql) in QUERIES.items()}
