"""Views over the driver's tables, in SQL that Spark and DuckDB read alike; `$name` stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "records": """
SELECT CAST(o_orderkey AS STRING) AS id,
 CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE o_orderpriority END AS tool,
 concat('Order_', CAST(o_orderkey AS STRING), CASE o_orderstatus WHEN 'F' THEN '.pdf' WHEN 'O' THEN '.docx' ELSE '.png' END) AS original_name,
 CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE o_orderdate END AS created_at,
 CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), '/', CAST(o_orderkey AS STRING)) END AS input_rel,
 CAST(floor(o_totalprice) AS BIGINT) AS input_bytes,
 concat('{"status":"', o_orderstatus, '","cust":', CAST(o_custkey AS STRING), '}') AS extra_json
FROM $orders""",
    "files": """
SELECT concat(CAST(CAST(o_orderdate AS DATE) AS STRING), '/', CAST(o_orderkey AS STRING)) AS rel,
 CAST(CAST(o_orderdate AS DATE) AS STRING) AS day,
 o_orderdate + (o_orderkey % 9) * INTERVAL '1' DAY AS mtime
FROM $orders WHERE o_orderkey % 17 <> 0""",
    "packages": """
SELECT CAST(o_orderkey AS STRING) AS id,
 lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') AS code,
 concat('parcel ', CAST(o_orderkey AS STRING), CASE o_orderstatus WHEN 'F' THEN '.txt' WHEN 'O' THEN '.pdf' ELSE '.png' END) AS original_name,
 CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 23 = 0 THEN '' ELSE concat('d/', CAST(o_orderkey AS STRING)) END AS stored_rel,
 CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
 o_orderdate AS created_at,
 CASE WHEN o_orderkey % 301 = 0 THEN NULL ELSE o_orderdate + (o_orderkey % 121) * INTERVAL '1' DAY END AS expires_at,
 CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_orderkey % 4 END AS max_downloads,
 CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS download_count,
 concat('cust ', CAST(o_custkey AS STRING)) AS note,
 CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS burn_after,
 CASE WHEN o_orderkey % 5 = 0 THEN concat('note for ', CAST(o_custkey AS STRING)) ELSE '' END AS text_payload
FROM $orders""",
    "claims": """
SELECT CASE WHEN l_partkey % 50 = 0 THEN 'abc' WHEN l_partkey % 53 = 0 THEN '999999'
   ELSE lpad(CAST(l_orderkey % 1000000 AS STRING), 6, '0') END AS code,
 l_shipdate AS ts,
 (l_orderkey * 8 + l_linenumber) * 4096 + (l_partkey * 31 + l_suppkey * 17 + day(l_shipdate)) % 4096 AS claim_id
FROM $lineitem""",
    "requests": """
SELECT event_id, CAST(user_id AS STRING) AS client, ts,
 CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
 CASE event_type WHEN 'click' THEN '/tools/html2md/convert' WHEN 'purchase' THEN '/tools/express/pickup'
  WHEN 'signup' THEN '/tools/json/format' WHEN 'view' THEN '/static/app.css' ELSE '/tools/regex/test?x=1' END AS path,
 CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
 CAST(floor(value) AS BIGINT) AS ms
FROM $events""",
    "access_log": """
SELECT concat('access method=', method, ' path=', path, ' status=', CAST(status AS STRING), ' ms=', CAST(ms AS STRING),
 '.0 request_id=', CASE WHEN event_id % 11 = 0 THEN '-' ELSE concat('r', CAST(event_id AS STRING)) END) AS line FROM $requests""",
    "job_updates": """
SELECT CAST(user_id AS STRING) AS job_id, event_id AS seq, ts,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'running' END AS status,
 CAST(floor(value) AS BIGINT) AS progress_permille,
 CASE WHEN event_type = 'error' THEN concat('open failed /var/tmp/jobs/', CAST(event_id % 7 AS STRING), '/out.pdf') ELSE NULL END AS error
FROM $events""",
    "tools": """
SELECT concat(replace(lower(p_name), ' ', '-'), '-', CAST(p_partkey AS STRING)) AS slug, p_name AS name, lower(p_type) AS category,
 p_size AS ord, p_partkey % 25 = 0 AS featured FROM $part""",
    "overrides": """
SELECT concat(replace(lower(p_name), ' ', '-'), '-', CAST(p_partkey AS STRING)) AS slug,
 CASE WHEN p_partkey % 20 = 0 THEN 'ghost' WHEN p_partkey % 30 = 0 THEN '' ELSE 'standard' END AS category FROM $part WHERE p_partkey % 10 = 0""",
    "categories": """
SELECT id, CAST(row_number() OVER (ORDER BY id) AS INT) AS pos FROM (SELECT DISTINCT lower(p_type) AS id FROM $part UNION SELECT 'video' AS id) x""",
    "disabled": """
SELECT concat(replace(lower(p_name), ' ', '-'), '-', CAST(p_partkey AS STRING)) AS slug FROM $part WHERE p_partkey % 9 = 0""",
    "mixed_ts": """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(1704067200 + event_id * 60 AS STRING) WHEN 1 THEN CAST((1704067200 + event_id * 60) * 1000 + 123 AS STRING)
 WHEN 2 THEN substr(CAST(ts AS STRING), 1, 19) WHEN 3 THEN replace(substr(CAST(ts AS STRING), 1, 16), '-', '/') ELSE concat('bad ', CAST(event_id AS STRING)) END AS raw FROM $events""",
    "money": """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat('￥', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.505') WHEN 1 THEN concat('1,', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '.5元')
 WHEN 2 THEN concat('-', CAST(o_orderkey AS STRING)) WHEN 3 THEN '1.2.3' WHEN 4 THEN '' ELSE concat('１２．', CAST(o_orderkey % 10 AS STRING)) END AS raw FROM $orders""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: The clock of views over orders, and of views over events.
NOW, NOW_EVENTS = "1999-06-01", "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a view over some."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\$(\w+)", VIEWS[name]))
    sql, made = VIEWS[name], []
    for other in sorted(used, key=len, reverse=True):
        view = f"millrace_{other}_{abs(hash(sf_dir))}"
        table(spark, sf_dir, other).createOrReplaceTempView(view)
        made.append(view)
        sql = sql.replace(f"${other}", view)
    out = spark.sql(sql)
    for view in made:
        spark.catalog.dropTempView(view)
    return out


def duck(name: str) -> str:
    """The view as a DuckDB subquery."""
    if name in BASE:
        return name
    return "(" + re.sub(r"\$(\w+)", lambda m: duck(m[1]) if m[1] not in BASE else m[1], VIEWS[name]) + ")"


def oracle(sql: str) -> str:
    """DuckDB SQL with each `$name` replaced by its view."""
    return re.sub(r"\$(\w+)", lambda m: duck(m[1]), sql)
