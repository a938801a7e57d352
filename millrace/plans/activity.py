"""Registered queries of operators.activity, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import NOW, oracle, table
from ..operators import activity as a

COLUMNS = "id, tool, original_name, input_rel, input_bytes"
_CUT = f"created_at < TIMESTAMP '{NOW}' - INTERVAL '400' DAY"


def _r(spark, sf):
    return table(spark, sf, "records")


def _cut(df):
    return df.select("id", "tool", "original_name", "input_rel", "input_bytes")


def _picked(spark, sf):
    return _r(spark, sf).filter("input_bytes % 7 = 0").select(F.when(F.col("input_bytes") % 2 == 0, F.concat(F.lit("  "), "id")).otherwise(F.col("id")).alias("id"))


def _uploads(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch"), F.when(F.col("l_partkey") % 11 != 0, F.floor("l_extendedprice").cast("long")).alias("size"))


QUERIES = {
    "a1_recent": (lambda s, d: _cut(a.recent(_r(s, d), 60)), f"SELECT {COLUMNS} FROM $records ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 60"),
    "a2_search_recent": (lambda s, d: _cut(a.search_recent(_r(s, d), "1-URGENT", "9", 200)), f"SELECT {COLUMNS} FROM (SELECT * FROM $records ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 200) WHERE tool = '1-URGENT' AND (contains(lower(original_name), '9') OR contains(lower(id), '9'))"),
    "a3_tool_names": (lambda s, d: a.tool_names(_r(s, d)), "SELECT DISTINCT tool FROM $records WHERE tool <> ''"),
    "a4_number": (lambda s, d: a.number(a.retain(_r(s, d), NOW, 400)), f"SELECT count(*) AS n FROM $records WHERE NOT (created_at IS NULL OR {_CUT})"),
    "a5_storage_totals": (lambda s, d: a.storage_totals(_r(s, d)), "SELECT count(*) AS n, CAST(coalesce(sum(input_bytes), 0) AS BIGINT) AS input_bytes, CAST(coalesce(sum(input_bytes), 0) AS BIGINT) AS bytes_on_disk FROM $records"),
    "a6_by_tool": (lambda s, d: a.by_tool(_r(s, d)), "SELECT coalesce(nullif(tool, ''), 'unknown') AS tool, count(*) AS n FROM $records GROUP BY 1"),
    "a7_latest": (lambda s, d: _cut(a.latest(_r(s, d))), f"SELECT {COLUMNS} FROM $records WHERE created_at IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 1"),
    "a8_expired": (lambda s, d: _cut(a.expired(_r(s, d), NOW, 400)), f"SELECT {COLUMNS} FROM $records WHERE created_at IS NULL OR {_CUT}"),
    "a8_retain": (lambda s, d: _cut(a.retain(_r(s, d), NOW, 400)), f"SELECT {COLUMNS} FROM $records WHERE NOT (created_at IS NULL OR {_CUT})"),
    "a9_expired_days": (lambda s, d: a.expired_days(table(s, d, "files"), NOW, 400).select("day"), f"SELECT day FROM $files GROUP BY day HAVING day < strftime(TIMESTAMP '{NOW}' - INTERVAL '400' DAY, '%Y-%m-%d') AND max(mtime) < TIMESTAMP '{NOW}' - INTERVAL '400' DAY"),
    "a10_presence": (lambda s, d: a.presence(_r(s, d), table(s, d, "files")).select("id", "input_exists"), "SELECT id, input_rel <> '' AND input_rel IN (SELECT rel FROM $files) AS input_exists FROM $records"),
    "a11_presence_estimate": (
        lambda s, d: a.presence_estimate(_r(s, d), table(s, d, "files")),
        """WITH newest AS (SELECT * FROM $records WHERE input_rel <> '' ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 200),
        seen AS (SELECT count(*) AS sample, count(*) FILTER (WHERE input_rel IN (SELECT rel FROM $files)) AS present FROM newest),
        total AS (SELECT count(*) AS total FROM $records)
        SELECT total, sample, present, CASE WHEN total <= sample OR sample = 0 THEN present ELSE CAST(round_even(total * present / sample, 0) AS BIGINT) END AS estimate FROM total, seen""",
    ),
    "a12_get": (lambda s, d: _cut(a.get(_r(s, d), "7")), f"SELECT {COLUMNS} FROM $records WHERE id = '7'"),
    "a13_delete_ids": (lambda s, d: _cut(a.delete_ids(_r(s, d), _picked(s, d))), f"SELECT {COLUMNS} FROM $records WHERE input_bytes % 7 <> 0"),
    "a13_removed_ids": (lambda s, d: a.removed_ids(_r(s, d), _picked(s, d)), "SELECT count(*) AS removed FROM $records WHERE input_bytes % 7 = 0"),
    "a14_flatten_extras": (
        lambda s, d: a.flatten_extras(_r(s, d).withColumn("status", F.lit("base")), ["status", "cust", "absent"]).select("id", "status", "cust", "absent"),
        "SELECT id, json_extract_string(extra_json, '$.status') AS status, json_extract_string(extra_json, '$.cust') AS cust, CAST(NULL AS VARCHAR) AS absent FROM $records",
    ),
    "a15_safe_rel": (
        lambda s, d: _r(s, d).withColumn("rel", F.when(F.col("input_bytes") % 5 == 0, F.concat(F.lit("..\\"), "input_rel")).when(F.col("input_bytes") % 5 == 1, F.concat(F.lit("/"), "input_rel")).otherwise(F.col("input_rel"))).filter(a.safe_rel(F.col("rel"))).select("id", "rel"),
        "SELECT id, input_rel AS rel FROM $records WHERE input_bytes % 5 > 1 AND input_rel <> ''",
    ),
    "a16_sanitize_name": (
        lambda s, d: _r(s, d).select("id", a.sanitize_name(F.concat(F.lit("up/load\\ "), "tool", F.lit(" + "), "original_name")).alias("name")),
        "SELECT id, regexp_replace(regexp_replace(concat(' ', tool, ' + ', original_name), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+', '') AS name FROM $records",
    ),
    "a16_name_collisions": (
        lambda s, d: a.name_collisions(_r(s, d).withColumn("original_name", F.concat("tool", F.lit("!"), F.substring("original_name", 1, 8)))),
        "SELECT name, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(concat(tool, '!', substr(original_name, 1, 8)), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS name FROM $records) GROUP BY 1 HAVING count(*) > 1",
    ),
    "a17_dedupe_names": (
        lambda s, d: a.dedupe_names(_r(s, d).withColumn("n", F.col("id").cast("long")).withColumn("name", F.concat(F.when(F.col("n") % 2 == 0, "Scan").otherwise("scan"), (F.col("n") % 50).cast("string"), F.lit(".pdf"))), "tool", "name", "n").select("id", "unique_name"),
        """SELECT id, CASE WHEN k = 0 THEN name ELSE concat(stem, '_', CAST(k AS STRING), '.pdf') END AS unique_name FROM (
        SELECT id, name, stem, row_number() OVER (PARTITION BY tool, lower(name) ORDER BY n) - 1 AS k FROM (
        SELECT id, tool, CAST(id AS BIGINT) AS n, concat(CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'Scan' ELSE 'scan' END, CAST(CAST(id AS BIGINT) % 50 AS STRING)) AS stem, concat(stem, '.pdf') AS name FROM $records))""",
    ),
    "a18_batch_limits": (
        lambda s, d: a.batch_limits(_uploads(s, d), 90_000, 6, 250_000),
        """SELECT batch, files, total, largest, CASE WHEN files > 6 THEN 'too_many' WHEN largest > 90000 THEN 'file_too_large' WHEN total > 250000 THEN 'batch_too_large' ELSE 'ok' END AS verdict FROM (
        SELECT l_orderkey AS batch, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total, coalesce(max(size), 0) AS largest FROM (
        SELECT l_orderkey, CASE WHEN l_partkey % 11 <> 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS size FROM lineitem) GROUP BY 1)""",
    ),
    "a19_size_savings": (
        lambda s, d: a.size_savings(_r(s, d).select("tool", F.col("input_bytes").alias("original"), (F.col("input_bytes") * (F.col("id").cast("long") % 13) / 10).cast("long").alias("compressed"))),
        """SELECT tool, original, compressed, saved, CASE WHEN original = 0 THEN 0.0 ELSE round(1 - compressed / original, 4) END AS ratio FROM (
        SELECT tool, CAST(sum(o) AS BIGINT) AS original, CAST(sum(c) AS BIGINT) AS compressed, CAST(sum(greatest(0, o - c)) AS BIGINT) AS saved FROM (
        SELECT tool, input_bytes AS o, CAST(floor(input_bytes * (CAST(id AS BIGINT) % 13) / 10) AS BIGINT) AS c FROM $records) GROUP BY tool)""",
    ),
}
QUERIES = {k: (f, oracle(sql)) for k, (f, sql) in QUERIES.items()}
