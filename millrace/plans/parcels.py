"""Registered queries of operators.parcels, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, table
from ..operators import parcels as p

#: A clock at which some parcels still live.
THEN = "1998-03-01"
_VIEW = f"""SELECT *, coalesce(expires_at <= TIMESTAMP '{THEN}', true) AS expired,
 CASE WHEN expires_at IS NOT NULL THEN greatest(0, CAST(epoch(expires_at) - epoch(TIMESTAMP '{THEN}') AS BIGINT)) END AS seconds_remaining,
 max_downloads > 0 AND download_count >= max_downloads AS exhausted,
 CASE WHEN max_downloads > 0 THEN greatest(0, max_downloads - download_count) END AS downloads_left,
 text_payload <> '' AS is_text, substr(text_payload, 1, 100) AS preview, text_payload <> '' OR stored_rel <> '' AS file_exists,
 NOT coalesce(expires_at <= TIMESTAMP '{THEN}', true) AND NOT (max_downloads > 0 AND download_count >= max_downloads) AS available FROM $packages"""
_SHOWN = ["id", "expired", "seconds_remaining", "exhausted", "downloads_left", "is_text", "preview", "file_exists", "available"]
_STATUS = {"available": "available AND file_exists", "expired": "expired", "exhausted": "exhausted AND NOT expired", "missing": "NOT file_exists"}


_TYPE = "CASE size_bytes % 9 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/heic' WHEN 2 THEN 'application/pdf' ELSE '' END"
_NAME = "CASE size_bytes % 5 WHEN 0 THEN concat(original_name, '.svg') WHEN 1 THEN concat(original_name, '.bin') WHEN 2 THEN 'README' ELSE original_name END"


def _p(s, d):
    return table(s, d, "packages")


def _settled(kind: str) -> str:
    """Claims in DuckDB: good ones are numbered within their code."""
    has = "text_payload <> ''" if kind == "text" else "text_payload = '' AND stored_rel <> ''"
    return f"""SELECT claim_id, code, ts, CASE WHEN cap IS NULL THEN 'invalid' WHEN coalesce(expires_at <= ts, true) THEN 'expired'
 WHEN cap > 0 AND download_count + least(before, greatest(0, cap - download_count)) >= cap THEN 'exhausted' WHEN NOT has THEN 'missing' ELSE 'ok' END AS outcome FROM (
 SELECT *, coalesce(sum(CAST(good AS INT)) OVER (PARTITION BY code ORDER BY ts, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
 SELECT x.claim_id, x.code, x.ts, k.expires_at, k.cap, k.download_count, k.has,
  coalesce(k.expires_at > x.ts AND NOT (k.cap > 0 AND k.download_count >= k.cap) AND k.has, false) AS good
 FROM $claims x LEFT JOIN (SELECT code, expires_at, CASE WHEN burn_after = 1 THEN 1 ELSE max_downloads END AS cap, download_count, {has} AS has FROM $packages) k
 ON x.code = k.code AND regexp_matches(x.code, '^[0-9]{{6}}$')))"""


def _raw(s, d):
    return _p(s, d).select("id", "created_at", ((F.col("size_bytes") % 400) - 40).cast("int").alias("ttl_hours"), (F.col("max_downloads") * 700 - 500).alias("max_downloads"), F.concat(F.lit("  "), F.repeat("note", 30)).alias("note"), (F.col("size_bytes") % 140).cast("int").alias("file_count"), F.concat(F.lit(" "), F.when(F.col("size_bytes") % 3 == 0, F.repeat("text_payload", 500)).otherwise(F.col("text_payload"))).alias("text_payload"), (F.col("size_bytes") % 4 == 0).alias("is_text"), F.when(F.col("size_bytes") % 6 > 0, F.repeat(F.concat(F.lit("text/x-"), "id", F.lit("; ")), F.col("size_bytes").cast("int") % 30)).alias("content_type"), "burn_after", (F.col("size_bytes") - 5000).alias("size_bytes"))


def _evolve(s, d):
    return p.evolve(_p(s, d).select("id", F.when(F.col("size_bytes") % 2 == 0, F.col("note")).alias("note"))).select("id", "note", "max_downloads", "file_count", "content_type")


def _codes(s, d):
    """P9's draw: every row has one code, no code twice, none that was used."""
    drawn = p.assign_codes(_p(s, d).filter("size_bytes % 3 = 0").select("id"), _p(s, d).select("code"))
    used = _p(s, d).select("code", F.lit(True).alias("used")).distinct()
    return drawn.join(used, "code", "left").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("distinct_codes"), F.count_distinct("id").alias("distinct_ids"), F.count("used").alias("used"), F.count_if(F.col("code").rlike("^[0-9]{6,}$")).alias("well_formed"))


QUERIES = {
    "p1_package_view": (lambda s, d: p.package_view(_p(s, d), THEN).select(*_SHOWN), f"SELECT {', '.join(_SHOWN)} FROM ({_VIEW})"),
    **{f"p2_status_{k}": (lambda s, d, k=k: p.status_filter(p.package_view(_p(s, d), THEN), k).select("id"), f"SELECT id FROM ({_VIEW}) WHERE {v}") for k, v in _STATUS.items()},
    "p3_list_packages": (
        lambda s, d: p.list_packages(_p(s, d), THEN, 60, "5", "exhausted").select("id", "code"),
        f"SELECT id, code FROM (SELECT * FROM ({_VIEW}) ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 300) WHERE contains(lower(concat_ws(chr(10), code, original_name, note, id)), '5') AND exhausted AND NOT expired ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 60",
    ),
    "p4_content_kind": (
        lambda s, d: p.content_kind(_p(s, d).withColumn("content_type", F.expr(_TYPE)).withColumn("original_name", F.expr(_NAME))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        f"""SELECT CASE WHEN text_payload <> '' THEN NULL WHEN name LIKE '%.png' OR type LIKE 'image/%' THEN 'image' WHEN name LIKE '%.pdf' OR type = 'application/pdf' THEN 'pdf'
        WHEN name LIKE '%.txt' OR name LIKE '%.svg' OR type LIKE 'text/%' THEN 'text' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT text_payload, {_TYPE} AS type, {_NAME} AS name FROM $packages) GROUP BY 1""",
    ),
    "p5_package_stats": (lambda s, d: p.package_stats(_p(s, d)), "SELECT count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes FROM $packages"),
    "p6_purge_expired": (lambda s, d: p.purge_expired(_p(s, d), THEN).select("id"), f"SELECT id FROM $packages WHERE expires_at > TIMESTAMP '{THEN}'"),
    "p7_valid_code": (
        lambda s, d: table(s, d, "claims").select("claim_id", p.valid_code(F.concat(F.lit(" "), F.substring("code", 1, 3), F.lit("\t"), F.substring("code", 4, 3))).alias("code")),
        "SELECT claim_id, CASE WHEN regexp_matches(code, '^[0-9]{6}$') THEN code END AS code FROM $claims",
    ),
    "p8_normalise_package": (
        lambda s, d: p.normalise_package(_raw(s, d), 300_000).select("id", "ttl_hours", "max_downloads", "note", "content_type", "file_count", "size_bytes", "reject", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires")),
        """SELECT id, ttl AS ttl_hours, CASE WHEN burn_after > 0 THEN 1 ELSE least(1000, greatest(0, max_downloads * 700 - 500)) END AS max_downloads,
        substr(trim(concat('  ', repeat(note, 30))), 1, 200) AS note, CASE WHEN size_bytes % 6 > 0 THEN substr(repeat(concat('text/x-', id, '; '), size_bytes % 30), 1, 120) ELSE '' END AS content_type, least(100, greatest(1, size_bytes % 140)) AS file_count, size AS size_bytes,
        CASE WHEN is_text AND t = '' THEN 'empty_text' WHEN is_text AND length(t) > 5000 THEN 'text_too_long' WHEN size <= 0 THEN 'empty_file' WHEN size > 300000 THEN 'file_too_large' END AS reject,
        strftime(created_at + ttl * INTERVAL '1' HOUR, '%Y-%m-%d %H:%M:%S') AS expires FROM (
        SELECT *, least(168, greatest(1, size_bytes % 400 - 40)) AS ttl, size_bytes % 4 = 0 AS is_text,
        trim(CASE WHEN size_bytes % 3 = 0 THEN repeat(text_payload, 500) ELSE text_payload END) AS t, CASE WHEN size_bytes % 4 = 0 THEN strlen(t) ELSE size_bytes - 5000 END AS size FROM $packages)""",
    ),
    "p9_assign_codes": (lambda s, d: p.assign_codes(_p(s, d).filter("size_bytes % 3 = 0").select("id"), _p(s, d).select("code")), None),
    "p9_code_audit": (_codes, "SELECT count(*) AS n, count(*) AS distinct_codes, count(*) AS distinct_ids, 0 AS used, count(*) AS well_formed FROM $packages WHERE size_bytes % 3 = 0"),
    "p10_settle_claims": (lambda s, d: p.settle_claims(_p(s, d), table(s, d, "claims")).select("claim_id", "code", "outcome"), f"SELECT claim_id, code, outcome FROM ({_settled('file')})"),
    "p10_settle_text_claims": (lambda s, d: p.settle_claims(_p(s, d), table(s, d, "claims"), "text").select("claim_id", "code", "outcome"), f"SELECT claim_id, code, outcome FROM ({_settled('text')})"),
    "p11_lookup": (
        lambda s, d: p.lookup(_p(s, d), table(s, d, "claims").select("code").distinct(), THEN),
        f"""SELECT c.code, CASE WHEN expired IS NULL THEN 404 WHEN expired OR exhausted THEN 410 ELSE 200 END AS status,
        CASE WHEN expired IS NULL THEN 'invalid' WHEN expired THEN 'expired' WHEN exhausted THEN 'exhausted' ELSE 'ok' END AS reason,
        CASE WHEN status = 200 THEN original_name END AS original_name, CASE WHEN status = 200 THEN size_bytes END AS size_bytes, CASE WHEN status = 200 THEN downloads_left END AS downloads_left
        FROM (SELECT DISTINCT code FROM $claims) c LEFT JOIN ({_VIEW}) v ON c.code = v.code""",
    ),
    "p12_apply_claims": (
        lambda s, d: p.apply_used(_p(s, d), p.used_up(_p(s, d), table(s, d, "claims"))).select("id", "download_count", "stored_rel"),
        f"""SELECT id, download_count + coalesce(used, 0) AS download_count, CASE WHEN burn_after = 1 AND used > 0 THEN '' ELSE stored_rel END AS stored_rel
        FROM $packages LEFT JOIN (SELECT code, count(*) AS used FROM ({_settled('file')}) WHERE outcome = 'ok' GROUP BY 1) USING (code)""",
    ),
    "p13_evolve": (_evolve, "SELECT id, CASE WHEN size_bytes % 2 = 0 THEN note ELSE '' END AS note, 0 AS max_downloads, 1 AS file_count, '' AS content_type FROM $packages"),
}
QUERIES = {k: (f, sql and oracle(sql)) for k, (f, sql) in QUERIES.items()}
