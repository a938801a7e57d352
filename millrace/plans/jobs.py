"""Registered queries of operators.jobs, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, table
from ..operators import jobs as j


def _u(s, d):
    return table(s, d, "job_updates")


def _jobs(s, d):
    """Jobs with working paths and downloads, from the parcels."""
    p = table(s, d, "packages")
    n = F.col("size_bytes")
    return p.select(F.col("id").alias("job_id"), F.when(n % 3 == 0, "done").when(n % 3 == 1, "error").otherwise("running").alias("status"), F.when(n % 4 != 0, F.concat(F.lit("pdf2word_async_"), "id")).alias("path"), F.concat(F.lit("word2pdf_batch_async_"), "id").alias("input_path"), F.when(n % 5 == 0, F.col("created_at")).alias("downloaded_at"), F.col("created_at").alias("updated_at"), F.create_map(F.lit("pages"), F.col("max_downloads").cast("string"), F.lit("secret_path"), F.col("note"), F.lit("filename"), F.col("original_name"), F.lit("engine"), F.col("code")).alias("result"))


def _entries(s, d):
    p = table(s, d, "packages")
    kinds = F.array(*(F.struct(F.concat(F.lit(x), "id").alias("name"), F.col("created_at").alias("mtime")) for x in ("word2pdf_async_", "word2pdf_batch_async_", "pdf2word_async_", "pdf2word_batch_async_", "upload-")))
    return p.select(F.explode(kinds).alias("e")).select("e.name", "e.mtime")


def _blocks(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_quantity") < 15, "paragraph").when(F.col("l_quantity") < 30, "image").when(F.col("l_quantity") < 40, "table").otherwise("ocr").alias("kind"))


_THEN = "1998-06-01"
_JOBS = "(SELECT id AS job_id, CASE size_bytes % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'error' ELSE 'running' END AS status, CASE WHEN size_bytes % 4 <> 0 THEN concat('pdf2word_async_', id) END AS path, concat('word2pdf_batch_async_', id) AS input_path, CASE WHEN size_bytes % 5 = 0 THEN created_at END AS downloaded_at, created_at AS updated_at, max_downloads, original_name, code FROM $packages)"
KINDS = ["paragraph", "image", "table", "ocr"]
_LAST = ", ".join(f"arg_max({f}, ROW(ts, seq)) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in j.FIELDS)

QUERIES = {
    "j1_current_jobs": (lambda s, d: j.current_jobs(_u(s, d)).select("job_id", *j.FIELDS), f"SELECT job_id, {_LAST} FROM $job_updates GROUP BY 1"),
    "j2_reclaimable": (
        lambda s, d: j.reclaimable(_jobs(s, d), _THEN, 86_400 * 100, 86_400 * 60).select("job_id"),
        f"SELECT job_id FROM {_JOBS} WHERE updated_at < TIMESTAMP '{_THEN}' - INTERVAL 60 DAY OR status <> 'running' AND downloaded_at <= TIMESTAMP '{_THEN}' - INTERVAL 100 DAY",
    ),
    "j3_throttle_progress": (
        lambda s, d: j.throttle_progress(_u(s, d).withColumn("progress", F.col("progress_permille") / 1000), 0.2, 6 * 3600.0),
        """WITH RECURSIVE q AS (SELECT job_id, seq, epoch_us(ts) AS t, progress_permille / 1000 AS p, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS n FROM $job_updates WHERE progress_permille IS NOT NULL),
        s(job_id, n, seq, p, t, kept) AS (SELECT job_id, n, seq, p, t, true FROM q WHERE n = 1
        UNION ALL SELECT q.job_id, q.n, q.seq, CASE WHEN q.p - s.p < 0.2 AND q.t - s.t < 21600000000 THEN s.p ELSE q.p END, CASE WHEN q.p - s.p < 0.2 AND q.t - s.t < 21600000000 THEN s.t ELSE q.t END, NOT (q.p - s.p < 0.2 AND q.t - s.t < 21600000000)
        FROM s JOIN q ON q.job_id = s.job_id AND q.n = s.n + 1) SELECT job_id, seq FROM s WHERE kept""",
    ),
    "j4_public_jobs": (
        lambda s, d: j.public_jobs(_jobs(s, d)).select("job_id", "has_result", F.size("result").alias("n"), F.col("result.pages").alias("pages"), F.col("result.engine").alias("engine"), F.col("result.filename").alias("filename"), F.col("result.secret_path").alias("secret")),
        f"SELECT job_id, status = 'done' AND path IS NOT NULL AND downloaded_at IS NULL AS has_result, 2 AS n, CAST(max_downloads AS VARCHAR) AS pages, code AS engine, CAST(NULL AS VARCHAR) AS filename, CAST(NULL AS VARCHAR) AS secret FROM {_JOBS}",
    ),
    "j5_error_groups": (lambda s, d: j.error_groups(_u(s, d)), "SELECT regexp_replace(error, '(/[A-Za-z0-9_.-]+)+/', '…/', 'g') AS error, count(*) AS n, count(DISTINCT job_id) AS jobs FROM $job_updates WHERE error IS NOT NULL GROUP BY 1"),
    "j6_orphans": (
        lambda s, d: j.orphans(_entries(s, d), _jobs(s, d), _THEN).select("name"),
        f"SELECT name FROM (SELECT concat(x, id) AS name, created_at AS mtime FROM $packages, (SELECT unnest(['word2pdf_async_', 'word2pdf_batch_async_', 'pdf2word_async_', 'pdf2word_batch_async_', 'upload-']) AS x)) WHERE NOT name LIKE 'upload-%' AND mtime < TIMESTAMP '{_THEN}' - INTERVAL 600 SECOND AND name NOT IN (SELECT path FROM {_JOBS} WHERE path IS NOT NULL UNION ALL SELECT input_path FROM {_JOBS})",
    ),
    "j7_block_totals": (
        lambda s, d: j.content_warnings(j.block_totals(_blocks(s, d), KINDS), KINDS).withColumn("warnings", F.array_join("warnings", ",")),
        """SELECT doc_id, paragraph, image, "table", ocr, concat_ws(',', CASE WHEN paragraph + "table" = 0 AND image = 0 THEN 'empty' END, CASE WHEN paragraph + "table" = 0 AND image > 0 THEN 'image_only' END, CASE WHEN ocr > 0 THEN 'ocr_applied' END) AS warnings FROM (
        SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_quantity < 15) AS paragraph, count(*) FILTER (WHERE l_quantity >= 15 AND l_quantity < 30) AS image, count(*) FILTER (WHERE l_quantity >= 30 AND l_quantity < 40) AS "table", count(*) FILTER (WHERE l_quantity >= 40) AS ocr FROM lineitem GROUP BY 1)""",
    ),
}
QUERIES = {k: (f, sql and oracle(sql)) for k, (f, sql) in QUERIES.items()}
