"""Job log: last write wins, reclaim, throttle, redaction, orphans, content flags."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Fold, folded, keyed, unkeyed

FIELDS = ("status", "progress_permille", "error")
# Keys of a result that are public, prefixes of working folders, what an error without text reads.
PUBLIC_KEYS = ["pages", "tables", "text_blocks", "images", "lines", "warnings", "files", "batch", "engine", "bytes"]
PREFIXES = ["word2pdf_async_", "word2pdf_batch_async_", "pdf2word_async_", "pdf2word_batch_async_"]
NO_TEXT = "转换失败"


def current_jobs(updates: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The last value written of each field of a job, and its last update."""
    order = F.struct("ts", "seq")
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return updates.groupBy("job_id").agg(*last, F.max("ts").alias("updated_at"))


def reclaimable(jobs: DataFrame, now: str, kept_s: int = 30, stale_s: int = 3600) -> DataFrame:
    """Finished jobs downloaded some time ago or stale, and others without a recent update."""
    at = F.lit(now).cast("timestamp_ntz")
    stale = F.col("updated_at") < at - F.expr(f"INTERVAL {stale_s} SECONDS")
    fetched = F.coalesce(F.col("downloaded_at") <= at - F.expr(f"INTERVAL {kept_s} SECONDS"), F.lit(False))
    return jobs.filter(F.when(F.col("status").isin("done", "error"), fetched | stale).otherwise(stale))


class Throttle(Fold):
    """State is the progress and time of the last update that was kept (or nothing)."""

    def __init__(self, step: float, seconds: float):
        self.step, self.wait = step, math.ceil(seconds * 1_000_000)
        self.gap = self.wait - 1

    def start(self) -> list:
        return []

    def run(self, state: list, t: np.ndarray, progress: np.ndarray) -> tuple[list[np.ndarray], list]:
        kept, i = np.zeros(len(t), bool), 0
        if not state and len(t):
            kept[0], state, i = True, [float(progress[0]), int(t[0])], 1
        while i < len(t):
            end = max(i, int(np.searchsorted(t, state[1] + self.wait, "left")))
            width = 32
            while i < end:  # the first of a stretch that is far enough in progress
                far = np.flatnonzero(~(progress[i : min(end, i + width)] - state[0] < self.step))
                if len(far):
                    i += int(far[0])
                    break
                i, width = min(end, i + width), 2 * width
            if i < len(t):
                kept[i], state = True, [float(progress[i]), int(t[i])]
                i += 1
        return [kept], state


def throttle_progress(updates: DataFrame, step: float = 0.02, seconds: float = 1.0) -> DataFrame:
    """Updates that are kept: each differs enough from the last kept one, in progress or in time."""
    rows = updates.filter("progress is not null and job_id is not null")
    own = rows.select(keyed("job_id").alias("key"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("t"), F.col("seq").cast("long").alias("id"), F.col("progress").cast("double").alias("progress"))
    return folded(own, Throttle(step, seconds), ["progress"], "kept boolean").filter("kept").select(unkeyed("key").alias("job_id"), F.col("id").alias("seq"))


def public_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with has_result, and the public part of their results."""
    ready = (F.col("status") == "done") & F.coalesce(F.col("path") != "", F.lit(False)) & F.col("downloaded_at").isNull()
    shown = F.map_filter("result", lambda k, v: k.isin(PUBLIC_KEYS))
    return jobs.withColumns({"has_result": F.coalesce(ready, F.lit(False)), "result": shown})


def redact(text: Column) -> Column:
    """The first line of an error without file paths, 500 characters at most; empty for none."""
    edge = r"^[\s\x1c-\x1f\x85\u00a0\u2028\u2029]+|[\s\x1c-\x1f\x85\u00a0\u2028\u2029]+$"
    line = F.element_at(F.split(F.regexp_replace(text, edge, ""), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), 1)
    line = F.regexp_replace(F.regexp_replace(line, edge, ""), r"[A-Za-z]:\\[^\s\"']*", "…")
    line = F.regexp_replace(line, r"/[A-Za-z0-9_./-]+/", "…/")
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.substring(F.when(line == "", NO_TEXT).otherwise(line), 1, 500))


def error_groups(updates: DataFrame) -> DataFrame:
    """J5 as a job: how often each redacted error occurs."""
    return updates.filter("error is not null").groupBy(redact(F.col("error")).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("jobs"))


def orphans(entries: DataFrame, jobs: DataFrame, now: str, age_s: int = 600) -> DataFrame:
    """Files with a working prefix that no job refers to and that are old enough."""
    used = jobs.select(F.explode(F.array("input_path", "path")).alias("name")).filter("name is not null").distinct()
    known = F.col("name").rlike("^(" + "|".join(PREFIXES) + ")")
    return entries.filter(known & (F.col("mtime") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {age_s} SECONDS"))).join(used, "name", "left_anti")


def block_totals(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts of each kind of block by document."""
    return blocks.groupBy("doc_id").pivot("kind", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def content_warnings(totals: DataFrame, kinds: list[str]) -> DataFrame:
    """Flags of each document: empty, image_only, ocr_applied."""
    text = sum((F.col(k) for k in kinds if k not in ("image", "ocr")), F.lit(0))
    image = F.col("image") if "image" in kinds else F.lit(0)
    ocr = F.col("ocr") if "ocr" in kinds else F.lit(0)
    flags = F.array_compact(F.array(F.when((text == 0) & (image == 0), "empty"), F.when((text == 0) & (image > 0), "image_only"), F.when(ocr > 0, "ocr_applied")))
    return totals.withColumn("warnings", flags)
