"""Upload activity: recent lists, totals, retention, presence and names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .ordered import keyed, numbered


def recent(records: DataFrame, limit: int = 50) -> DataFrame:
    """A1: the newest rows, from 1 to 200 of them; ties go to the greater id. A row without time is the oldest."""
    return records.orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")).limit(max(1, min(limit, 200)))


def search_recent(records: DataFrame, tool: str = "", q: str = "", limit: int = 50) -> DataFrame:
    """A2: of the newest `limit` rows those of one tool, and those whose name or id contains `q` in any case."""
    found = recent(records, limit)
    if tool:
        found = found.filter(F.col("tool") == tool)
    if q:
        found = found.filter(F.lower("original_name").contains(q.lower()) | F.lower("id").contains(q.lower()))
    return found


def tool_names(records: DataFrame) -> DataFrame:
    """A3: distinct tools that aren't empty, ascending."""
    return records.filter("tool <> ''").select("tool").distinct().orderBy("tool")


def number(records: DataFrame) -> DataFrame:
    """A4: rows."""
    return records.agg(F.count(F.lit(1)).alias("n"))


def storage_totals(records: DataFrame) -> DataFrame:
    """A5: rows and bytes."""
    total = F.coalesce(F.sum("input_bytes"), F.lit(0))
    return records.agg(F.count(F.lit(1)).alias("n"), total.alias("input_bytes"), total.alias("bytes_on_disk"))


def by_tool(records: DataFrame) -> DataFrame:
    """Rows of each tool; an empty one counts as `unknown`, together with a tool of that name."""
    return records.groupBy(F.coalesce(F.nullif("tool", F.lit("")), F.lit("unknown")).alias("tool")).agg(F.count(F.lit(1)).alias("n"))


def latest(records: DataFrame) -> DataFrame:
    """The newest row; none of an empty table."""
    best = F.max_by(F.struct("*"), F.struct(F.col("created_at"), F.col("id"))).alias("r")
    return records.agg(best).filter("r is not null").select("r.*")


def _expired(now: str, days: int) -> Column:
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {max(1, days)} DAYS")
    return F.col("created_at").isNull() | (F.col("created_at") < cutoff)


def expired(records: DataFrame, now: str, days: int) -> DataFrame:
    """Rows older than `days` (one at least), and those without time."""
    return records.filter(_expired(now, days))


def retain(records: DataFrame, now: str, days: int) -> DataFrame:
    """The others."""
    return records.filter(~_expired(now, days))


def expired_days(files: DataFrame, now: str, days: int) -> DataFrame:
    """Day folders before the day of the cutoff whose newest file is older than the cutoff."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {max(1, days)} DAYS")
    newest = files.groupBy("day").agg(F.max("mtime").alias("newest"))
    return newest.filter((F.col("day") < F.date_format(cutoff, "yyyy-MM-dd")) & (F.col("newest").isNull() | (F.col("newest") < cutoff)))


def presence(records: DataFrame, files: DataFrame) -> DataFrame:
    """A10: each record with input_exists."""
    there = files.select(F.col("rel").alias("_rel")).distinct()
    joined = records.join(there, (F.col("input_rel") == F.col("_rel")) & (F.col("input_rel") != ""), "left")
    return joined.withColumn("input_exists", F.col("_rel").isNotNull()).drop("_rel")


def presence_estimate(records: DataFrame, files: DataFrame, sample: int = 200) -> DataFrame:
    """Files present among the newest `sample` rows with a path, carried over to all rows (half to even)."""
    newest = records.filter("input_rel <> ''").orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")).limit(sample)
    seen = presence(newest, files).agg(F.count(F.lit(1)).alias("sample"), F.count_if("input_exists").alias("present"))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    whole = (F.col("total") <= F.col("sample")) | (F.col("sample") == 0)
    estimate = F.when(whole, F.col("present")).otherwise(F.bround(F.col("total") * F.col("present") / F.col("sample")).cast("long"))
    return total.join(seen, F.lit(True)).select("total", "sample", "present", estimate.alias("estimate"))


def get(records: DataFrame, key: str) -> DataFrame:
    """The row of an id; none for an empty one."""
    return records.filter((F.col("id") == key) & (F.lit(key) != ""))


def _wanted(ids: DataFrame) -> DataFrame:
    return ids.select(F.trim("id").alias("id")).filter("id <> ''").distinct()


def delete_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that stay when the listed ids (trimmed, blank ones ignored) are deleted."""
    return records.join(_wanted(ids), "id", "left_anti")


def removed_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """How many rows that deletes."""
    return records.join(_wanted(ids), "id", "left_semi").agg(F.count(F.lit(1)).alias("removed"))


def flatten_extras(records: DataFrame, extras: list[str]) -> DataFrame:
    """Entries of the JSON side column as columns, in place of base columns of the same name; bad JSON has none."""
    found = F.from_json("extra_json", "map<string,string>", {"mode": "PERMISSIVE"})
    out = records.withColumn("_extra", F.coalesce(found, F.create_map().cast("map<string,string>")))
    for name in extras:
        value = F.element_at("_extra", name)
        out = out.withColumn(name, F.coalesce(value, F.col(name).cast("string")) if name in records.columns else value)
    return out.drop("_extra")


def safe_rel(rel: Column) -> Column:
    """Whether a relative path stays under its root: not empty, not absolute, no `..` part."""
    plain = F.regexp_replace(rel, r"\\", "/")
    return (plain != "") & ~plain.startswith("/") & ~F.exists(F.split(plain, "/"), lambda part: part == "..")


def sanitize_name(name: Column, stem: int = 80, ext: int = 12) -> Column:
    """A file name of word characters, CJK, dots and hyphens, its parts cut; reserved names get `_` in front."""
    base = F.element_at(F.split(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "/"), -1)
    clean = F.regexp_replace(base, r"(?U)[^\w一-鿿.\-]+", "_")
    clean = F.regexp_replace(clean, r"^[._]+|[._]+$", "")
    suffix = F.regexp_extract(clean, r"(?s)^.+(\.[^.]*)$", 1)
    body = F.substr(clean, F.lit(1), F.length(clean) - F.length(suffix))
    body = F.when(F.upper(body).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), body)).otherwise(body)
    body = F.when(body == "", F.lit("file")).otherwise(body)
    return F.concat(F.substr(body, F.lit(1), F.lit(stem)), F.substr(suffix, F.lit(1), F.lit(ext)))


def name_collisions(records: DataFrame) -> DataFrame:
    """A16 as a job: clean names that more than one record gets."""
    return records.groupBy(sanitize_name(F.col("original_name")).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _mixed(batches):
    """`unique_name` of families (in order) whose names differ. State is one family's distinct names and numbers, not its rows."""
    own, kept, tried = None, set(), {}

    def taken(low: str) -> bool:
        dot = low.rfind(".")
        stem, ext = (low[:dot], low[dot:]) if dot > 0 else (low, "")
        base, _, number = stem.rpartition("_")
        return low in kept or number.isascii() and number.isdigit() and number[0] != "0" and int(number) <= tried.get(base + ext, 0)

    for batch in batches:
        out = []
        for family, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if family != own:
                own, kept, tried = family, set(), {}
            found, low = wanted, wanted.lower()
            if taken(low):
                dot = wanted.rfind(".")
                stem, ext = (wanted[:dot], wanted[dot:]) if dot > 0 else (wanted, "")
                n = tried.get(low, 0) + 1
                while taken(f"{stem}_{n}{ext}".lower()):
                    n += 1
                tried[low], found = n, f"{stem}_{n}{ext}"
            else:
                kept.add(low)
            out.append(found)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.string())], names=[*batch.schema.names[2:], "unique_name"])


def dedupe_names(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """`unique_name`: a name that the group has before, in any case, gets the first free of `_1`, `_2`, ... before its extension.

    Only names of one family can meet: those of a group that are alike without `_<number>` ends and in their
    extension. A family of one name is numbered by many tasks, whatever its size. One of several names is read in order
    by one task, which holds its distinct names. A null name stays null.
    """
    low = F.lower(F.col(name))
    ext = F.regexp_extract(low, r"(?s)^.+(\.[^.]*)$", 1)
    root = F.regexp_replace(F.substr(low, F.lit(1), F.length(low) - F.length(ext)), r"(_[0-9]+)+$", "")
    fields, extended = rows.columns, StructType([*rows.schema.fields, StructField("unique_name", StringType())])
    own = rows.filter(F.col(name).isNotNull()).withColumn("_family", F.concat_ws("\0", keyed(group), root, ext))
    several = own.select("_family", low.alias("_low")).distinct().groupBy("_family").agg(F.count(F.lit(1)).alias("_names")).filter("_names > 1").select("_family")
    stem = F.regexp_extract(F.col(name), r"(?s)^(.+)\.[^.]*$", 1)
    stem = F.when(stem == "", F.col(name)).otherwise(stem)
    n = F.col("_n") - 1
    unique = F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), F.substr(F.col(name), F.length(stem) + 1)))
    alone = numbered(own.join(several, "_family", "left_anti").select("_family", *fields), "_family", [order], "_n").select(*fields, unique.alias("unique_name"))
    mixed = own.join(several, "_family", "left_semi").select("_family", F.col(name).alias("_name"), *fields).repartition("_family").sortWithinPartitions("_family", order).mapInArrow(_mixed, extended)
    return alone.unionByName(mixed).unionByName(rows.filter(F.col(name).isNull()).withColumn("unique_name", F.lit(None).cast("string")))


def batch_limits(uploads: DataFrame, max_file: int, max_files: int, max_batch: int) -> DataFrame:
    """Verdict of each batch; unknown sizes count as nothing."""
    sums = uploads.groupBy("batch").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))
    verdict = F.when(F.col("files") > max_files, "too_many").when(F.col("largest") > max_file, "file_too_large").when(F.col("total") > max_batch, "batch_too_large").otherwise("ok")
    return sums.withColumn("verdict", verdict)


def size_savings(sizes: DataFrame) -> DataFrame:
    """Bytes saved by tool, with the share of the original."""
    each = sizes.withColumn("saved", F.greatest(F.lit(0), F.col("original") - F.col("compressed")))
    sums = each.groupBy("tool").agg(F.sum("original").alias("original"), F.sum("compressed").alias("compressed"), F.sum("saved").alias("saved"))
    ratio = F.when(F.col("original") == 0, 0.0).otherwise(F.round(1 - F.col("compressed") / F.col("original"), 4))
    return sums.withColumn("ratio", ratio)


