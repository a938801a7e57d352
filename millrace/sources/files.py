"""Files in and out: access logs, binary inventories, archive listings, legacy JSON, day archives, sitemaps, event streams (IO1 to IO8)."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..session import written

# Leading bytes (in hex) of image types, and types by extension.
MAGIC = [("jpeg", "^FFD8FF"), ("png", "^89504E470D0A1A0A"), ("gif", "^474946383[79]61"), ("webp", "^52494646.{8}57454250"), ("bmp", "^424D"), ("tiff", "^(49492A00|4D4D002A)"), ("ico", "^0000(01|02)00")]
EXTENSIONS = {"jpg": "jpeg", "jpeg": "jpeg", "jpe": "jpeg", "jfif": "jpeg", "png": "png", "gif": "gif", "webp": "webp", "bmp": "bmp", "tif": "tiff", "tiff": "tiff", "ico": "ico", "cur": "ico"}
#: Limits of an archive: members, bytes of a member and of all, ratio that is suspect from some size on.
MEMBERS, MEMBER_BYTES, ALL_BYTES, RATIO, RATIO_BYTES = 5000, 200 << 20, 500 << 20, 100, 10 << 20


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """IO1: a stored table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def imported(texts: DataFrame, target: DataFrame, fields: list[str]) -> DataFrame:
    """IO2: rows of JSON arrays (a text `value` each) that the target lacks; unknown keys go to extra_json. Items that are no objects are skipped.

    Nothing is imported into a target that has rows. Of rows with one id the least in order stays.
    """
    if not target.isEmpty():
        return target.limit(0)
    item = F.explode(F.from_json("value", "array<string>")).alias("item")
    row = texts.select(item).select("item", F.from_json("item", "map<string,string>").alias("m")).filter("m is not null and trim(item) like '{%'")
    known = {f: F.coalesce(F.element_at("m", f), F.lit("")) for f in fields}
    extra = F.to_json(F.map_filter("m", lambda k, v: ~k.isin(fields)))
    rows = row.select(*(c.alias(f) for f, c in known.items()), extra.alias("extra_json")).filter("id <> ''")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(*fields, "extra_json"))
    return rows.withColumn("_n", nth).filter("_n = 1").drop("_n")


def import_legacy_json(spark: SparkSession, path: str, target: DataFrame, fields: list[str]) -> DataFrame:
    """IO2: `imported` from files that hold one JSON array each, read whole."""
    return imported(spark.read.text(path, wholetext=True), target, fields)


def archive_sink(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """IO3: append rows under one folder for each UTC day."""
    df.withColumn("day", F.date_format(F.col(ts), "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def parse_access_log(lines: DataFrame) -> DataFrame:
    """IO4: method, path, status, ms and request_id (`-` is none) of access lines; other lines are dropped. Batch or stream."""
    def field(name: str) -> Column:
        return F.regexp_extract("value", rf"(?:^|\s){name}=(\S*)", 1)

    found = lines.filter(F.col("value").rlike(r"(^|\s)access method="))
    return found.select(field("method").alias("method"), field("path").alias("path"), field("status").try_cast("int").alias("status"), field("ms").try_cast("double").alias("ms"), F.nullif(F.nullif(field("request_id"), F.lit("-")), F.lit("")).alias("request_id"))


def read_access_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """IO4: access lines of text files."""
    return parse_access_log((spark.readStream if stream else spark.read).text(path))


def classify(content: Column, path: Column) -> Column:
    """IO5: type by leading bytes, `svg` if rejected as such, else by extension, else unsupported."""
    head = F.hex(F.substring(content, 1, 16))
    by_magic = None
    for kind, pattern in MAGIC:
        by_magic = F.when(head.rlike(pattern), kind) if by_magic is None else by_magic.when(head.rlike(pattern), kind)
    svg = F.substring(content, 1, 4096).cast("string").rlike(r"(?is)^\s*(?:<\?xml\b[^>]*>\s*)?(?:<!--.*?-->\s*)*<svg\b")
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(by_magic, F.when(svg | ext.isin("svg", "svgz"), "svg"), F.element_at(known, ext), F.lit("unsupported"))


def file_inventory(files: DataFrame) -> DataFrame:
    """IO5: files and bytes by type, from (path, content) as the binaryFile source reads them."""
    return files.select(classify(F.col("content"), F.col("path")).alias("kind"), F.length("content").alias("bytes")).groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def _listing(content: bytes | None) -> list[tuple]:
    """(pos, name, is_dir, size, compressed, error) of a ZIP archive's members; a broken one has a single row with an error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            return [(i, m.filename, m.is_dir(), m.file_size, m.compress_size, None) for i, m in enumerate(archive.infolist())]
    except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError) as e:
        return [(None, None, None, None, None, type(e).__name__)]


def _members(batches):
    """Members of each ZIP archive of (path, content)."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
    names = ["path", "pos", "name", "is_dir", "size", "compressed", "error"]
    for batch in batches:
        rows = [(path, *row) for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in _listing(content)]
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def archive_member_inventory(files: DataFrame) -> DataFrame:
    """IO6: members of ZIP archives with a flag for each that is unsafe; nothing is unpacked."""
    listed = files.select("path", "content").mapInArrow(_members, "path string, pos long, name string, is_dir boolean, size long, compressed long, error string")
    so_far = F.sum("size").over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    plain = F.regexp_replace("name", r"\\", "/")
    slip = plain.startswith("/") | plain.rlike(r"(^|/)\.\.(/|$)")
    flag = F.when(F.col("error").isNotNull(), "broken").when(slip, "path").when(F.col("size") > MEMBER_BYTES, "member_size").when(F.col("total") > ALL_BYTES, "total_size").when((F.col("size") > RATIO_BYTES) & (F.col("size") > RATIO * F.greatest(F.lit(1), F.col("compressed"))), "ratio").when(F.col("pos") >= MEMBERS, "members").otherwise("ok")
    return listed.withColumn("total", so_far).withColumn("flag", flag)


def xml_escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def sitemap_entries(urls: DataFrame, shard_rows: int = 50_000) -> DataFrame:
    """IO7: one <url> entry for each row (url, lastmod), home pages first; with `shard`, the file it belongs to, and its number.

    Files hold exactly `shard_rows` rows, the last one the rest: numbers are exact, and made without one task that sees all rows.
    """
    home = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/x")).isin("", "/")
    lastmod = F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc>"), xml_escape(F.col("url")), F.lit("</loc>"), lastmod, F.lit("<changefreq>"), F.when(home, "daily").otherwise("weekly"), F.lit("</changefreq><priority>"), F.format_string("%.1f", F.when(home, 1.0).otherwise(0.8)), F.lit("</priority></url>"))
    rows = urls.filter("url is not null").select(F.lit("sitemap").alias("file"), (~home).alias("rank"), "url", entry.alias("entry"))
    shard = F.floor((F.col("number") - 1) / shard_rows).cast("long")
    return numbered(rows, "file", ["rank", "url", "entry"], "number").select("url", "entry", shard.alias("shard"), "number")


def sitemap_sink(urls: DataFrame, path: str, base: str, shard_rows: int = 50_000) -> None:
    """IO7: text files `shard=<n>/...` under path/urls, each with its head and foot, and path/index that lists them.

    A file is one task's work, `shard_rows` lines.
    """
    found = written(sitemap_entries(urls, shard_rows))
    shards = found.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    edge = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("number"), F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">').alias("value")), F.struct(F.lit(1 << 62).alias("number"), F.lit("</urlset>").alias("value"))))
    lines = found.select("shard", "number", F.col("entry").alias("value")).unionByName(shards.select("shard", edge.alias("e")).select("shard", "e.number", "e.value"))
    lines.repartition("shard").sortWithinPartitions("shard", "number").select("shard", "value").write.partitionBy("shard").text(f"{path}/urls")
    listed = shards.select(F.col("shard").alias("n"), F.concat(F.lit("<sitemap><loc>"), xml_escape(F.lit(base.rstrip("/"))), F.lit("/urls/shard="), F.col("shard").cast("string"), F.lit("</loc></sitemap>")).alias("value"))
    head, foot = ('<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', -1), ("</sitemapindex>", 1 << 62)
    ends = found.sparkSession.createDataFrame([head, foot], "value string, n long").select("n", "value")
    listed.unionByName(ends).repartition(1).sortWithinPartitions("n").select("value").write.text(f"{path}/index")


class _Members:
    """IO6 as a table function: the members of ZIP archives (path, content), a partition a path, each with its flag."""

    def __init__(self):
        self.total = 0

    def eval(self, row):
        for pos, name, is_dir, size, compressed, error in _listing(row["content"]):
            self.total += size or 0
            plain = (name or "").replace("\\", "/")
            if error:
                flag = "broken"
            elif plain.startswith("/") or ".." in plain.split("/"):
                flag = "path"
            elif size > MEMBER_BYTES:
                flag = "member_size"
            elif self.total > ALL_BYTES:
                flag = "total_size"
            elif size > RATIO_BYTES and size > RATIO * max(1, compressed):
                flag = "ratio"
            else:
                flag = "members" if pos >= MEMBERS else "ok"
            yield row["path"], pos, name, is_dir, size, compressed, error, self.total, flag


class _Ranges:
    """T26 as a table function: the numbers of specs (id, total, spec), a partition an id, in order and each once; or one row with an error."""

    def __init__(self, strict: bool):
        self.strict = strict

    def eval(self, row):
        seen: dict[int, None] = {}
        for part in re.sub(r"\s+", "", row["spec"] or "").split(","):
            found = re.fullmatch(r"([0-9]+)(?:-([0-9]+))?", part)
            low, high = (int(found[1]), int(found[2] or found[1])) if found else (1, 0)
            if low > high or max(low, high) >= 1 << 31 or self.strict and (low < 1 or high > row["total"]):
                yield row["id"], None, None, "bad_range"
                return
            seen |= dict.fromkeys(range(max(low, 1), min(high, row["total"]) + 1))
        if not seen:
            yield row["id"], None, None, "bad_range"
        for i, n in enumerate(seen, 1):
            yield row["id"], i, n, None


class _StrictRanges(_Ranges):
    def __init__(self):
        super().__init__(True)


class _LenientRanges(_Ranges):
    def __init__(self):
        super().__init__(False)


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL: archive_members, ranges_strict and ranges_lenient, each over TABLE(...) PARTITION BY its key.

    `SELECT * FROM archive_members(TABLE(files) PARTITION BY path)`.
    """
    members = "path string, pos long, name string, is_dir boolean, size long, compressed long, error string, total long, flag string"
    ranges = "id long, ord int, n int, error string"
    for name, function, shape in (("archive_members", _Members, members), ("ranges_strict", _StrictRanges, ranges), ("ranges_lenient", _LenientRanges, ranges)):
        spark.udtf.register(name, F.udtf(function, returnType=shape))


def event_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int | None = None) -> DataFrame:
    """IO8: files of events as a stream; `path` is a folder or a glob.

    All files that are there form one micro-batch, so a replay is right whatever the order of time among
    them; `files_a_batch` bounds it for files that come in order of time.
    """
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)
