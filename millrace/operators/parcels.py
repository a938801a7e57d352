"""Parcel ledger: derived views, status filters, capped claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("available", "expired", "exhausted", "missing")
# Extensions of the content kinds.
IMAGES = ["png", "jpg", "jpeg", "gif", "webp", "bmp"]
TEXTS = [
    "txt", "text", "md", "markdown", "rst",
    "c", "h", "cc", "cpp", "hpp", "cxx", "hh",
    "py", "pyw", "js", "jsx", "mjs", "ts", "tsx",
    "json", "csv", "tsv", "xml", "yaml", "yml", "toml", "ini",
    "cfg", "conf", "properties", "env", "sql", "log",
    "css", "scss", "less", "html", "htm", "svg",
    "sh", "bash", "zsh", "bat", "cmd", "ps1", "fish",
    "go", "rs", "java", "rb", "php", "lua", "r", "m", "pl",
    "swift", "kt", "kts", "scala", "dart", "vue", "svelte",
    "diff", "patch",
]
DEFAULTS = {"max_downloads": 0, "download_count": 0, "file_count": 1, "burn_after": 0, "note": "", "text_payload": "", "content_type": ""}


def package_view(packages: DataFrame, now: str) -> DataFrame:
    """Derived columns. A parcel without readable expiry is expired, its remaining time unknown."""
    at = F.lit(now).cast("timestamp_ntz")
    seconds = F.unix_timestamp(F.col("expires_at").cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    capped = F.col("max_downloads") > 0
    return packages.withColumns(
        {
            "expired": F.coalesce(F.col("expires_at") <= at, F.lit(True)),
            "seconds_remaining": F.when(F.col("expires_at").isNotNull(), F.greatest(F.lit(0), seconds)),
            "exhausted": capped & (F.col("download_count") >= F.col("max_downloads")),
            "downloads_left": F.when(capped, F.greatest(F.lit(0), F.col("max_downloads") - F.col("download_count"))),
            "is_text": F.col("text_payload") != "",
            "preview": F.substring("text_payload", 1, 100),
            "file_exists": (F.col("text_payload") != "") | (F.col("stored_rel") != ""),
        }
    ).withColumn("available", ~F.col("expired") & ~F.col("exhausted"))


def status_filter(view: DataFrame, status: str) -> DataFrame:
    """Parcels of a status; one that isn't known filters nothing."""
    tests = {"available": F.col("available") & F.col("file_exists"), "expired": F.col("expired"), "exhausted": F.col("exhausted") & ~F.col("expired"), "missing": ~F.col("file_exists")}
    return view.filter(tests[status]) if status in tests else view


def list_packages(packages: DataFrame, now: str, limit: int = 50, q: str = "", status: str = "") -> DataFrame:
    """The newest parcels, filtered within a bounded window of the newest."""
    limit = max(1, min(limit, 500))
    newest = [F.col("created_at").desc_nulls_last(), F.desc("id")]
    filtered = bool(q) or status in STATUSES
    view = package_view(packages.orderBy(*newest).limit(min(500, max(5 * limit, 200)) if filtered else limit), now)
    if q:
        view = view.filter(F.lower(F.concat_ws("\n", "code", "original_name", "note", "id")).contains(q.lower()))
    return status_filter(view, status).orderBy(*newest).limit(limit)


def content_kind(packages: DataFrame) -> DataFrame:
    """Image, pdf, text or other by extension or, where there is one, by content_type; null for text parcels."""
    ext = F.lower(F.regexp_extract("original_name", r"[^/\\]\.([^./\\]+)$", 1))
    given = F.lower(F.coalesce(F.col("content_type") if "content_type" in packages.columns else F.lit(""), F.lit("")))
    kind = F.when(F.col("text_payload") != "", None).when(ext.isin(IMAGES) | given.startswith("image/"), "image").when((ext == "pdf") | (given == "application/pdf"), "pdf").when(ext.isin(TEXTS) | given.startswith("text/"), "text").otherwise("other")
    return packages.withColumn("kind", kind)


def package_stats(packages: DataFrame) -> DataFrame:
    """P5: parcels and bytes."""
    return packages.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


def purge_expired(packages: DataFrame, now: str) -> DataFrame:
    """Parcels that a purge leaves; those without expiry go."""
    return packages.filter(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))


def valid_code(code: Column) -> Column:
    """The code without white space if it is six digits 0 to 9, else null."""
    plain = F.regexp_replace(code, r"(?U)\s+", "")
    return F.when(plain.rlike("^[0-9]{6}$"), plain)


def normalise_package(raw: DataFrame, max_size: int) -> DataFrame:
    """Cleaned parcels with `reject` (null if accepted): bounded times, caps, notes, counts and sizes."""
    text = F.trim(F.coalesce("text_payload", F.lit("")))
    burn = F.coalesce(F.col("burn_after"), F.lit(0)) > 0
    out = raw.withColumns(
        {
            "ttl_hours": F.least(F.lit(168), F.greatest(F.lit(1), F.coalesce("ttl_hours", F.lit(24)))),
            "max_downloads": F.when(burn, 1).otherwise(F.least(F.lit(1000), F.greatest(F.lit(0), F.coalesce("max_downloads", F.lit(0))))),
            "note": F.substring(F.trim(F.coalesce("note", F.lit(""))), 1, 200),
            "content_type": F.substring(F.coalesce("content_type", F.lit("")) if "content_type" in raw.columns else F.lit(""), 1, 120),
            "file_count": F.least(F.lit(100), F.greatest(F.lit(1), F.coalesce("file_count", F.lit(1)))),
            "text_payload": text,
            "size_bytes": F.when(F.col("is_text"), F.octet_length(text)).otherwise(F.col("size_bytes")),
        }
    )
    out = out.withColumn("expires_at", F.expr("created_at + make_dt_interval(0, ttl_hours)"))
    reject = F.when(F.col("is_text") & (F.col("text_payload") == ""), "empty_text").when(F.col("is_text") & (F.length("text_payload") > 5000), "text_too_long").when(F.coalesce(F.col("size_bytes"), F.lit(0)) <= 0, "empty_file").when(F.col("size_bytes") > max_size, "file_too_large")
    return out.withColumn("reject", reject)


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with `n` from 1 on, by counts of hash slices of a key, so that no task orders all of them."""
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(64)))
    before = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    numbered = sliced.withColumn("_k", F.row_number().over(Window.partitionBy("_slice").orderBy(key))).join(F.broadcast(before), "_slice")
    return numbered.withColumn("n", F.col("_k") + F.col("_before")).drop("_k", "_before", "_slice")


def assign_codes(new: DataFrame, used: DataFrame, seed: int = 7, space: int | None = None) -> DataFrame:
    """An unused code for each new row, in seeded order: six digits, and where these run out seven, then more.

    A `space` is a hard limit: an error if too few are left in it. The six-digit space is bounded, so numbering it
    in one partition is; rows and longer codes are numbered by counts of hash slices. Of longer codes only as many
    are tried as are needed and could be in use.
    """
    spark, taken = new.sparkSession, used.select("code").distinct()
    free = spark.range(space or 1_000_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("code")).join(taken, "code", "left_anti")
    codes = free.withColumn("n", F.row_number().over(Window.orderBy(F.xxhash64("code", F.lit(seed)), "code")).cast("long"))
    need, have, digits = new.count(), free.count(), 6
    while need > have:
        digits += 1
        if space or digits > 9:
            raise ValueError("the code space is used up")
        size = 10**digits
        own = taken.filter(F.length("code") == digits)
        # id -> id * step + seed runs through the whole space: step and size have no common factor
        step = next(i for i in range(size * 618 // 1000, size) if i % 2 and i % 5)
        tried = spark.range(min(size, need - have + own.count())).select(F.lpad(((F.col("id") * step + seed) % size).cast("string"), digits, "0").alias("code"))
        longer = tried.join(own, "code", "left_anti")
        codes = codes.unionByName(_numbered(longer, "code").withColumn("n", F.col("n") + have))
        have += longer.count()
    return _numbered(new, "id").join(codes, "n").drop("n")


def by_code(packages: DataFrame, kind: str = "file") -> DataFrame:
    """A row for each six-digit code `c`: its `parcels` in order of their ids, the most downloads that one has left (null
    if none is capped), the ends of those a claim can count against (`goods`, the last one is `until`) and of those
    without a cap (`open`), and the last end of all (`last`).
    """
    cap = F.when(F.col("burn_after") == 1, 1).otherwise(F.col("max_downloads"))
    has = (F.col("text_payload") != "") if kind == "text" else (F.col("text_payload") == "") & (F.col("stored_rel") != "")
    full = (cap > 0) & (F.col("download_count") >= cap)
    known = packages.filter(F.col("code").rlike("^[0-9]{6}$")).select(
        F.col("code").alias("c"),
        (F.col("id") if "id" in packages.columns else F.lit("")).alias("parcel"),
        F.col("expires_at").alias("ends"),
        F.when(cap > 0, F.when(full, 0).otherwise(cap - F.col("download_count"))).cast("long").alias("left"),
        F.coalesce(~full & has, F.lit(False)).alias("good"),
        F.when(cap.isNotNull(), F.coalesce(~has, F.lit(False))).alias("missing"),
    )
    ends = F.col("ends")
    found = known.groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("parcel", "ends", "left", "good", "missing"))).alias("parcels"),
        F.max(F.when(F.col("left") > 0, F.col("left"))).alias("most"),
        F.collect_list(F.when(F.col("good"), ends)).alias("goods"),
        F.max(F.when(F.col("good"), ends)).alias("until"),
        F.collect_list(F.when(F.col("left").isNull() & ~F.col("missing"), ends)).alias("open"),
        F.max("ends").alias("last"),
    )
    return found.withColumn("parcels", F.transform("parcels", lambda p: p.dropFields("parcel")))


def later(ends: str, at: Column) -> Column:
    """How many of the ends are after a time; 0 for none."""
    return F.when(F.col(ends).isNotNull(), F.array_size(F.filter(ends, lambda end: end > at))).otherwise(0)


def good_claims(packages: DataFrame, claims: DataFrame, kind: str = "file") -> DataFrame:
    """(c, n): how often claims of a code are good, a claim once for each parcel, whatever is left of these."""
    each = claims.withColumn("c", valid_code(F.col("code"))).join(by_code(packages, kind), "c")
    return each.groupBy("c").agg(F.sum(later("goods", F.col("ts"))).cast("long").alias("n")).filter("n > 0")


def _outcome(p: Column, at: Column, used: Column) -> Column:
    """What a claim gets of a parcel (null: there is none) whose code has had so many good ones."""
    spent = p["left"] <= used
    return F.when(p["missing"].isNull(), "invalid").when(F.coalesce(p["ends"] <= at, F.lit(True)), "expired").when(spent, "exhausted").when(p["missing"], "missing").otherwise("ok")


def with_others(claims: DataFrame, at: Column) -> DataFrame:
    """Claims with `before`, and `others`: for each parcel of the code how many good ones of the same claim precede it.
    Null where that decides nothing: the most downloads are used up before the claim, or none is good."""
    n = lambda p, k: F.array_size(F.filter(F.slice("parcels", 1, k), lambda q: q["good"] & (q["ends"] > at)))
    return claims.withColumn("others", F.when((F.col("before") < F.col("most")) & (F.col("until") > at), F.transform("parcels", n)))


def outcomes(claims: DataFrame, at: Column, *columns: str | Column) -> DataFrame:
    """A row for each claim and parcel of its code: the columns and `outcome`."""
    told = with_others(claims, at).select("*", F.posexplode_outer("parcels").alias("k", "p"))
    return told.select(*columns, _outcome(F.col("p"), at, F.col("before") + F.coalesce(F.get("others", F.col("k")), F.lit(0))).alias("outcome"))


def _counted(packages: DataFrame, claims: DataFrame, kind: str) -> DataFrame:
    """Each claim once, with what `by_code` tells of its code and `before`, the code's good ones before it: exact as
    long as a parcel has that many downloads left. A claim is good once for each parcel.

    Where k downloads are left, only the first k good claims count; they are sought among those of each of 64 slices of
    the code's claims, so a code with a great part of all claims is dealt to many tasks.
    """
    each = claims.withColumn("c", valid_code(F.col("code"))).join(by_code(packages, kind), "c", "left").withColumn("at", F.struct("ts", "claim_id"))
    good = F.col("until") > F.col("ts")
    counted = each.filter(good & F.col("most").isNotNull()).select("c", "at", "most", later("goods", F.col("ts")).alias("n"), F.pmod(F.xxhash64("claim_id"), F.lit(64)).alias("slice"))
    some = counted.withColumn("place", F.row_number().over(Window.partitionBy("c", "slice").orderBy("at"))).filter("place <= most")
    firsts = some.groupBy(F.col("c").alias("of")).agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("firsts"), F.max("most").cast("int").alias("k"))
    # the claim of each good one, to the k-th
    nth = F.flatten(F.transform(F.slice("firsts", 1, F.col("k")), lambda x: F.array_repeat(x["at"], x["n"])))
    firsts = firsts.select("of", F.slice(nth, 1, F.col("k")).alias("nth"))
    at = F.col("at")
    before = F.when(F.col("nth").isNull(), 0).when(at > F.element_at("nth", -1), F.array_size("nth")).when(good, F.array_position("nth", at) - 1).otherwise(F.array_size(F.filter("nth", lambda x: x < at)))
    return each.join(firsts, F.col("c") == F.col("of"), "left").withColumn("before", before)


def settle_claims(packages: DataFrame, claims: DataFrame, kind: str = "file") -> DataFrame:
    """P10: the outcome of every claim: invalid, expired, exhausted, missing or ok, tested in this order.

    Only a claim that is otherwise good uses a download up. A burnt parcel keeps no payload, yet later claims read
    `exhausted` first. A null code is invalid. Parcels that share a code share its claims: there is a row for each
    parcel, and good ones of all count, in order of ts, claim_id and the parcel's row. Claims are counted before they
    become such rows, so these are neither sorted nor shuffled.
    """
    return outcomes(_counted(packages, claims, kind), F.col("ts"), "claim_id", "code", "ts")


def used_up(packages: DataFrame, claims: DataFrame, kind: str = "file") -> DataFrame:
    """(c, used): how many outcomes of a code are `ok`, without a row for each claim and parcel."""
    ts = F.col("ts")
    told = F.array_size(F.filter("parcels", lambda p, k: _outcome(p, ts, F.col("before") + F.get("others", k)) == "ok"))
    each = with_others(_counted(packages, claims, kind), ts)
    return each.withColumn("ok", F.when(F.col("others").isNotNull(), told).otherwise(later("open", ts))).groupBy("c").agg(F.sum("ok").alias("used")).filter("used > 0")


def lookup(packages: DataFrame, codes: DataFrame, now: str) -> DataFrame:
    """Public metadata by code and an HTTP status: 404 unknown, 410 expired or exhausted, else 200. Nothing is used up."""
    view = package_view(packages, now).select(F.col("code").alias("c"), "original_name", "size_bytes", "expired", "exhausted", "downloads_left")
    joined = codes.withColumn("c", valid_code(F.col("code"))).join(view, "c", "left")
    status = F.when(F.col("expired").isNull(), 404).when(F.col("expired") | F.col("exhausted"), 410).otherwise(200)
    reason = F.when(F.col("expired").isNull(), "invalid").when(F.col("expired"), "expired").when(F.col("exhausted"), "exhausted").otherwise("ok")
    shown = {c: F.when(status == 200, F.col(c)) for c in ("original_name", "size_bytes", "downloads_left")}
    return joined.withColumns({"status": status, "reason": reason}).withColumns(shown).select("code", "status", "reason", *shown)


def apply_claims(packages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Parcels with their new download counts; a burnt one loses its payload."""
    return apply_used(packages, outcomes.filter("outcome = 'ok'").groupBy(valid_code(F.col("code")).alias("c")).agg(F.count(F.lit(1)).alias("used")))


def apply_used(packages: DataFrame, used: DataFrame) -> DataFrame:
    """P12 by the counts of `used_up`."""
    joined = packages.join(used, F.col("code") == F.col("c"), "left")
    burnt = (F.col("burn_after") == 1) & (F.coalesce("used", F.lit(0)) > 0)
    changed = {"download_count": F.col("download_count") + F.coalesce("used", F.lit(0)), "text_payload": F.when(burnt, "").otherwise(F.col("text_payload")), "stored_rel": F.when(burnt, "").otherwise(F.col("stored_rel"))}
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in packages.columns))


def evolve(packages: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Rows of an older layout with the columns they lack, at their defaults."""
    return packages.withColumns({c: F.lit(v) if c not in packages.columns else F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
