"""Text columns and corpus jobs: lines, counts, patterns, spacing, times, money, JSON, ranges."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pieces

_CJK = r"\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
#: Line breaks as Python's splitlines sees them.
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
FLAGS = {"i": re.I, "m": re.M, "s": re.S, "x": re.X, "u": re.U, "a": re.A}


def split_lines(text: Column) -> Column:
    """Lines of a text; none after a last line break."""
    parts = F.split(F.coalesce(text, F.lit("")), BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line)."""
    return docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))


def process_lines(docs: DataFrame, strip_empty: bool = False, dedupe: bool = False, reverse: bool = False, sort: bool = False) -> DataFrame:
    """Strip empty lines, then keep first occurrences, then reverse, then sort by code point (which undoes reverse)."""
    own = split_lines(F.col("text"))
    work = F.filter(own, lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) != "") if strip_empty else own
    work = F.array_distinct(work) if dedupe else work
    work = F.reverse(work) if reverse else work
    work = F.array_sort(work) if sort else work
    return docs.select("doc_id", F.array_join(work, "\n").alias("text"), F.size(work).alias("lines"), F.size(own).alias("input_lines"))


def corpus_line_dedupe(docs: DataFrame) -> DataFrame:
    """Texts without lines that occur before, in order of (doc_id, pos), anywhere in the corpus; lines dropped by document.

    A line's first place is a minimum, which is pre-aggregated; no line's occurrences meet in one task. Only hashes
    and places are joined; lines are taken out of the text at its document's row. A null or empty text has no lines:
    it stays, empty. A null doc_id comes first in order, and rows that share an id (null too) are one document,
    their texts one after the other in an order by hash.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    text = F.array_join(F.transform(F.sort_array(F.transform("texts", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), lambda x: x["x"]), "\n")
    one = whole.select("doc_id", F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(text).alias("text"))
    each = one.select("doc_id", F.posexplode(F.transform(split_lines(F.col("text")), lambda x: F.unhex(F.sha2(x, 256)))).alias("pos", "h"))
    first = each.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("f"))
    again = each.join(first, "h").filter(~F.col("doc_id").eqNullSafe(F.col("f.doc_id")) | (F.col("pos") != F.col("f.pos")))
    gone = again.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("pos").alias("gone"))
    joined = one.join(gone, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    rest = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n")
    kept = F.when(F.col("gone").isNull(), F.array_join(split_lines(F.col("text")), "\n")).otherwise(F.get(F.transform(F.array(split_lines(F.col("text"))), rest), F.lit(0)))
    return joined.select("doc_id", kept.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("dropped"))


def line_frequency(docs: DataFrame, k: int = 50) -> DataFrame:
    """T4: the k most frequent lines that aren't empty, with their documents; a report of k rows."""
    per_doc = lines(docs).filter("line <> ''").groupBy("line", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).orderBy(F.desc("n"), "line").limit(k)


def text_stats(text: Column) -> dict[str, Column]:
    """T5: characters, those that aren't white space, lines, and words (CJK characters and ASCII word runs)."""
    text = F.coalesce(text, F.lit(""))
    return {
        "chars": F.length(text),
        "chars_no_ws": F.length(F.regexp_replace(text, r"(?U)\s+", "")),
        "lines": F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit(r"\n")) + 1),
        "words": F.regexp_count(text, F.lit(rf"[{_CJK}]|[A-Za-z0-9_]+")),
    }


def stats_rollup(docs: DataFrame) -> DataFrame:
    """T5 by language and source."""
    return docs.select("lang", "source", *(c.alias(n) for n, c in text_stats(F.col("text")).items())).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), *(F.sum(c).alias(c) for c in ("chars", "chars_no_ws", "lines", "words")))


def grep_text(docs: DataFrame, pattern: str) -> DataFrame:
    """T6, texts only: (doc_id, pos, match) of a Java pattern."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "match"))


def _flags(flags: str) -> int:
    unknown = set(flags) - set(FLAGS)
    if unknown:
        raise ValueError(f"unknown flags: {sorted(unknown)}")
    return sum(FLAGS[f] for f in set(flags))


def grep(docs: DataFrame, pattern: str, flags: str = "", count: int = 0) -> DataFrame:
    """T6 with spans: one row for each match of a Python pattern, its groups as (index, name, start, end, text).

    `count` bounds the matches of each text where it is above 0, as the option asks.
    """
    wanted = re.compile(pattern, _flags(flags))
    names = {i: n for n, i in wanted.groupindex.items()}
    group = pa.list_(pa.struct([("index", pa.int32()), ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def run(batches):
        for batch in pieces(batches):
            ids, pos, starts, ends, texts, groups = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, m in enumerate(wanted.finditer(text or "")):
                    if 0 < count <= i:
                        break
                    ids.append(doc)
                    pos.append(i)
                    starts.append(m.start())
                    ends.append(m.end())
                    texts.append(m[0])
                    groups.append([{"index": g, "name": names.get(g), "start": m.start(g), "end": m.end(g), "text": m[g]} for g in range(1, (wanted.groups or 0) + 1)])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string()), pa.array(groups, group)], ["doc_id", "pos", "start", "end", "match", "groups"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, pos int, start int, end int, match string, groups array<struct<index:int,name:string,start:int,end:int,text:string>>")


def replace(docs: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """All matches replaced; `$1` and `${name}` refer to groups. Named groups may be written the Python way."""
    java = pattern.replace("(?P<", "(?<")
    return docs.select("doc_id", F.regexp_replace("text", java, replacement).alias("text"), F.regexp_count("text", F.lit(java)).alias("replace_count"))


def replace_some(docs: DataFrame, pattern: str, replacement: str, count: int, flags: str = "") -> DataFrame:
    """T7 with a limit: the first `count` matches of a Python pattern, all if it is 0 or less."""
    wanted = re.compile(pattern, _flags(flags))
    python = re.sub(r"\$(?:\{(\w+)\}|(\d+))", lambda m: rf"\g<{m[1] or m[2]}>", replacement.replace("\\", r"\\"))

    def run(batches):
        for batch in pieces(batches):
            done = [wanted.subn(python, t or "", count=max(0, count)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["doc_id", "text", "replace_count"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, replace_count int")


def match_census(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Documents hit and matches of each named pattern, by language; one pass over the texts, no product of tables."""
    counts = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).alias("n")) for n, p in sorted(patterns.items())))
    each = docs.select("lang", F.explode(counts).alias("x"))
    return each.groupBy(F.col("x.name").alias("name"), "lang").agg(F.count_if(F.col("x.n") > 0).alias("docs"), F.sum("x.n").alias("matches"))


#: Stand for an escape, a word and white space while a shape is made.
_ESCAPE, _WORD, _SPACE = "\ue000", "\ue001", "\ue002"


def shape(value: Column) -> Column:
    """The pattern of a value's runs: digits by number, words, white space, escaped punctuation."""
    marked = F.regexp_replace(value, r"([^A-Za-z0-9_\s])", f"{_ESCAPE}$1")
    marked = F.regexp_replace(marked, r"[A-Za-z_][A-Za-z0-9_]*", _WORD)
    marked = F.regexp_replace(marked, r"\s+", _SPACE)
    digits = F.regexp_extract_all(marked, F.lit(r"\d+"), F.lit(0))
    runs = F.transform(F.split(marked, r"\d+", -1), lambda gap, i: F.concat(gap, F.coalesce(F.concat(F.lit("\\d{"), F.length(F.get(digits, i)).cast("string"), F.lit("}")), F.lit(""))))
    plain = F.replace(F.replace(F.array_join(runs, ""), F.lit(_WORD), F.lit("\\w+")), F.lit(_SPACE), F.lit("\\s+"))
    return F.replace(plain, F.lit(_ESCAPE), F.lit("\\"))


def shape_profile(rows: DataFrame, column: str, k: int = 50) -> DataFrame:
    """T9 as a job: the k most frequent shapes of a column with the least example; a report of k rows."""
    return rows.filter(F.col(column).isNotNull()).groupBy(shape(F.col(column)).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("example")).orderBy(F.desc("n"), "shape").limit(k)


# CJK letters and forms, punctuation without spaces around it, odd spaces, ends of sentences, list markers.
CJK = r"\u3000-\u303f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef"
PUNCT = "，。！？；：、…—·「」『』【】《》（）'［］｛｝～‘’“”"
ODD_SPACE = r"[\u00a0\u2000-\u200b\u202f\u205f\u3000]+"
SENTENCE_END = "。！？；：.!?;…"
CLOSERS, OPENERS, CLOSED = ".,;:!?)]}", "([{<", ")]}>.,;:!?"
MARKER = r"^(?:\d{1,3}[、.．)）]|[（(]\d{1,3}[)）]|[一二三四五六七八九十百]+[、.．]|[•·▪◦●○◆◇■□])"
#: White space as Python's strip sees it, with zero-width spaces.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]"


def tidy_spacing(text: Column) -> Column:
    """Odd spaces are plain ones; none within CJK, around its punctuation, or between CJK and digits or Latin words of up to four letters; runs of spaces are one."""
    cjk, punct = f"[{CJK}]", f"[{PUNCT}]"
    # A run of spaces goes, or stays, by what stands on its two sides, and these never change: one pass does. Each
    # match begins with a space, so that only spaces are looked at.
    gaps = [
        rf"(?<={cjk} ) *(?={cjk}|\p{{Nd}}|[A-Za-z]{{1,4}}(?![A-Za-z]))",
        rf" *(?={punct})",
        rf"(?<={punct} ) *",
        rf"(?<=\p{{Nd}} ) *(?={cjk})",
        rf"(?<=(?<![A-Za-z])[A-Za-z]{{1,4}} ) *(?={cjk})",
    ]
    tight = F.regexp_replace(F.regexp_replace(text, ODD_SPACE, " "), f" (?:{'|'.join(gaps)})", "")
    return F.get(F.transform(F.array(tight), lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x)), F.lit(0))


def unwrap_soft_lines(text: Column) -> Column:
    """Hard-wrapped lines joined, with tidy spacing: a break stays after a sentence's end and before a list marker; blank lines go.

    Each break is judged by the lines on its two sides alone, so a text takes time in proportion to its length. A
    hyphen before a letter goes with its break; CJK, brackets and closing punctuation are joined tightly, other text
    by a space. A blank first or last line leaves one break there.
    """
    among = lambda chars, c: F.instr(F.lit(chars), c) > 0
    tight_char = lambda c: c.rlike(f"[{CJK}{PUNCT}]") | (c != "") & among(CLOSERS, c)

    def separated(left: Column, right: Column) -> Column:
        """`left` (trimmed at its end) and what stands between it and `right` (trimmed at its start)."""
        last, first = F.right(left, F.lit(1)), F.left(right, F.lit(1))
        keeps = among(SENTENCE_END, last) | right.rlike(MARKER)
        glued = (last == "-") & first.rlike(r"\p{L}") & ~first.rlike(f"[{CJK}]")
        tight = tight_char(first) | tight_char(last) & first.rlike(r"[\p{L}\p{N}]") | among(OPENERS, first) | among(CLOSED, last)
        return F.when(keeps, F.concat(left, F.lit("\n"))).when(glued, F.left(left, F.length(left) - 1)).when(tight, left).otherwise(F.concat(left, F.lit(" ")))

    def joined(lines: Column) -> Column:
        start = end = F.regexp_replace
        own = F.transform(F.filter(lines, lambda x: ~x.rlike(f"^{BLANK}*$")), lambda x: F.struct(start(x, f"^{BLANK}+", "").alias("l"), end(x, f"{BLANK}+$", "").alias("r")))
        first, last = F.element_at(lines, 1), F.element_at(lines, -1)

        def pieces(rows: Column) -> Column:
            # `r` keeps what stands before the first line, `l` what stands behind the last
            body = lambda e, i: F.when(i == 0, e["r"]).otherwise(end(e["l"], f"{BLANK}+$", ""))
            each = lambda e, i: F.when(i == F.size(rows) - 1, F.when(last.rlike(f"^{BLANK}*$"), body(e, i)).when(i == 0, F.element_at(lines, -1)).otherwise(e["l"])).otherwise(separated(body(e, i), F.get(rows, i + 1)["l"]))
            head = F.when(first.rlike(f"^{BLANK}*$"), F.lit("\n")).otherwise("")
            tail = F.when(last.rlike(f"^{BLANK}*$"), F.lit("\n")).otherwise("")
            whole = F.array_join(F.transform(rows, each), "")
            return F.when(F.size(rows) == 0, F.lit("\n")).otherwise(F.concat(head, F.when(head == "", whole).otherwise(F.regexp_replace(whole, f"^{BLANK}+", "")), tail))

        return F.when(F.size(lines) == 1, first).otherwise(F.get(F.transform(F.array(own), pieces), F.lit(0)))

    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    return tidy_spacing(F.get(F.transform(F.array(lines), joined), F.lit(0)))


# Time formats in order of trial.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyyMMddHHmmss"]


def normalise_timestamps(rows: DataFrame, column: str, tz_min: int = 480) -> DataFrame:
    """epoch_s, epoch_ms, is_ms, utc, local, weekday and day_of_year of a column; `error` where it is no time.

    Numbers are epochs, in milliseconds from 13 digits on. A `Z` or offset is dropped, not applied: naive
    times are `tz_min` minutes ahead of UTC.
    """
    text = F.trim(F.coalesce(column, F.lit("")))
    digits = F.regexp_replace(text, "[, ]", "")
    is_number = digits.rlike(r"^-?\d+(\.\d+)?$")
    is_ms = is_number & (F.length(F.regexp_extract(digits, r"^-?(\d+)", 1)) >= 13)
    value = digits.try_cast("decimal(30,6)")
    naive = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "T", " "), "Z$", ""), r"[+-]\d{2}:?\d{2}$", "")
    parsed = F.coalesce(*(F.try_to_timestamp(naive, F.lit(f)) for f in TIME_FORMATS))
    micros = F.when(is_number, F.when(is_ms, value * 1000).otherwise(value * 1_000_000).cast("long")).otherwise(F.unix_micros(parsed) - tz_min * 60_000_000)
    out = rows.withColumn("_us", micros)
    utc = F.timestamp_micros("_us")
    local = F.timestamp_micros(F.col("_us") + tz_min * 60_000_000)
    return out.withColumns(
        {
            "epoch_s": F.floor(F.col("_us") / 1_000_000).cast("long"),
            "epoch_ms": F.floor(F.col("_us") / 1000).cast("long"),
            "is_ms": F.when(F.col("_us").isNotNull(), is_ms),
            "utc": F.date_format(utc, "yyyy-MM-dd HH:mm:ss"),
            "local": F.date_format(local, "yyyy-MM-dd HH:mm:ss"),
            "weekday": F.weekday(local),
            "day_of_year": F.dayofyear(local),
            "error": F.when(F.col("_us").isNull(), F.when(text == "", "empty").otherwise("unparseable")),
        }
    ).drop("_us")


# Units of an age and their seconds, ascending.
UNITS = {"分钟": 60, "小时": 3600, "天": 86_400, "个月": 2_592_000, "年": 31_536_000}


def relative_age(seconds: Column, units: tuple[str, ...] = tuple(UNITS), moment: bool = True) -> Column:
    """Age in words of now minus time, in seconds; below zero it lies ahead.

    `units` are those of UNITS to tell it in. An age below the least has words of its own (`moment`), or none: null.
    """
    size, past = F.abs(seconds), seconds >= 0
    word = F.lit(None)
    for name, unit in UNITS.items():
        if name in units:
            made = F.concat(F.floor(size / unit).cast("string"), F.lit(name), F.when(past, "前").otherwise("后"))
            word = F.when(size >= unit, made).otherwise(word)
    return F.coalesce(word, F.when(past, "刚刚").otherwise("即将")) if moment else word


MONEY_LIMIT = "9999999999999999.99"


def clean_money(rows: DataFrame, column: str) -> DataFrame:
    """Amount (two places, half up) with yuan, jiao and fen, or the reason of rejection."""
    text = F.translate(F.coalesce(column, F.lit("")), "０１２３４５６７８９．", "0123456789.")
    text = F.regexp_replace(F.regexp_replace(text, r"[\s,，￥¥元]", ""), r"^\+", "")
    value = F.when(text.rlike(r"^\d*\.?\d*$"), text.try_cast("decimal(38,10)"))
    reason = F.when(text == "", "empty").when(text.startswith("-"), "negative").when(F.regexp_count(text, F.lit(r"\.")) > 1, "dots").when(value.isNull(), "not_numeric").when(value > F.lit(MONEY_LIMIT).cast("decimal(38,10)"), "too_large")
    amount = F.when(reason.isNull(), F.round(value, 2).cast("decimal(18,2)"))
    out = rows.withColumns({"reason": reason, "amount": amount})
    cents = (F.col("amount") * 100).cast("long")
    return out.withColumns({"yuan": F.floor(cents / 100).cast("long"), "jiao": F.floor(cents % 100 / 10).cast("int"), "fen": (cents % 10).cast("int")})


def json_kind(text: Column) -> Column:
    """Kind of a JSON text, null if it is invalid."""
    head = F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 1)
    kind = F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "string").when(head == "n", "null").when(head.isin("t", "f"), "boolean").otherwise("number")
    return F.when(F.try_parse_json(text).isNotNull(), kind)


def json_audit(rows: DataFrame, column: str) -> DataFrame:
    """Rows and distinct canonical forms by kind; `invalid` for what doesn't parse."""
    each = rows.filter(F.col(column).isNotNull()).select(F.coalesce(json_kind(F.col(column)), F.lit("invalid")).alias("kind"), F.to_json(F.try_parse_json(column)).alias("canonical"))
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canonical").alias("distinct_forms"))


def json_keys(rows: DataFrame, column: str) -> DataFrame:
    """How often each top-level key occurs."""
    return rows.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def size_verdict(text: Column, most: int) -> Column:
    """400 for a missing text, 413 for one that is too long, else 200."""
    return F.when(text.isNull() | (text == ""), 400).when(F.length(text) > most, 413).otherwise(200)


def expand_ranges(specs: DataFrame, strict: bool = True) -> DataFrame:
    """(id, total, spec) to (id, ord, n): numbers of specs such as `1-3,5` in order, each once; and rows with an error.

    The strict form refuses numbers out of 1..total, the lenient one cuts ranges and refuses only an empty result.
    """
    parts = specs.select("id", "total", F.posexplode_outer(F.split(F.regexp_replace("spec", r"\s+", ""), ",")).alias("at", "part"))
    a, b = F.regexp_extract("part", r"^(\d+)(?:-(\d+))?$", 1), F.regexp_extract("part", r"^(\d+)(?:-(\d+))?$", 2)
    low = a.try_cast("int")
    high = F.when(b == "", low).otherwise(b.try_cast("int"))
    parts = parts.withColumns({"low": low, "high": high}).withColumn("bad", F.col("part").isNull() | F.col("low").isNull() | F.col("high").isNull() | (F.col("low") > F.col("high")))
    if strict:
        parts = parts.withColumn("bad", F.col("bad") | (F.col("low") < 1) | (F.col("high") > F.col("total")))
    lo, hi = F.greatest(F.col("low"), F.lit(1)), F.least(F.col("high"), F.col("total"))
    numbers = F.when(~F.col("bad") & (lo <= hi), F.sequence(lo, hi))
    faulty = parts.groupBy("id").agg(F.max("bad").alias("bad"), F.sum(F.when(~F.col("bad") & (lo <= hi), 1).otherwise(0)).alias("good"))
    fails = faulty.filter(F.col("bad") | (F.col("good") == 0))
    flat = parts.join(fails.select("id"), "id", "left_anti").select("id", "at", F.posexplode(numbers).alias("k", "n"))
    first = flat.groupBy("id", "n").agg(F.min(F.struct("at", "k")).alias("f"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("f"))
    good = first.select("id", nth.alias("ord"), "n", F.lit(None).cast("string").alias("error"))
    return good.unionByName(fails.select("id", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("int").alias("n"), F.lit("bad_range").alias("error")))


def compact_ranges(numbers: DataFrame) -> DataFrame:
    """T26 back: (id, n) to the shortest spec of its numbers, ascending."""
    island = F.col("n") - F.row_number().over(Window.partitionBy("id").orderBy("n"))
    runs = numbers.select("id", "n").distinct().withColumn("g", island).groupBy("id", "g").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    part = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", part.alias("p")))), lambda x: x["p"]), ",").alias("spec"))
