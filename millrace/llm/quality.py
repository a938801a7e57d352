"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each text is measured by itself (words, symbols, repeated lines and five-word windows). Then its lines are
normalised and hashed, the distinct texts of a host that hold a line are counted, lines above the limits are
removed, and a document that loses too much is rejected.

Defined results. A null text counts as an empty one, and a null host is a host of its own. Copies of one text
are one document in the counts and share one verdict, so copying a clean text a thousand times rejects none of
its copies (near_duplicates is there for that). Repeated rows are measured each. Very long texts are measured
whole, in time in proportion to their length (times its logarithm where windows repeat). An empty table gives
no rows. Extra columns, whatever their names, aren't read. Windows, lines and texts are compared by hashes of
64, 64 and 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
#: Words of a window; a document has so many words at least, and at most REPEAT % of them in repeated windows.
WINDOW, LEAST_WORDS, REPEAT = 5, 10, 20
#: A line is removed if more than LINE_DOCS distinct texts of its host hold it, and more than LINE_SHARE % of them.
LINE_DOCS, LINE_SHARE = 10, 5
#: A document is depleted if less than LEFT % of its words stay.
LEFT = 30


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def _covered(windows: Column) -> Column:
    """Words under the windows (hashes in order of place) that occur twice or more."""

    def places(s: Column) -> Column:
        twin = lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, twin), lambda e: e["p"]))

    def words(p: Column) -> Column:
        return _total(F.transform(p, lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - v, F.lit(WINDOW))).cast("long")))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(_let(ordered, places), words))


def _repeated(words: Column) -> Column:
    """Words of a list that stand in windows found twice or more."""

    def of(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return F.when(F.size(h) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(windows, _covered))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars and n_repeat_words of a text that isn't null."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    chars = lambda w: _total(F.transform(w, lambda x: F.length(x).cast("long")))
    return _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), chars(w).alias("word_chars"), _repeated(w).alias("n_repeat_words")))


def dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def normal(line: Column) -> Column:
    """A line in lower case, with single spaces, and each number as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), GAP, " "), "[0-9]+", "0"))


def _lines(text: Column) -> Column:
    """Place, hash and words of each line of a text that has a word."""
    plain = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("place"), normal(x).alias("line")))
    words = lambda e: (F.length(e["line"]) - F.length(F.replace(e["line"], F.lit(" "), F.lit(""))) + 1).cast("long")
    return F.transform(F.filter(plain, lambda e: e["line"] != ""), lambda e: F.struct(e["place"], F.xxhash64(e["line"]).alias("h"), words(e).alias("words")))


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row for each document: its key (as `key`), measures, verdicts and `text_left`, the text without removed lines.

    Columns: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed, kept, text_left.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key).alias("key"), whole.alias("text"), F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("host"))
    own = own.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    by = ["host", "k1", "k2"]
    lines = own.select(*by, F.explode(_lines(F.col("text"))).alias("e")).select(*by, "e.*")

    # copies of one text count once; a hot line or host is counted in each task first
    counts = lines.select(*by, "h").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LINE_DOCS)
    hosts = own.select(*by).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    frequent = counts.join(hosts, "host").filter(100 * F.col("n") > LINE_SHARE * F.col("texts")).select("host", "h")
    gone = lines.join(frequent, ["host", "h"]).groupBy(*by).agg(F.collect_set(F.struct("place", "words")).alias("gone"))

    base = own.withColumn("m", measures(F.col("text"))).select(*by, "key", "text", "m.*", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), dup_lines(F.col("text")).alias("n_dup_lines"))
    out = base.join(gone, by, "left").withColumn("words_removed", F.coalesce(_total(F.transform("gone", lambda e: e["words"])), F.lit(0).cast("long")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT * F.col("n_words"))
    left = F.col("n_words") - F.col("words_removed")
    kept = ~failed & (100 * left >= LEFT * F.col("n_words"))
    cut = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.transform("gone", lambda e: e["place"])), lambda i: F.get(x, i)), "\n")
    text_left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_let(F.split("text", "\n"), cut))
    return out.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "words_removed", kept.alias("kept"), text_left.alias("text_left"))
