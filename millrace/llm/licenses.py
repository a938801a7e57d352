"""Licence scans: sparse TF-IDF cosine to templates, then nearest-ancestor inheritance by path joins.

A text's lines lose their comment marks and are joined into paragraphs. Single lines, and windows of up to
WINDOW sentences of a paragraph, that hold a licence word, and whole texts that hold one, become sparse
vectors over the templates' terms, weighted by inverse document frequencies counted over all files; every
term that no template has weighs their mean. A piece's best template above `HEADER`, or a whole text's above
`FILE`, is the file's licence. A file without one takes that of the nearest directory above it that has
a licence file (one named LICENSE, COPYING or the like with a licence found, or one that is a licence text).

Defined results: a null text has no words and no licence of its own; a null path has no directory. Ties
go to the template first in code-point order, a directory's to its best-scored file, then to the same
order. Repeated rows come back repeated. An empty table gives an empty result. Columns of `carry` pass
through, whatever their names, but for those of the result (path, licence, cosine, origin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written
from .licence_texts import TEMPLATES

#: A piece or text with none of these has no licence; every template has one.
TRIGGER = r"(?i)licen[sc]|copyright|redistribut|public domain|permission|spdx|free software"
#: Least cosine of a piece, and of a whole text; sentences of a piece at most.
HEADER, FILE, WINDOW = 0.7, 0.75, 4
#: What stands before (and behind) the text of a commented line.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+|--+|;+|%+|<!--|\"\"\"|REM\b)?[ \t]*|[ \t]*(?:\*+/|-->)[ \t]*$"
FILE_NAME = r"(?i)^(un)?licen[sc]e|^copying|^notice"


def _terms() -> list[str]:
    import re

    return sorted({w for _, t in TEMPLATES for w in re.sub(r"[\W_]+", " ", t.lower()).split()})


def frequencies(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, idf) of the templates' terms, from counts over all files."""
    spark, vocabulary = files.sparkSession, _terms()
    own = F.array_intersect(F.split(words(F.col(text_col)), " "), F.array(*map(F.lit, vocabulary)))
    counts = files.select(F.explode(own).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    listed = spark.createDataFrame([(w,) for w in vocabulary], "term string").join(counts, "term", "left").withColumn("total", F.lit(files.count()))
    return listed.select("term", (F.log((F.col("total") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).alias("idf"))


def vectors(texts: DataFrame, idf: DataFrame) -> DataFrame:
    """(key, term, weight, norm) of `texts` (key, text): terms of some template, and the norm over all terms."""
    mean = idf.agg(F.avg("idf")).first()[0]
    counted = texts.select("key", F.explode(F.split(words(F.col("text")), " ")).alias("term")).filter("term <> ''").groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = counted.join(F.broadcast(idf), "term", "left").withColumn("weight", (1 + F.log("tf")) * F.coalesce("idf", F.lit(mean)))
    norms = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.filter("idf is not null").join(norms, "key").select("key", "term", "weight", "norm")


def similar(texts: DataFrame, idf: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(key, licence, cosine): the best template of each text that shares a term with one."""
    spark = texts.sparkSession
    forms = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "form int, licence string, text string")
    known = vectors(forms.select(F.col("form").alias("key"), "text"), idf).join(forms.select(F.col("form").alias("key"), "licence"), "key")
    known = known.select(F.col("key").alias("form"), "term", "licence", (F.col("weight") / F.col("norm")).alias("w"))  # a few hundred rows, as many as the templates have terms
    dots = vectors(texts, idf).join(F.broadcast(known), "term").groupBy("key", "form", "licence").agg(F.sum(F.col("weight") / F.col("norm") * F.col("w")).alias("cosine"))
    best = dots.groupBy("key", "licence").agg(F.max("cosine").alias("cosine"))
    return best.groupBy("key").agg(F.min_by("licence", F.struct(-F.col("cosine"), F.col("licence"))).alias("licence"), F.max("cosine").alias("cosine"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def pieces(texts: DataFrame) -> DataFrame:
    """(content, piece): lines with a licence word, and windows of sentences of a paragraph that hold one."""
    bare = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), MARKS, "")
    lines = texts.select("content", F.explode(F.split(bare, r"\n+")).alias("piece"))
    paragraphs = texts.select("content", F.explode(F.split(bare, r"\n\s*\n")).alias("paragraph")).filter(F.col("paragraph").rlike(TRIGGER))
    said = F.split(F.regexp_replace("paragraph", r"\s+", " "), r"(?<=[.!?;]) (?=[\p{Lu}\p{N}(])")
    # no licence word runs over the end of a sentence, so each is looked at once; only windows with one are joined
    marked = paragraphs.select("content", F.transform(said, lambda s: F.struct(s.alias("words"), s.rlike(TRIGGER).alias("hit"))).alias("said"))

    def of(at: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.size("said") - at)), lambda n: F.slice("said", at + 1, n))
        return F.transform(F.filter(parts, lambda part: F.exists(part, lambda s: s["hit"])), lambda part: F.array_join(part["words"], " "))

    windows = marked.select("content", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("said") - 1), of))).alias("piece"))
    return lines.unionByName(windows).filter(F.col("piece").rlike(TRIGGER))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, *carry, licence, cosine, origin) of each row: origin is header, file, inherited, or null with no licence."""
    # own columns travel in a struct, so none of their names can clash
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("own"))
    idf = written(frequencies(rows))
    # only texts with a licence word are looked at more closely; they are named by their content
    seen = written(rows.withColumn("text", F.when(F.col("text").rlike(TRIGGER), F.col("text"))).withColumn("content", F.sha2("text", 256)))
    marked = seen.filter("content is not null").select("content", "text").dropDuplicates(["content"])
    parts = pieces(marked).select(F.struct("content", F.sha2("piece", 256).alias("p")).alias("key"), F.col("piece").alias("text")).dropDuplicates(["key"])
    header = similar(parts, idf).filter(F.col("cosine") >= HEADER).select(F.col("key.content").alias("content"), "licence", "cosine")
    # an identifier alone is a header, never a licence file
    full = [(name, text) for name, text in TEMPLATES if not text.startswith("SPDX")]
    whole = similar(marked.select(F.col("content").alias("key"), "text"), idf, full).filter(F.col("cosine") >= FILE).select(F.col("key").alias("content"), "licence", "cosine")
    both = header.withColumn("origin", F.lit("header")).unionByName(whole.withColumn("origin", F.lit("file")))
    best = written(both.groupBy("content").agg(F.min_by(F.struct("licence", "cosine", "origin"), F.struct(F.col("origin"), -F.col("cosine"), F.col("licence"))).alias("best")))
    found = written(seen.join(best, "content", "left").select("path", "own", "best.licence", "best.cosine", "best.origin"))

    is_file = (F.col("origin") == "file") | F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME)
    roots = found.filter(F.col("licence").isNotNull() & is_file).groupBy(_parent(F.col("path")).alias("dir")).agg(F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), F.col("licence"))).alias("from"))
    # every directory that asks, with all above it; the deepest that has a licence gives it
    asking = found.filter("licence is null and path is not null").select(_parent(F.col("path")).alias("asks")).distinct()
    steps = F.split("asks", "/")
    above = asking.select("asks", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("dir")))).alias("a")).select("asks", "a.depth", "a.dir")
    given = above.join(roots, "dir").groupBy("asks").agg(F.max_by("from", "depth").alias("from"))
    joined = found.withColumn("asks", F.when(F.col("licence").isNull(), _parent(F.col("path")))).join(given, "asks", "left")
    own = [F.col("own")[c].alias(c) for c in carry]
    return joined.select("path", *own, F.coalesce("licence", "from.licence").alias("licence"), F.coalesce("cosine", "from.cosine").alias("cosine"), F.coalesce("origin", F.when(F.col("from").isNotNull(), "inherited")).alias("origin"))
