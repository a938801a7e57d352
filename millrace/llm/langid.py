"""Language ID with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: position p of the table holds a bitmask with one
bit for each language, so ANDing the masks at an n-gram's `hashes` positions gives all languages
that contain it at once. A document's per-language popcounts, corrected by each filter's
false-positive rate, decide.

Defined results: a null text, or one without letters, is `und` with score 0. With nothing to learn
from every document is `und`. Ties go to the language first in code-point order. Repeated rows and
columns with clashing names change nothing: only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed

#: Lengths of the character n-grams, in code points; words carry one space on each side.
GRAMS = (3, 4)
#: Positions in the bit-sliced table and hashes for each n-gram; the model is `SLOTS` masks, 8 MB.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Odd multipliers, one for each hash: the top bits of the product are a position.
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Training reads about this many labelled documents of each language, chosen by a hash of doc_id.
TRAIN_DOCS = 1500
#: Letters that are looked up at a time.
PIECE = 300_000
#: An n-gram belongs to a language if its frequency there is this share of its highest anywhere.
SHARE = 0.34
#: ... and this many training n-grams of the language are that n-gram.
LEAST = 3


@dataclass
class Model:
    """The languages in code-point order, the table [words of 64 languages, SLOTS], and false-positive rates."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters as code points, each other run as one space, a space around each text; and each text's end."""
    joined = " ".join(f" {t} " if t else "  " for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + 3 if t else 3 for t in texts])
    known = np.flatnonzero(np.bincount(points)) if len(points) else points
    lower = np.full(int(known[-1]) + 1 if len(known) else 1, 32, np.uint32)
    for c in known:
        if (ch := chr(c)).isalpha():
            lower[c] = ord(ch.lower()[0])
    points = lower[points]
    space = points == 32
    keep = ~(space & np.concatenate([[False], space[:-1]]))
    starts = ends - np.diff(ends, prepend=0)
    keep[starts] = True  # two texts never share a space
    before = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], before[ends]


def grams(points: np.ndarray):
    """For each n the packed n-grams at all places, and which of them count: those without a space inside.

    Each text starts and ends with a space of its own, so none that counts spans two texts.
    """
    short = ((points ^ (points >> np.uint32(16)) * np.uint32(0x9E37)) & np.uint32(0xFFFF)).astype(np.uint64)
    inside = points != 32
    pairs = short[:-1] | short[1:] << np.uint64(16)
    for n in GRAMS:
        if len(points) >= n:
            packed = pairs[: len(points) - n + 1] | (pairs[2:] << np.uint64(32) if n == 4 else short[2:] << np.uint64(32) | np.uint64(1 << 63))
            counts = inside[1 : len(packed) + 1]
            yield packed, counts & inside[2 : len(packed) + 2] if n == 4 else counts


def slots(packed: np.ndarray) -> list[np.ndarray]:
    """The positions of each n-gram in the table."""
    mixed = packed ^ packed >> np.uint64(29)
    return [((mixed * np.uint64(k)) >> np.uint64(64 - SLOT_BITS)).astype(np.intp) for k in HASHES]


def _counted(batches):
    """(lang, gram, n) of each batch, summed within it."""
    for batch in batches:
        langs = batch.column(1).to_pylist()
        names = sorted(set(langs))
        number = {name: i for i, name in enumerate(names)}
        points, ends = letters(batch.column(0).to_pylist())
        of = np.repeat(np.array([number[x] for x in langs], np.int64), np.diff(ends, prepend=0))
        each = [(packed[ok], of[: len(packed)][ok]) for packed, ok in grams(points)]
        for i, name in enumerate(names):
            found, n = np.unique(np.concatenate([packed[own == i] for packed, own in each] or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", by: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learn the filters from rows with a language; None if there are none.

    The sample is bounded by `train_docs` for each language in expectation: a row is in it if a hash
    of `by` and its text falls under train_docs / rows of its language. Distinct n-grams are counted on
    executors; the driver gets at most `SLOTS` positions with their masks, and one count a language.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(by).cast("string").alias("k")).filter("l is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("l").agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return None
    names = sorted(sizes)
    spark = labelled.sparkSession
    info = spark.createDataFrame([(name, i, min(1.0, train_docs / sizes[name])) for i, name in enumerate(names)], "l string, number int, share double")
    chance = (F.xxhash64("k") % 1_000_000_007 + 1_000_000_007) % 1_000_000_007 / F.lit(1_000_000_007.0)
    sample = rows.join(F.broadcast(info), "l").filter(chance < F.col("share")).filter("t is not null").select("t", "l")
    counted = sample.mapInArrow(freed(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    rates = counted.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("all"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("each"))
    owned = best.select("gram", F.explode("each").alias("x"), "top").filter(F.col("x.rate") >= SHARE * F.col("top")).select("gram", F.col("x.lang").alias("l")).join(F.broadcast(info), "l")
    found = owned.select("gram", "number").mapInArrow(freed(_placed), "slot int, number int").groupBy("slot", F.expr("number div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, number % 64))").alias("mask")).toPandas()
    table = np.zeros(((len(names) + 63) // 64, SLOTS), np.uint64)
    table[found["word"].to_numpy(np.int64), found["slot"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero(table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(names))]) / SLOTS
    if len(names) <= 8:
        table = table.astype(np.uint8)
    return Model(names, table, fill ** len(HASHES))


def _placed(batches):
    for batch in batches:
        at = slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.record_batch([pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.tile(batch.column(1).to_numpy(zero_copy_only=False), len(HASHES)))], ["slot", "number"])


def pieces(texts: list[str | None]):
    """Lists of (text number, piece) with some PIECE letters each; a long text is cut between words."""
    group, size = [], 0
    for i, text in enumerate(texts):
        text = text or ""
        while text or not group or group[-1][0] != i:
            end = PIECE
            if len(text) > PIECE:
                while end < 2 * PIECE and end < len(text) and text[end].isalpha():
                    end += 1
            group.append((i, text[:end]))
            size += len(group[-1][1])
            text = text[end:]
            if size >= PIECE:
                yield group
                group, size = [], 0
                if not text:
                    break
    if group:
        yield group


def scored(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    n, hits, has = np.zeros(len(texts)), np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), bool)
    for group in pieces(texts):
        of = np.array([i for i, _ in group])
        points, ends = letters([t for _, t in group])
        starts = np.concatenate([[0], ends[:-1]])
        has[of] |= np.add.reduceat(points != 32, starts) > 0

        def summed(x, starts=starts, size=len(points)):
            return np.add.reduceat(np.concatenate([x, np.zeros(size - len(x), x.dtype)]), starts, dtype=np.int64)

        for packed, ok in grams(points):
            places = slots(packed)
            np.add.at(n, of, summed(ok))
            for word, column in enumerate(model.table):
                mask = column[places[0]]
                for p in places[1:]:
                    mask &= column[p]
                mask *= ok
                for i in range(word * 64, min(len(model.languages), word * 64 + 64)):
                    np.add.at(hits[:, i], of, summed(mask >> mask.dtype.type(i % 64) & mask.dtype.type(1)))
    right = np.clip((hits - n[:, None] * model.false_rate) / np.maximum(1 - model.false_rate, 1e-9), 0, None)
    best = right.argmax(axis=1)
    top = right[np.arange(len(texts)), best]
    score = np.where(has, np.clip(top / np.maximum(right.sum(axis=1), 1e-9), 0, 1), 0.0)
    return [model.languages[b] if ok else "und" for b, ok in zip(best, has, strict=True)], score


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score, by whole texts. The table of fixed size goes to the executors once."""
    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            lang, score = scored(shared.value, batch.column(at).to_pylist())
            kept = [i for i, x in enumerate(batch.schema.names) if x not in ("lang_pred", "score")]
            yield pa.record_batch([*(batch.column(i) for i in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*(batch.schema.names[i] for i in kept), "lang_pred", "score"])

    names = [x for x in docs.columns if x not in ("lang_pred", "score")]
    return docs.mapInArrow(freed(run), schema.__class__([*(schema[x] for x in names), schema["lang_pred"], schema["score"]]))


def held_out(by: str = "doc_id") -> Column:
    """The test fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(by).cast("string")) % 4 == 2, F.lit(False))
