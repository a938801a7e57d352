"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length; each source takes whole copies of itself as often as its
target allows, and the rest of its budget is a bounded subset-sum problem over (length, count): a
proportional seeded part first, then a dynamic program over the budget that is left. The documents
of a length are then picked by a seeded hash.

Defined results: a null text has size 0, as has an empty one; a document of size 0 is never taken.
A null source is a source of its own, last in order. If all sizes are 0, all targets are 0. Every
row counts, repeated ones too; extra columns are left out. Ties between rows of one hash go to the
smaller doc_id; rows alike in both are interchangeable.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Weights of the sources in order, repeating; the share of all sizes that is mixed; copies of a source at most.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2
#: Words that the dynamic program fits, or twice the longest text's if that is more; what exceeds them is dealt out in proportion first.
EXACT = 60_000
#: Rows of one source and length in one seeded group; a larger set is split by the leading hash bits.
GROUP = 50_000


def size(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Capped proportional shares: with sources in order of cap / weight, the level is the largest of
    (budget - caps so far) / (weights left), and a target is the lesser of its cap and level x weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    listed = totals.withColumn("n", F.row_number().over(order) - 1)
    listed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("double"))
    listed = listed.withColumn("cap", copies * F.col("source_size").cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    budget = share * F.sum("source_size").over(everything).cast("double")
    level = listed.withColumn("level", (budget - capped) / left).withColumn("level", F.max("level").over(everything))
    return level.select("source", "source_size", F.least("cap", F.greatest(F.lit(0.0), F.col("level") * F.col("weight"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many of each length to take so that the sum comes as near to `budget` as is found, not above it.

    What exceeds EXACT and twice the longest length is dealt out in proportion to the counts, then by
    more of each length, longest first, so that at least half of that stays open; then bounded-knapsack
    dynamic programming over all the rest, in units of the lengths' common divisor: counts are split into
    powers of two, and for each sum the item that first reached it is kept.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    budget = min(budget, total)
    if budget <= 0 or not len(lengths):
        return take
    if budget == total:
        return counts.copy()
    # no length exceeds half of the limit, so what the loop leaves open is within it
    limit = max(EXACT, 2 * int(lengths[counts > 0].max()))
    if budget > limit:
        take = (counts * ((budget - limit // 2) / total)).astype(np.int64)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= limit:
            break
        more = min(int(counts[i] - take[i]), (rest - limit // 2) // int(lengths[i]))
        if more > 0:
            take[i] += more
            rest -= more * int(lengths[i])
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    lengths, rest = lengths // unit, rest // unit
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    by = np.full(rest + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        spare, step = int(counts[i] - take[i]), 1
        while spare > 0 and not reached[rest]:
            n = min(step, spare)
            spare, step, width = spare - n, step * 2, n * int(lengths[i])
            if width > rest:
                break
            fresh = reached[:-width] & ~reached[width:]
            by[width:][fresh] = len(items)
            reached[width:] |= fresh
            items.append((i, n))
        if reached[rest]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _fitted(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        total = int((pdf["size"] * pdf["n"]).sum())
        whole, rest = divmod(int(np.floor(pdf["target"].iloc[0])), total) if total else (0, 0)
        extra = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), rest, seed)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "whole": whole, "extra": extra, "source_size": total, "target": pdf["target"]})

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, source, size, source_size, target, taken, copies) of each row of `docs`.

    Only ids, sources and sizes are shuffled (and the small columns of `carry`). A source's lengths and counts,
    not its documents, meet in one task; the documents of one length are picked in groups of at most about
    GROUP rows. Tables with a row for each source and length grow with the rows, so they are never broadcast.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(source_col).cast("string").alias("source"), size(F.col(text_col)).alias("size"))
    rows = written(rows.withColumn("draw", F.xxhash64(F.col("doc_id"), F.lit(seed))))
    counts = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    aim = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))).select("source", F.col("target"), F.col("source_size").alias("total"))
    aim = written(aim)
    known = counts.filter("size > 0").join(aim.withColumnRenamed("source", "s"), F.expr("source <=> s")).select("source", "size", "n", "target")
    plan = written(known.groupBy("source").applyInPandas(_fitted(seed), "source string, size long, n long, whole long, extra long, source_size long, target double"))
    sliced = plan.select(F.col("source").alias("s"), F.col("size").alias("z"), "whole", "extra", F.greatest(F.lit(1), F.expr(f"n div {GROUP}")).alias("parts"))
    slim = rows.join(sliced.hint("shuffle_merge"), F.expr("source <=> s and size = z")).withColumn("part", F.expr("pmod(shiftrightunsigned(draw, 1), parts)"))
    slim = slim.select("doc_id", *carry, "source", "size", "draw", "whole", "extra", "part")
    # a slice takes what the slices before it have left of its length's number
    slices = slim.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"), F.first("extra").alias("extra"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("q"), F.greatest(F.lit(0), F.col("extra") - before).alias("picks"))
    ranked = slim.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id")))
    picked = ranked.join(slices.hint("shuffle_merge"), F.expr("source <=> s and size = z and part = q")).select("doc_id", *carry, "source", "size", (F.col("whole") + F.when(F.col("rank") <= F.col("picks"), 1).otherwise(0)).alias("copies"))
    whole = picked.unionByName(rows.filter("size = 0").select("doc_id", *carry, "source", "size", F.lit(0).cast("long").alias("copies")))
    aim = aim.withColumnRenamed("source", "s")
    return whole.join(aim, F.expr("source <=> s")).select("doc_id", *carry, "source", "size", F.col("total").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
