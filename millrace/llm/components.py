"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links of each vertex's larger (or smaller) neighbours to its least neighbour.

    The minimum is a grouped aggregate that is joined back, so a hub with very many neighbours is
    pre-aggregated and its join partition can be split.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a small-star looks from the larger end only: edges are kept with a > b
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = edges.join(least, "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each vertex is a centre, or has one edge, to a centre; then nothing is left to do."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("b").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
    return ends.groupBy("e.v").agg(F.sum("e.out").alias("out"), F.max("e.in").alias("in")).filter("out > 1 or out = 1 and in = 1").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for each vertex of `edges` (a, b long); component is the least id reachable.

    Null ends and loops are ignored; an empty edge table gives an empty result. Each round is
    written to the shared folder; only whether one more is needed comes to the driver.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        before, edges = edges, written(_stars(_stars(edges, True), False))
        discard(before)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
