"""The trie of conversations' prefixes, from ternary search trees over dictionary-encoded turns.

1. `sequences`: turns are told by digests of role and text, a dictionary numbers the distinct ones, and a task
   reads its conversations in order of turns; texts themselves are never shuffled.
2. `distinct`: equal sequences become one, with the number, the least id and the digest of the ids that have it.
   A task streams sorted ids through SHA-256, which goes in order by its nature: a sequence that a third of all
   conversations share costs one task that time (8 bytes an id), and no memory.
3. `nodes`: distinct sequences are dealt out by ranges, in order. A task cuts its range into shards of at most
   SHARD turns and builds a ternary search tree for each: medians first, so siblings stand in balanced trees.
   One pass over the nodes, children before parents, adds up members, leaves and savings. Only prefixes of a
   shard's first or last sequence can go on in another shard: these two paths leave the task as partial sums, and
   are merged in order with one path in memory, by first turn; the root comes from sums of all.

Defined results. Rows without conv_id take no part. Turns that share a number are ordered by their digests;
repeated rows stay. Null roles and texts are empty, so a null one and an empty one are the same turn. Extra
columns aren't read. An empty table gives no rows, for the root has no member. Texts of any length are digested
whole; a conversation of any length is an array of 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Turns of a shard; a longer conversation is a shard of its own.
SHARD = 500_000
NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = "kind string, conv_id long, depth long, parent_conv_id long, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PATH = "ids array<long>, marks array<binary>, sizes array<long>, members array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>"
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _chunks(batches: Iterator[pa.RecordBatch], limit: int = 2000) -> Iterator[list[tuple]]:
    for batch in batches:
        for i in range(0, len(batch), limit):
            part = batch.slice(i, limit)
            yield list(zip(*(c.to_pylist() for c in part.columns), strict=True))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): the numbers and the code points of each conversation's turns, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn"), told.alias("digest"), F.length(text).cast("long").alias("size"))
    numbered = written(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()))

    def run(batches):
        own, ids, sizes, done = None, [], [], []
        for batch in batches:
            keys, new, long = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and keys[a] != own:
                    if own is not None:
                        done.append((own, np.concatenate(ids), np.concatenate(sizes)))
                    own, ids, sizes = int(keys[a]), [], []
                ids.append(new[a:b].copy())
                sizes.append(long[a:b].copy())
            if len(done) >= 1000:
                yield _batch(done, "conv_id long, ids array<long>, sizes array<long>")
                done = []
        if own is not None:
            done.append((own, np.concatenate(ids), np.concatenate(sizes)))
        yield _batch(done, "conv_id long, ids array<long>, sizes array<long>")

    dealt = turns.join(numbered, "digest").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    return dealt.select("conv_id", "id", "size").mapInArrow(run, "conv_id long, ids array<long>, sizes array<long>")


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations whose first h turns are those of the one at the start of their hundred; h is crc32(decimal conv_id) % 6."""
    heads = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("ids", 1, 5).alias("head"), F.slice("sizes", 1, 5).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")

    def spliced(head: str, rest: str) -> Column:
        first = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast("array<long>"))
        return F.concat(first, F.slice(rest, F.col("h") + 1, F.greatest(F.lit(1), F.size(rest))))

    joined = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": h}).join(heads, "base", "left")
    return joined.select("conv_id", spliced("head", "ids").alias("ids"), spliced("head_sizes", "sizes").alias("sizes"))


def distinct(seqs: DataFrame) -> DataFrame:
    """(ids, sizes, n, conv_id, ends): each sequence once, with its conversations' number, least id and digest of ids."""
    told = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    schema = "ids array<long>, sizes array<long>, n long, conv_id long, ends string"

    def run(batches):
        own, row, n, least, digest = None, None, 0, 0, None
        for rows in _chunks(batches):
            done = []
            for key, conv, ids, sizes in rows:
                if key != own:
                    if own is not None:
                        done.append((*row, n, least, digest.hexdigest()))
                    own, row, n, least, digest = key, (ids, sizes), 0, conv, hashlib.sha256()
                digest.update(f"{',' * (n > 0)}{conv}".encode())
                n += 1
            yield _batch(done, schema)
        if own is not None:
            yield _batch([(*row, n, least, digest.hexdigest())], schema)

    keyed = seqs.withColumn("key", told).repartition("key").sortWithinPartitions("key", "conv_id")
    return keyed.select("key", "conv_id", "ids", "sizes").mapInArrow(run, schema)


class Tree:
    """A ternary search tree over sequences of numbers: node i has a turn, siblings below and above it, and children.

    `up` is the trie parent's node (-1: the root), `n` and `least` are the members' number and least id.
    """

    def __init__(self, rows: list[tuple]):
        self.turn, self.below, self.above, self.first, self.up = [], [], [], [], []
        self.size, self.depth, self.n, self.least, self.ends = [], [], [], [], []
        self.top = -1
        spans = [(0, len(rows))]
        while spans:  # medians first
            lo, hi = spans.pop()
            if lo < hi:
                mid = (lo + hi) // 2
                self._insert(*rows[mid])
                spans += [(mid + 1, hi), (lo, mid)]
        self._sum()

    def _node(self, turn: int, size: int, up: int, depth: int) -> int:
        for column, value in ((self.turn, turn), (self.below, -1), (self.above, -1), (self.first, -1), (self.up, up), (self.size, size), (self.depth, depth), (self.n, 0), (self.least, None), (self.ends, None)):
            column.append(value)
        return len(self.turn) - 1

    def _insert(self, ids: list[int], sizes: list[int], n: int, conv: int, ends: str) -> None:
        up = -1
        for depth, (turn, size) in enumerate(zip(ids, sizes, strict=True), 1):
            at, side, last = self.top if up < 0 else self.first[up], None, up
            while at >= 0 and self.turn[at] != turn:
                side, last = (self.below if turn < self.turn[at] else self.above), at
                at = side[at]
            if at < 0:
                at = self._node(turn, size, up, depth)
                if side is not None:
                    side[last] = at
                elif up < 0:
                    self.top = at
                else:
                    self.first[up] = at
            self.n[at] += n
            self.least[at] = conv if self.least[at] is None else min(conv, self.least[at])
            up = at
        if up >= 0:
            self.ends[up] = ends

    def path(self, ids: list[int]) -> list[int]:
        """The nodes of a sequence that is in the tree."""
        found, at = [], self.top
        for turn in ids:
            while self.turn[at] != turn:
                at = self.below[at] if turn < self.turn[at] else self.above[at]
            found.append(at)
            at = self.first[at]
        return found

    def _sum(self) -> None:
        """Children, leaves and savings of each node; a parent's number is smaller than its children's."""
        m = len(self.turn)
        self.children, self.leaves, self.saved = [0] * m, [0] * m, [0] * m
        for i in range(m - 1, -1, -1):
            if not self.children[i]:
                self.leaves[i] = 1
            self.saved[i] += (self.n[i] - 1) * self.size[i]
            up = self.up[i]
            if up >= 0:
                self.children[up] += 1
                self.leaves[up] += self.leaves[i]
                self.saved[up] += self.saved[i]


def _marks(ids: list[int]) -> list[bytes]:
    """A digest of each prefix of a path."""
    digest, out = hashlib.sha256(), []
    for turn in ids:
        digest.update(turn.to_bytes(8, "little", signed=True))
        out.append(digest.copy().digest())
    return out


def _shard(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Rows of inner nodes, and of the two edge paths, of a shard of sorted distinct sequences."""
    tree = Tree(rows)
    firsts, lasts = tree.path(rows[0][0]), tree.path(rows[-1][0])
    edge, marks = set(firsts) | set(lasts), {}
    paths = [(rows[0][0], firsts)] + ([(rows[-1][0], lasts)] if len(rows) > 1 else [])
    for ids, path in paths:
        marks.update(zip(path, _marks(ids), strict=True))
    # what lies below an edge node, without other edge nodes and what lies below them
    children, leaves, saved = ({i: 0 for i in edge} for _ in range(3))
    out = []
    for i, up in enumerate(tree.up):
        if i in edge:
            continue
        parent, mark = (tree.least[up], None) if up >= 0 and up not in edge else (None, marks[up] if up >= 0 else b"")
        out.append(("node", tree.least[i], tree.depth[i], parent, mark, tree.n[i], tree.children[i], tree.leaves[i], tree.saved[i], tree.ends[i] or NOTHING))
        if up in edge:
            children[up] += 1
            leaves[up] += tree.leaves[i]
            saved[up] += tree.saved[i]
    told, found = set(), []
    for ids, path in paths:
        own = [i not in told for i in path]  # shared nodes are told once, in the first path
        part = lambda values: [values[i] if mine else 0 for i, mine in zip(path, own, strict=True)]
        least = [tree.least[i] if mine else None for i, mine in zip(path, own, strict=True)]
        ends = [tree.ends[i] if mine else None for i, mine in zip(path, own, strict=True)]
        found.append((ids, [marks[i] for i in path], [tree.size[i] for i in path], part(tree.n), least, part(children), part(leaves), part(saved), ends))
        told |= set(path)
    return out, found


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge paths in order of their sequences: equal prefixes are added up, with one path in memory."""
    stack: list[list] = []  # turn, mark, size, members, least, children, leaves, saved, ends
    done: list[tuple] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            _, mark, size, n, least, children, leaves, saved, ends = stack.pop()
            leaves, saved = leaves or int(not children), saved + (n - 1) * size
            done.append(("edge", least, len(stack) + 1, mark, stack[-1][1] if stack else b"", n, children, leaves, saved, ends or NOTHING))
            if stack:
                stack[-1][5] += 1
                stack[-1][6] += leaves
                stack[-1][7] += saved

    schema = "kind string, conv_id long, depth long, mark binary, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    for rows in _chunks(batches, 100):
        for ids, marks, sizes, *parts in rows:
            same = 0
            while same < min(len(stack), len(ids)) and stack[same][0] == ids[same]:
                same += 1
            close(same)
            for d, (n, least, children, leaves, saved, ends) in enumerate(zip(*parts, strict=True)):
                if d == len(stack):
                    stack.append([ids[d], marks[d], sizes[d], 0, least, 0, 0, 0, None])
                at = stack[d]
                at[3] += n
                at[4] = least if at[4] is None else at[4] if least is None else min(least, at[4])
                at[5], at[6], at[7], at[8] = at[5] + children, at[6] + leaves, at[7] + saved, ends or at[8]
        yield _batch(done, schema)
        done.clear()
    close(0)
    yield _batch(done, schema)


def nodes(seqs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The trie's nodes of sequences (conv_id, ids, sizes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    each = written(distinct(seqs))
    spark = seqs.sparkSession
    schema = f"{_NODE}, {_PATH}"
    width, bare = len(_PATH.split(", ")), len(_NODE.split(", "))

    def run(batches):
        rows, turns = [], 0

        def cut():
            inner, paths = _shard(rows)
            told = [(*r, *(None,) * width) for r in inner] + [("path", *(None,) * (bare - 1), *p) for p in paths]
            for i in range(0, len(told), 5000):
                yield _batch(told[i : i + 5000], schema)

        for part in _chunks(batches):
            for row in part:
                if rows and turns + len(row[0]) > shard:
                    yield from cut()
                    rows, turns = [], 0
                rows.append(row)
                turns += len(row[0])
        if rows:
            yield from cut()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = each.filter("size(ids) > 0").repartitionByRange(parts, "ids").sortWithinPartitions("ids")
    found = written(ranged.mapInArrow(run, schema))
    paths = found.filter("kind = 'path'").select(*(x.split()[0] for x in _PATH.split(", ")))
    edge = "kind string, conv_id long, depth long, mark binary, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    edges = written(paths.repartition(F.col("ids")[0]).sortWithinPartitions("ids").mapInArrow(_merged, edge))

    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = found.filter("kind = 'node'").select("conv_id", "depth", "parent_conv_id", "parent", *sums)
    own = edges.select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "parent", *sums)
    tops = inner.unionByName(own).filter("depth = 1")
    # the root, from sums of what stands at it and right below it
    zero, none = F.lit(0).cast("long"), F.lit(None)
    at = each.select("conv_id", F.col("n").alias("n_convs"), F.when(F.size("ids") == 0, F.col("ends")).alias("ends"), zero.alias("n_children"), none.cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    under = tops.select(none.cast("long").alias("conv_id"), zero.alias("n_convs"), none.cast("string").alias("ends"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    summed = at.unionByName(under).agg(F.min("conv_id").alias("conv_id"), *(F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends")).filter("conv_id is not null")
    root = summed.select("conv_id", zero.alias("depth"), none.cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
    # parents on edge paths, and the root, have their least member only now
    named = edges.select(F.col("mark").alias("parent"), F.col("conv_id").alias("named")).unionByName(summed.select(F.lit(b"").alias("parent"), F.col("conv_id").alias("named")))
    below = inner.unionByName(own).filter("parent is not null").join(named, "parent").select("conv_id", "depth", F.col("named").alias("parent_conv_id"), *sums)
    deep = inner.filter("parent is null").select("conv_id", "depth", "parent_conv_id", *sums)
    return deep.unionByName(below).unionByName(root)
