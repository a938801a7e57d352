"""Hard negatives by a multiway hyperplane tree (GNAT): rows that a window of scores below a positive holds.

Scores are inner products of whole numbers. Every vector gets one more coordinate that lifts all rows to one norm
M (an anchor's is 0), so d(q, x)^2 = |q|^2 + M^2 - 2 score: a window of scores is an annulus around the anchor.

* The top of the tree has SPLITS split points, fitted on at most `sample` rows; each row belongs to the nearest
  one's cell, and each pair of a split point and a cell has the range of their distances. A cell is cut by a hash
  of ids into shards of about SHARD rows, so a cell that holds a third of all rows costs many tasks.
* A task reads the rows of a shard, grows its part of the tree (split points far from each other, ranges of
  distances to sibling subtrees, leaves of LEAF rows), and then streams the anchors' questions past it in blocks.
  A subtree is passed over if the annulus, around the split point, misses its range. Leaves are exact.
* `partners` asks three times: for positives in the anchor's own cell, then, with the scores found, in the cells
  that can still hold better ones, then for negatives in the cells that each window can reach.

Rows move once a pass, to their shard; a question moves to the shards of the cells that its annulus meets.
Defined results. Rows with a null id, label or vector, or any null or non-finite component, take no part. Of rows
that share an id the one with the least label and vector takes part. Vectors meet only those of their length.
Ties go to the smaller id. Scores are exact: whole numbers beyond 2^53 are multiplied as Python integers, scores
beyond 2^62 count as 2^62, and rows with a component of 2^23 or more (2^31 after the factor of 256) take no part.
An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPLITS, LEAF, SHARD, SAMPLE = 16, 128, 8192, 4096
#: Questions that pass a tree together.
BLOCK = 1024
#: Relative slack of squared radii against rounding; leaves decide exactly.
SLACK = 1e-9
NONE = -(1 << 62)


def usable(table: DataFrame, relabel_every: int = 7) -> DataFrame:
    """(id, label, v): rows that take part, with labels of every 7th id moved on by one and components as floor(256 x)."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < 2.0**23), F.lit(False)))
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.filter(fine).select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda e: F.floor(256 * e.cast("double")).cast("double")).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _lift(v: np.ndarray, norm2: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(0.0, norm2 - (v * v).sum(1)))[:, None]], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def _scattered(points: np.ndarray, k: int) -> np.ndarray:
    """At most k of the points, each as far as can be from those before it; equal points count once."""
    chosen, near = [0], _distances(points, points[:1])[:, 0]
    while len(chosen) < k and near.max() > 1e-6 * (1 + np.abs(points[0]).max()):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(points, points[chosen[-1]][None])[:, 0])
    return points[chosen]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as long (or Python integers, where they may pass 2^53)."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    return np.clip(exact, NONE + 1, -NONE - 1).astype(np.int64)


class Questions:
    """A block of questions: vectors, labels, windows of scores, and the best `k` rows found so far of each."""

    def __init__(self, ids, labels, vectors, low, high, same, k: int, norm2: float):
        self.ids, self.labels, self.v, self.low, self.high, self.same, self.k, self.norm2 = ids, labels, vectors, low.copy(), high, same, k, norm2
        self.own = (vectors * vectors).sum(1)
        self.scale = float(np.sqrt(norm2 + self.own.max(initial=0)))
        self.lifted = np.concatenate([vectors, np.zeros((len(ids), 1))], 1)
        self.score, self.found = np.full((len(ids), k), NONE, np.int64), np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)

    def annulus(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that still counts, with slack."""
        low = np.maximum(self.low[at], self.score[at, -1]).astype(float)
        base = self.own[at] + self.norm2
        slack = SLACK * (1 + base)
        return np.sqrt(np.maximum(0, base - 2 * self.high[at].astype(float) - slack)), np.sqrt(np.maximum(0, base - 2 * low + slack))

    def meet(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        """The questions `at` see the rows of a leaf, which are in order of ids."""
        score = _products(self.v[at], v)
        fine = (self.ids[at][:, None] != ids[None]) & ((self.labels[at][:, None] == labels[None]) == self.same)
        fine &= (score >= np.maximum(self.low[at], self.score[at, -1])[:, None]) & (score <= self.high[at][:, None])
        some = fine.any(1)
        if not some.any():
            return
        at, score, fine = at[some], score[some], fine[some]
        score = np.where(fine, score, NONE)
        first = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        new = np.take_along_axis(score, first, 1)
        scores = np.concatenate([self.score[at], new], 1)
        found = np.concatenate([self.found[at], np.where(new > NONE, ids[first], np.iinfo(np.int64).max)], 1)
        by_id = np.argsort(found, axis=1, kind="stable")
        scores, found = np.take_along_axis(scores, by_id, 1), np.take_along_axis(found, by_id, 1)
        best = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        self.score[at], self.found[at] = np.take_along_axis(scores, best, 1), np.take_along_axis(found, best, 1)


class Tree:
    """The part of the tree over one shard's rows. Rows that are equal in label and vector stand in one entry of a leaf,
    with their first `keep` ids: no question wants more of them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, norm2: float, keep: int):
        order = np.argsort(ids, kind="stable")
        alike = pd.DataFrame(np.column_stack([labels[order], v[order]])).groupby(list(range(v.shape[1] + 1)), sort=False).cumcount().to_numpy()
        order = order[alike < keep]
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        self.lifted = _lift(self.v, norm2)
        self.root = self._grow(np.arange(len(order)))

    def _grow(self, rows: np.ndarray):
        """A leaf (array of rows), or (split points, the subtrees' own ones, least and greatest distance by point and subtree, subtrees)."""
        if len(rows) <= LEAF:
            return rows
        points = _scattered(self.lifted[rows[np.linspace(0, len(rows) - 1, min(len(rows), 3 * SPLITS)).astype(int)]], SPLITS)
        far = _distances(self.lifted[rows], points)
        side = far.argmin(1)
        used, sizes = np.unique(side, return_counts=True)
        if sizes.max() > 0.9 * len(rows):  # nothing to gain: exact, whatever its size
            return rows
        least = np.array([[far[side == j, i].min() for j in used] for i in range(len(points))])
        most = np.array([[far[side == j, i].max() for j in used] for i in range(len(points))])
        return points, used, least, most, [self._grow(rows[side == j]) for j in used]

    def ask(self, q: Questions) -> None:
        stack = [(self.root, np.arange(len(q.ids)), None)]
        while stack:
            node, at, bound = stack.pop()
            if bound is not None:  # windows may have narrowed since
                inner, outer = q.annulus(at)
                at = at[_reach(bound[0], inner, outer, bound[1], bound[2], q.scale)]
            if not len(at):
                continue
            if isinstance(node, np.ndarray):
                q.meet(at, self.ids[node], self.labels[node], self.v[node])
                continue
            points, used, least, most, below = node
            far = _distances(q.lifted[at], points)
            inner, outer = q.annulus(at)
            asked = [_reach(far, inner, outer, least[:, j], most[:, j], q.scale) for j in range(len(below))]
            own = np.array([far[m, i].mean() if m.any() else np.inf for m, i in zip(asked, used, strict=True)])
            for j in np.argsort(-own, kind="stable"):  # the nearest is taken first
                if asked[j].any():
                    stack.append((below[j], at[asked[j]], (far[asked[j]], least[:, j], most[:, j])))


def _reach(far: np.ndarray, inner: np.ndarray, outer: np.ndarray, least: np.ndarray, most: np.ndarray, scale: float) -> np.ndarray:
    """Questions whose annulus can meet a subtree: around each split point, the distances that it leaves meet the subtree's range.

    Small distances are differences of large squares, so the slack goes by the vectors' norm (`scale`).
    """
    slack = 4e-6 * (1 + scale)
    nearest = np.maximum(far - outer[:, None], inner[:, None] - far) - slack
    return ((nearest <= most[None]) & (far + outer[:, None] + slack >= least[None])).all(1)


class Top:
    """The split points of the top, and the ranges of distances from each to the rows of each cell, by length of vectors."""

    def __init__(self, parts: dict[int, tuple[float, np.ndarray]]):
        self.parts, self.least, self.most, self.shards = parts, {}, {}, {}

    def cells(self, vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
        norm2, points = self.parts[dims]
        far = _distances(_lift(np.array(vectors, float).reshape(len(vectors), dims), norm2), points)
        return far.argmin(1), far


def _by_length(vectors: list) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(v) for v in vectors])
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def index(rows: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Top]:
    """Rows (id, label, v) with cell and shard, as a written table, and the top of the tree.

    The driver gets sums by length, at most about 2 `sample` rows, and the top's ranges; split points are the
    sample's, every row is indexed.
    """
    rows = written(rows.withColumn("dims", F.size("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    sums = rows.groupBy("dims").agg(F.max(norm).alias("norm2"), F.count(F.lit(1)).alias("n")).collect()
    total = sum(r.n for r in sums)
    rate = max(1, -(-total // sample))
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0).select("dims", "v").collect()
    parts = {}
    for r in sums:
        own = [p.v for p in picked if p.dims == r.dims] or [[0.0] * r.dims]
        parts[r.dims] = (r.norm2 or 0.0, _scattered(_lift(np.array(own, float).reshape(len(own), r.dims), r.norm2 or 0.0), SPLITS))
    top = Top(parts)

    def assigned(batches):
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            cell, least = np.zeros(len(vectors), np.int64), [None] * len(vectors)
            for dims, at in _by_length(vectors):
                cell[at], far = top.cells([vectors[i] for i in at], dims)
                for i, f in zip(at, far, strict=True):
                    least[i] = f
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(least, pa.list_(pa.float64()))], [*batch.schema.names, "cell", "far"])

    placed = written(rows.mapInArrow(assigned, "id long, label long, v array<double>, dims int, cell long, far array<double>"))
    sizes = placed.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("n"), *(F.array(*(f(F.get("far", F.lit(i))) for i in range(SPLITS))).alias(name) for name, f in (("least", F.min), ("most", F.max)))).collect()
    for dims, (_, points) in parts.items():
        own = {r.cell: r for r in sizes if r.dims == dims}
        top.least[dims] = {c: np.array(r.least[: len(points)], float) for c, r in own.items()}
        top.most[dims] = {c: np.array(r.most[: len(points)], float) for c, r in own.items()}
    shards = top.shards = {(r.dims, r.cell): -(-r.n // SHARD) for r in sizes}
    known = F.create_map(*(F.lit(x) for (dims, cell), n in shards.items() for x in (f"{dims}/{cell}", n))) if shards else F.lit(None).cast("map<string,int>")
    number = F.pmod(F.xxhash64("id"), F.element_at(known, F.concat_ws("/", "dims", "cell")))
    return placed.withColumn("shard", number.cast("long")).drop("far"), top


_ASK = "ask long, other long, label long, v array<double>, dims int, low long, high long, cell long, shard long"


def _routed(asks: DataFrame, top: Top, same: bool, home: bool | None) -> DataFrame:
    """Questions (ask, other, label, v, low, high), each once for every shard of each cell that its annulus meets.

    home: only the cell of the anchor itself, or all others, or None for all.
    """

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for dims, at in _by_length([r["v"] for r in rows]):
                own, far = top.cells([rows[i]["v"] for i in at], dims)
                norm2, points = top.parts[dims]
                v = np.array([rows[i]["v"] for i in at], float).reshape(len(at), dims)
                q = Questions(np.array([rows[i]["ask"] for i in at]), np.array([rows[i]["label"] for i in at]), v, np.array([rows[i]["low"] for i in at]), np.array([rows[i]["high"] for i in at]), same, 1, norm2)
                everyone = np.arange(len(at))
                inner, outer = q.annulus(everyone)
                far = _distances(q.lifted, points)
                for cell, least in top.least[dims].items():
                    asked = _reach(far, inner, outer, least, top.most[dims][cell], q.scale)
                    if home is not None:
                        asked = own == cell if home else asked & (own != cell)
                    out += [(*(rows[at[i]][k] for k in ("ask", "other", "label", "v")), dims, rows[at[i]]["low"], rows[at[i]]["high"], cell, s) for i in np.flatnonzero(asked) for s in range(top.shards[dims, cell])]
            for i in range(0, len(out), 5000):
                part = list(zip(*out[i : i + 5000], strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), *[pa.int64()] * 4), strict=True)], [x.split()[0] for x in _ASK.split(", ")])

    return asks.select("ask", "other", "label", "v", "low", "high").mapInArrow(run, _ASK)


def _answered(placed: DataFrame, asks: DataFrame, top: Top, same: bool, k: int) -> DataFrame:
    """(ask, other, id, score): the first k rows of each shard for each question that came to it."""
    data = placed.select("dims", "cell", "shard", F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("other"), "label", "v", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    questions = asks.select("dims", "cell", "shard", F.lit(1).alias("kind"), F.col("ask").alias("id"), "other", "label", "v", "low", "high")
    parts = {dims: norm2 for dims, (norm2, _) in top.parts.items()}

    def run(batches):
        key, rows, tree = None, [], None

        def answers(block):
            nonlocal tree, rows
            if tree is None and rows:
                ids, labels, v = (np.concatenate(x) for x in zip(*rows, strict=True))
                tree, rows = Tree(ids, labels, v, parts[key[0]], k + 1), []
            if tree is None:
                return
            whole = block.to_pydict()
            n = len(block)
            q = Questions(*(np.array(whole[c], np.int64) for c in ("id", "label")), np.array(whole["v"], float).reshape(n, key[0]), *(np.array(whole[c], np.int64) for c in ("low", "high")), same, k, parts[key[0]])
            tree.ask(q)
            at, rank = np.nonzero(q.score > NONE)
            yield pa.record_batch([pa.array(q.ids[at]), pa.array(np.array(whole["other"], np.int64)[at]), pa.array(q.found[at, rank]), pa.array(q.score[at, rank])], ["ask", "other", "id", "score"])

        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key != tuple(keys[a, :3].tolist()):
                    key, rows, tree = tuple(keys[a, :3].tolist()), [], None
                part = batch.slice(a, b - a)
                if keys[a, 3] == 0:
                    v = np.array(part.column("v").to_pylist(), float).reshape(b - a, key[0])
                    rows.append((part.column("id").to_numpy(), part.column("label").to_numpy(), v))
                else:
                    for i in range(0, b - a, BLOCK):
                        yield from answers(part.slice(i, BLOCK))

    dealt = data.unionByName(questions).repartition("dims", "cell", "shard").sortWithinPartitions("dims", "cell", "shard", "kind")
    return dealt.mapInArrow(run, "ask long, other long, id long, score long")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80) -> DataFrame:
    """For each anchor (rows where `anchors` holds) and each of its first positives, the first rows of other labels in the window.

    Of (id, label, v), as `usable` gives. Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    placed, top = index(rows)
    asked = placed.filter(anchors).select(F.col("id").alias("ask"), F.lit(0).cast("long").alias("other"), "label", "v")
    open_ended = asked.withColumns({"low": F.lit(NONE), "high": F.lit(-NONE)})
    near = written(_answered(placed, _routed(open_ended, top, True, True), top, True, positives))
    # only rows that score as much as the last of a full first list can still count
    bound = _bounds(near, positives)
    wider = open_ended.join(bound, "ask", "left").withColumn("low", F.coalesce("bound", "low")).drop("bound")
    rest = _answered(placed, _routed(wider, top, True, False), top, True, positives)
    chosen = written(_first(near.unionByName(rest), ["ask"], positives).select("ask", F.col("id").alias("other"), F.col("score").alias("positive_score")))
    # 80 p <= 100 n <= 100 p: none for a positive below zero
    p = F.col("positive_score")
    windows = asked.drop("other").join(chosen.filter(p >= 0), "ask").withColumns({"low": F.ceil(p.cast("decimal(20,0)") * low_percent / 100).cast("long"), "high": p})
    found = _answered(placed, _routed(windows, top, False, None), top, False, negatives)
    best = _first(found, ["ask", "other"], negatives).join(chosen, ["ask", "other"])
    return best.select(F.col("ask").alias("anchor_id"), F.col("other").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _bounds(near: DataFrame, k: int) -> DataFrame:
    """(ask, bound): the k-th score of those that have so many."""
    return _first(near, ["ask"], k).filter(F.col("rank") == k).select("ask", F.col("score").alias("bound"))
