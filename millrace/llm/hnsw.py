"""Embedding near-dedup with hierarchical navigable small-world graphs, one for each shard.

Vectors of one label are dealt to shards of bounded size, and each shard's graph is built by inserting
its vectors. Every vector then queries every shard of its label (a pair of shards meets once, links
being mutual), in blocks: a beam search, then all neighbours of vectors near the limit. Every query is audited: the
number of its links is told exactly by a product of the block with the shard, and while one is missing the query is
asked again with a beam twice as wide, which opens in waves over the graph's links in both directions, in the end as
wide as the shard. Links are verified by cosine in double
precision, and their components joined.

Defined results: vectors that are null, zero, without label, or hold null or non-finite components link
with nothing; neither do vectors of different lengths. Equal vectors of a label are one member of the
graph, and count as often as they occur. Rows that share an id are one vector, the largest in order.
A row whose id is null has no links and a null component. Extra columns, of whatever names, are left out.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected

COSINE = 0.93
#: Vectors in a shard, links of a vector (twice as many on the ground level), beams.
SHARD, LINKS, BUILD_BEAM, QUERY_BEAM = 8192, 12, 40, 32
#: Queries in a block, tasks that a pair of shards is dealt to, shards whose blocks meet a graph in one task.
BLOCK, PARTS, GATHER = 512, 2, 8
#: The search goes on from all vectors this near to the limit; what single precision may be off.
SLACK, OFF = 0.06, 1e-5


class Graph:
    """A navigable small-world graph over unit vectors."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = x
        n = len(x)
        self.level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 8)
        self.links: list[np.ndarray] = [np.full((n, 2 * LINKS if level == 0 else LINKS), -1, np.int32) for level in range(int(self.level.max(initial=0)) + 1)]
        self.count = [np.zeros(n, np.int32) for _ in self.links]
        self.seen, self.turn, self.entry, self.top = np.zeros(n, np.int64), 0, 0, int(self.level[0]) if n else 0
        for i in range(1, n):
            self._insert(i)

    def _spread(self, near: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Of ids from near to far, those nearer to the centre than to any taken before, then the nearest rest."""
        if len(ids) <= most:
            return ids
        among = self.x[ids] @ self.x[ids].T
        taken: list[int] = []
        reach = np.full(len(ids), -2.0)
        for j in range(len(ids)):
            if reach[j] < near[j]:
                taken.append(j)
                if len(taken) == most:
                    break
                np.maximum(reach, among[j], out=reach)
        if len(taken) < most:
            left = np.ones(len(ids), bool)
            left[taken] = False
            taken += np.flatnonzero(left)[: most - len(taken)].tolist()
        return ids[taken]

    def beam(self, q: np.ndarray, entry: int, width: int, level: int) -> list[tuple[float, int]]:
        """(nearness, vector) of the best `width` found."""
        self.turn += 1
        links, count, seen, turn = self.links[level], self.count[level], self.seen, self.turn
        near = float(self.x[entry] @ q)
        seen[entry] = turn
        todo, best = [(-near, entry)], [(near, entry)]
        while todo:
            near, at = heapq.heappop(todo)
            if len(best) >= width and -near < best[0][0]:
                break
            beside = links[at, : count[at]]
            beside = beside[seen[beside] != turn]
            if not len(beside):
                continue
            seen[beside] = turn
            for s, i in zip((self.x[beside] @ q).tolist(), beside.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, i))
                    heapq.heappush(todo, (-s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                    heapq.heappush(todo, (-s, i))
        return best

    def down(self, q: np.ndarray, to: int) -> int:
        """The vector that greedy steps reach from the top, on the level above `to`."""
        at, near = self.entry, float(self.x[self.entry] @ q)
        for level in range(self.top, to, -1):
            while True:
                beside = self.links[level][at, : self.count[level][at]]
                if not len(beside):
                    break
                s = self.x[beside] @ q
                j = int(s.argmax())
                if s[j] <= near:
                    break
                at, near = int(beside[j]), float(s[j])
        return at

    def _insert(self, i: int) -> None:
        q, own = self.x[i], int(self.level[i])
        at = self.down(q, own)
        for level in range(min(own, self.top), -1, -1):
            found = sorted(self.beam(q, at, BUILD_BEAM, level), reverse=True)
            at = found[0][1]
            chosen = self._spread(np.array([s for s, _ in found]), np.array([j for _, j in found]), LINKS)
            self.links[level][i, : len(chosen)] = chosen
            self.count[level][i] = len(chosen)
            most = self.links[level].shape[1]
            for j in chosen.tolist():
                n = self.count[level][j]
                if n < most:
                    self.links[level][j, n] = i
                    self.count[level][j] += 1
                else:
                    ids = np.append(self.links[level][j], i)
                    near = self.x[ids] @ self.x[j]
                    order = np.argsort(-near, kind="stable")
                    self.links[level][j] = self._spread(near[order], ids[order], most)
        if own > self.top:
            self.entry, self.top = i, own

    def saved(self) -> dict[str, bytes]:
        """The graph as arrays, to be stored; `load` makes it again."""
        return {"x": self.x.tobytes(), "links": b"".join(level.tobytes() for level in self.links), "levels": len(self.links), "entry": self.entry}

    @staticmethod
    def load(x: bytes, links: bytes, levels: int, entry: int, n: int) -> Graph:
        """A stored graph, for queries only."""
        out = Graph.__new__(Graph)
        out.x = np.frombuffer(x).reshape(n, -1)
        flat, at, out.links = np.frombuffer(links, np.int32), 0, []
        for level in range(levels):
            width = LINKS if level else 2 * LINKS
            out.links.append(flat[at : at + n * width].reshape(n, width))
            at += n * width
        out.entry, out.small = entry, out.x.astype(np.float32)
        near, far = np.nonzero(out.links[0] >= 0)
        ends = out.links[0][near, far]
        out.into, out.into_ends = near[np.argsort(ends, kind="stable")], np.cumsum(np.bincount(ends, minlength=n))
        return out

    def _beside(self, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
        """row * n + neighbour, distinct, for each (row, node); links lead both ways."""
        n = len(self.x)
        out = self.links[0][node]
        there = np.where(out >= 0, rows[:, None] * n + out, -1).ravel()
        many = self.into_ends[node] - np.where(node > 0, self.into_ends[node - 1], 0)
        skip = np.repeat(self.into_ends[node] - np.cumsum(many), many)
        back = np.repeat(rows, many) * n + self.into[skip + np.arange(len(skip))]
        return np.unique(np.concatenate([there[there >= 0], back]))

    def _nearness(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """[m, k] inner products of the rows of q with vectors ids [m, k]; below all others where an id is -1."""
        return np.where(ids >= 0, np.einsum("mkd,md->mk", self.small[ids], q), np.float32(-9))

    def within(self, q: np.ndarray, width: int, limit: float, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, vector): pairs found at least as near as `limit`, for all rows of q side by side, from the vectors `at` or from the top."""
        if width >= len(self.x):
            return np.nonzero(q @ self.x.T >= limit)
        exact, q = q, q.astype(np.float32)
        m, n = len(q), len(self.x)
        every, known = np.arange(m), at is not None
        at = at if known else np.full(m, self.entry)
        near = self._nearness(at[:, None], q)[:, 0]
        for links in [] if known else self.links[:0:-1]:
            while True:
                ids = links[at]
                s = self._nearness(ids, q)
                j = s.argmax(1)
                better = s[every, j] > near
                if not better.any():
                    break
                at, near = np.where(better, ids[every, j], at), np.where(better, s[every, j], near)

        ground, seen, opened = self.links[0], np.zeros((m, n), bool), np.zeros((m, n), bool)
        seen[every, at] = True
        ids, score, done = np.full((m, width), -1), np.full((m, width), -9, np.float32), np.ones((m, width), bool)
        ids[:, 0], score[:, 0], done[:, 0] = at, near, False
        strong = [(every[near >= limit - SLACK], at[near >= limit - SLACK], near[near >= limit - SLACK])]

        def fresh(rows: np.ndarray, beside: np.ndarray) -> np.ndarray:
            """Neighbours that a row has not seen; the others become -1."""
            beside = np.where((beside >= 0) & ~seen[rows[:, None], beside], beside, -1)
            r, k = np.nonzero(beside >= 0)
            seen[rows[r], beside[r, k]] = True
            return beside

        rows = every
        while len(rows):
            left = np.where(done[rows], np.float32(-9), score[rows])
            j = left.argmax(1)
            live = left[np.arange(len(rows)), j] > -9
            rows, j = rows[live], j[live]
            if not len(rows):
                break
            node = ids[rows, j]
            done[rows, j] = True
            opened[rows, node] = True
            beside = fresh(rows, ground[node])
            s = self._nearness(beside, q[rows])
            r, k = np.nonzero(s >= limit - SLACK)
            strong.append((rows[r], beside[r, k], s[r, k]))
            all_ids, all_s = np.concatenate([ids[rows], beside], 1), np.concatenate([score[rows], s], 1)
            all_done = np.concatenate([done[rows], beside < 0], 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            ids[rows], score[rows], done[rows] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_s, all_done))

        # all neighbours of what is near the limit, wave by wave
        at = 0
        while at < len(strong):
            rows, node, _ = strong[at]
            at += 1
            todo = ~opened[rows, node]
            rows, node = rows[todo], node[todo]
            opened[rows, node] = True
            for start in range(0, len(rows), 4096):
                flat = self._beside(rows[start : start + 4096], node[start : start + 4096])
                flat = flat[~seen.reshape(-1)[flat]]
                seen.reshape(-1)[flat] = True
                order = np.divmod(flat, n)
                s = np.einsum("kd,kd->k", self.small[order[1]], q[order[0]])
                good = s >= limit - SLACK
                if good.any():
                    strong.append((order[0][good], order[1][good], s[good]))
        rows, node, s = (np.concatenate([x[i] for x in strong]) for i in range(3))
        close = s >= limit - OFF
        rows, node = rows[close], node[close]
        close = np.einsum("kd,kd->k", self.x[node], exact[rows]) >= limit
        return rows[close], node[close]

    def wider(self, q: np.ndarray, width: int, limit: float, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As `within`, for a wide beam: a wave opens all of a row's best `width` and all that is near the limit."""
        if width >= len(self.x):
            return np.nonzero(q @ self.x.T >= limit)
        single, m, n = q.astype(np.float32), len(q), len(self.x)
        at = np.full(m, self.entry) if at is None else at
        score, opened = np.full((m, n), -9, np.float32), np.zeros((m, n), bool)  # -9: not seen
        score[np.arange(m), at] = self._nearness(at[:, None], single)[:, 0]
        flat = score.reshape(-1)
        while True:
            least = np.minimum(np.partition(score, n - width, axis=1)[:, n - width], limit - SLACK)
            rows, node = np.nonzero((score >= np.maximum(least, -8)[:, None]) & ~opened)
            if not len(rows):
                break
            opened[rows, node] = True
            for start in range(0, len(rows), 4096):
                new = self._beside(rows[start : start + 4096], node[start : start + 4096])
                new = new[flat[new] == -9]
                r, i = np.divmod(new, n)
                flat[new] = np.einsum("kd,kd->k", self.small[i], single[r])
        rows, node = np.nonzero(score >= limit - OFF)
        close = np.einsum("kd,kd->k", self.x[node], q[rows]) >= limit
        return rows[close], node[close]


def links_of(graph: Graph, q: np.ndarray, limit: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of q, vector) within `limit`: each row with the narrowest beam that finds all of its links.

    own: where the rows of q stand in the graph themselves; their searches begin there.
    """
    truth = (q @ graph.x.T >= limit).sum(1)
    width, lacking = QUERY_BEAM, np.arange(len(q))
    rows, found = np.empty(0, np.int64), np.empty(0, np.int64)
    while len(lacking):
        search = graph.within if width == QUERY_BEAM else graph.wider
        r, f = search(q[lacking], width, limit, None if own is None else own[lacking])
        stay = ~np.isin(rows, lacking)
        rows, found = np.concatenate([rows[stay], lacking[r]]), np.concatenate([found[stay], f])
        if width >= len(graph.x):
            break
        lacking = lacking[np.bincount(rows, minlength=len(q))[lacking] < truth[lacking]]
        width *= 2
    return rows, found


_BUILT = "label string, shard long, start long, ids binary, n binary, x binary, links binary, levels int, entry int"


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's graph, and its vectors in blocks of queries."""
    pdf = pdf.sort_values("id", ignore_index=True)
    v = np.array(pdf["v"].tolist(), np.float64)
    # scaled by the largest component first: squares of huge or tiny ones stay finite and above zero
    v /= np.abs(v).max(axis=1, keepdims=True)
    graph = Graph(v / np.linalg.norm(v, axis=1, keepdims=True))
    ids, n = pdf["id"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    rows = [{"start": -1, "ids": ids.tobytes(), "n": n.tobytes()} | graph.saved()]
    for start in range(0, len(ids), BLOCK):
        end = start + BLOCK
        rows.append({"start": start, "ids": ids[start:end].tobytes(), "n": n[start:end].tobytes(), "x": graph.x[start:end].tobytes(), "links": None, "levels": 0, "entry": 0})
    return pd.DataFrame(rows).assign(label=pdf["label"].iloc[0], shard=pdf["shard"].iloc[0])[[part.split()[0] for part in _BUILT.split(", ")]]


def _linked(limit: float):
    """Rows (id, n, other): how many a vector links with in a shard, and links that join its components.

    A block's links to one connected group of the shard are told by one of them: the group is joined by
    links of its own, so nothing that a component needs is left out.
    """
    kinds = ["id", "n", "other"]

    def run(batches):
        at, graph, other_ids, other_n, group = None, None, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                key = (row["label"].as_py(), row["b"].as_py(), row["part"].as_py())
                ids, n = (np.frombuffer(row[k].as_buffer(), np.int64) for k in ("ids", "n"))
                start = row["start"].as_py()
                if start < 0:
                    at, other_ids, other_n, group = key, ids.copy(), n.copy(), np.arange(len(ids))
                    graph = Graph.load(row["x"].as_buffer().to_pybytes(), row["links"].as_buffer().to_pybytes(), row["levels"].as_py(), row["entry"].as_py(), len(ids))
                    continue
                if key != at or not len(ids):
                    continue
                same = key[1] == row["a"].as_py()
                q = np.frombuffer(row["x"].as_buffer()).reshape(len(ids), -1)
                rows, found = links_of(graph, q, limit, start + np.arange(len(ids)) if same else None)
                if same:
                    other = found != rows + start
                    rows, found = rows[other], found[other]
                order = np.argsort(rows, kind="stable")
                rows, found = rows[order], found[order]
                counts = np.bincount(rows, weights=other_n[found], minlength=len(ids)).astype(np.int64)
                out = [(int(ids[k]), int(counts[k]), None) for k in np.flatnonzero(counts)]
                if not same:
                    back = np.bincount(found, weights=n[rows], minlength=len(other_ids)).astype(np.int64)
                    out += [(int(other_ids[k]), int(back[k]), None) for k in np.flatnonzero(back)]
                cuts = np.flatnonzero(np.diff(rows)) + 1
                for k, near in zip(rows[np.concatenate([[0], cuts])] if len(rows) else [], np.split(found, cuts), strict=False):
                    # one link for each group not yet joined; within a shard the vector's own group is joined too
                    of, first = np.unique(group[near], return_index=True)
                    mine = group[start + k] if same else -1
                    new = [int(near[f]) for g, f in zip(of, first, strict=True) if g != mine]
                    out += [(int(ids[k]), 0, int(other_ids[j])) for j in new]
                    if same or len(of) > 1:
                        of = np.append(of, mine) if same else of
                        group[np.isin(group, of)] = of.min()
                yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], kinds)

    return run


def near_duplicates(vectors: DataFrame, limit: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id) of each row of `vectors`.

    A shard's graph is one row of arrays, of bounded size, and its vectors some rows of query blocks. The
    blocks of GATHER shards meet the graph of another in PARTS tasks, which hold one graph at a time and read
    block after block; ranges of the groups' names make the tasks alike in size. So a label with a third of
    all rows is many tasks. Only ids and counts are shuffled after that.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    part = rows.filter(fine & F.col("label").isNotNull() & F.col("id").isNotNull()).withColumn("label", F.concat_ws("/", "label", F.size("v")))
    part = part.groupBy("id").agg(F.max(F.struct("label", "v")).alias("s")).select("id", "s.label", F.transform("s.v", lambda x: x + 0.0).alias("v"))
    part = written(part.withColumn("content", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)))
    groups = written(part.groupBy("label", "content").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("size")).select("label", F.ceil(F.col("size") / SHARD).alias("shards"))
    members = part.join(groups.select(F.col("first").alias("id"), "n"), "id").join(sizes, "label")
    members = members.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards"))).select("label", "shard", "id", "n", "v")
    built = written(members.groupBy("label", "shard").applyInPandas(_built, _BUILT))
    shards = sizes.select("label", F.col("shards").cast("long").alias("shards"))
    last = F.floor(F.col("b") / GATHER) * PARTS + (PARTS - 1)
    graphs = built.filter("start < 0").withColumnRenamed("shard", "b").withColumn("a", F.lit(-1).cast("long"))
    graphs = graphs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = built.filter("start >= 0").join(shards, "label").withColumn("b", F.explode(F.sequence("shard", F.col("shards") - 1)))
    blocks = blocks.withColumnRenamed("shard", "a").drop("shards")
    turn = F.pmod((F.col("start") / BLOCK).cast("long"), F.lit(PARTS))
    blocks = blocks.withColumn("part", (F.floor(F.col("a") / GATHER) * PARTS + turn).cast("long"))
    group = ["label", "b", "part"]
    number = graphs.select(*group).count()
    met = graphs.unionByName(blocks).repartitionByRange(max(1, number), *group).sortWithinPartitions(*group, "a", "start")
    found = written(met.mapInArrow(_linked(limit), "id long, n long, other long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    joined = connected(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "first")
    known = groups.withColumnRenamed("n", "copies").join(counts.withColumnRenamed("id", "first"), "first", "left").join(joined, "first", "left")
    known = known.select("label", "content", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    of_id = part.select("id", "label", "content").join(known, ["label", "content"]).select(F.col("id").alias("i"), "n_links", "component_id")
    return rows.select("id").join(of_id, F.col("id") == F.col("i"), "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
