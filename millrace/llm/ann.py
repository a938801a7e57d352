"""Nearest neighbours by additive quantisation.

A vector's direction is stored as one code word number from each of several full-dimensional residual
codebooks, found by beam search, and its norm. A query's inner products with all code words form a
lookup table; a candidate's score is the sum of its entries times the stored norm (over that of the sum
of code words). The best `refine` of each query are reranked by exact double precision. How many that
are is found by an audit: a sample of the queries is answered exactly from all vectors, and `refine` is
doubled until their candidates hold enough of the true neighbours, at last all vectors.

Defined results: vectors that are null, zero, of another length than most of the training sample, or
hold null or non-finite components take no part, as queries or candidates. Ties go to the smaller id.
Fewer candidates than asked for are all returned. Rows that share an id count as one, the largest
vector in order. An empty table, or one without a usable query, gives an empty result. Extra columns, of
whatever names, are left out. Components of any finite size count: directions are scaled before they are coded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Codebooks, words in each, width of the beam, and rows of the training sample at most.
BOOKS, CODES, BEAM, SAMPLE = 16, 256, 8, 12_000
#: Candidates of each query that are reranked at least, queries of the audit (about), the part of their true neighbours to be found.
REFINE, AUDIT, RECALL = 160, 96, 0.96
#: Vectors in a pack, vectors that one task scans for a block of queries (about), queries in a block.
PACK, SPAN, QUERY_BLOCK = 2048, 1 << 20, 256
_ROUNDS = 8


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of the rows of x, from distinct rows drawn at random."""
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(_ROUNDS):
        at = (x @ centre.T * 2 - (centre**2).sum(1)).argmax(1)
        n = np.bincount(at, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, at, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(centre))]).astype(np.float32)
    return centre


def train(sample: np.ndarray, books: int = BOOKS, codes: int = CODES, seed: int = 5) -> np.ndarray:
    """Codebooks [books, codes, dim] by residual k-means; the first word of each but the first is zero."""
    rng, rest, out = np.random.default_rng(seed), sample.astype(np.float32).copy(), []
    for m in range(books):
        book = _means(rest, min(codes, len(rest)), rng)
        if m:
            book[0] = 0
        out.append(np.pad(book, ((0, codes - len(book)), (0, 0)), mode="edge"))
        rest -= out[-1][(rest @ out[-1].T * 2 - (out[-1] ** 2).sum(1)).argmax(1)]
    return np.stack(out).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes [n, books] by beam search over the residual codebooks, and norms of the sums of code words."""
    n, (m, k, _) = len(x), books.shape
    codes = np.zeros((n, 1, 0), np.int64)
    rest = x.astype(np.float32)[:, None, :]
    for b in range(m):
        error = (rest**2).sum(2)[:, :, None] - 2 * rest @ books[b].T + (books[b] ** 2).sum(1)
        flat = error.reshape(n, -1)
        width = min(beam, flat.shape[1])
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        parent, word = best // k, best % k
        rows = np.arange(n)[:, None]
        rest = rest[rows, parent] - books[b][word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None]], axis=2)
    last = (rest**2).sum(2).argmin(1)
    return codes[np.arange(n), last].astype(np.uint8), np.linalg.norm(x - rest[np.arange(n), last], axis=1).astype(np.float32)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(fine & F.col("id").isNotNull())


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and norms of the rows of x; squares of huge or tiny components stay finite and above zero."""
    most = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / most
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return scaled / length, np.clip(most * length, 1e-300, 1e300)[:, 0]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _coded(books: np.ndarray):
    """Packs of vectors: their ids, codes and scales as one row."""

    def pack(parts):
        ids, codes, scales = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.record_batch([pa.array([int(ids[0])]), pa.array([ids.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([scales.tobytes()], pa.binary())], ["first", "ids", "codes", "scales"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                unit, norm = directions(_matrix(part.column(1)))
                codes, near = encode(unit, books)
                parts.append((part.column(0).to_numpy(), codes, norm / np.maximum(near, 1e-20)))
                n += len(part)
                if n >= PACK:
                    yield pack(parts)
                    parts, n = [], 0
        if parts:
            yield pack(parts)

    return run


def _scanned(books: np.ndarray, refine: int):
    """The best candidates of each query of a block among all packs that follow one another with it."""

    def told(queries, best):
        found = [(np.full(len(i), q), i, s) for q, (i, s) in zip(queries.tolist(), best, strict=True)]
        return pa.record_batch([pa.array(np.concatenate([f[k] for f in found]), kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "near"])

    def run(batches):
        at, queries, tables, best = None, np.empty(0, np.int64), [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["q"] is not None:
                    if at is not None:
                        yield told(queries, best)
                    at, queries = row["part"], np.array(row["q"], np.int64)
                    unit, _ = directions(np.array(row["vectors"], np.float64))
                    tables = [books @ u for u in unit.astype(np.float32)]
                    best = [(np.empty(0, np.int64), np.empty(0)) for _ in tables]
                    continue
                if row["part"] != at:  # no query fell into this block
                    continue
                ids, scale = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["scales"])
                code = np.ascontiguousarray(np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1).T)
                for k, table in enumerate(tables):
                    near = table[0].take(code[0])
                    for m in range(1, len(table)):
                        near += table[m].take(code[m])
                    near = near * scale
                    near[ids == queries[k]] = -np.inf
                    had, score = best[k]
                    fresh = np.flatnonzero(near > score.min()) if len(score) >= refine else np.flatnonzero(near > -np.inf)
                    if len(fresh):
                        had, score = np.concatenate([had, ids[fresh]]), np.concatenate([score, near[fresh]])
                        if len(score) > refine:
                            top = np.argpartition(-score, refine - 1)[:refine]
                            had, score = had[top], score[top]
                        best[k] = had, score
        if at is not None:
            yield told(queries, best)

    return run


def _nearest(asked: list[int], x: np.ndarray, k: int):
    """The k nearest of each asked vector within each batch, in double precision."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            near = x @ _matrix(batch.column(1)).T
            out = []
            for q, row in zip(asked, near, strict=True):
                row[ids == q] = -np.inf
                top = np.lexsort((ids, -row))[:k]
                out += [(q, int(ids[i]), float(row[i])) for i in top if row[i] > -np.inf]
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "score"])

    return run


def _blocks(queries: DataFrame) -> DataFrame:
    """(part, q, vectors): the queries in blocks of about QUERY_BLOCK, one row each."""
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    return queries.groupBy(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).alias("part")).agg(F.collect_list("id").alias("q"), F.collect_list("v").alias("vectors"))


def _candidates(packed: DataFrame, asked: DataFrame, books: np.ndarray, refine: int, spans: int) -> DataFrame:
    """(query_id, id): the `refine` best-scored of each query. Each pack meets each block of queries once."""
    parts = asked.agg(F.max("part")).first()[0] + 1
    none = F.lit(None).cast("binary")
    spread = packed.withColumns({"span": F.pmod(F.xxhash64("first"), F.lit(spans)), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})
    heads = asked.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))))
    rows = spread.select("part", "span", F.lit(None).cast("array<long>").alias("q"), F.lit(None).cast("array<array<double>>").alias("vectors"), "ids", "codes", "scales")
    rows = rows.unionByName(heads.select("part", "span", "q", "vectors", none.alias("ids"), none.alias("codes"), none.alias("scales")))
    # a block of queries stands before the packs that it meets
    rows = rows.repartition("part", "span").sortWithinPartitions("part", "span", F.col("q").isNull())
    near = rows.drop("span").mapInArrow(_scanned(books, refine), "query_id long, id long, near double")
    if spans > 1:
        best = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
        near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= refine)
    return near.select("query_id", "id")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, refine: int = REFINE, metric_sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): each query's k rows of largest inner product, itself left out.

    `vectors` and `queries` are (id, v). Codebooks are fitted on at most about `metric_sample` rows,
    chosen by a hash of the id; every row is indexed and every query meets every pack of codes. Only
    codes (some bytes a row) are dealt to query blocks; a task keeps a query's best `refine` as it goes
    from pack to pack, and only those fetch their vectors. `refine` is what the audit starts from: about
    AUDIT queries, chosen by a hash, must find `recall` of their true neighbours.
    """
    vectors = written(vectors.groupBy("id").agg(F.max("v").alias("v")))
    n = vectors.count()
    empty = vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    if not n:
        return empty

    def chance(seed: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    drawn = vectors.filter(chance(0) <= metric_sample / n).select("v").toPandas()["v"].tolist() or [vectors.first()["v"]]
    lengths, number = np.unique([len(v) for v in drawn], return_counts=True)
    dim = int(lengths[number.argmax()])
    books = train(directions(np.array([v for v in drawn if len(v) == dim]))[0])
    vectors = vectors.filter(F.size("v") == dim)
    queries = written(queries.groupBy("id").agg(F.max("v").alias("v")).filter(F.size("v") == dim))
    total = queries.count()
    if not total:
        return empty

    packed = written(vectors.mapInArrow(_coded(books), "first long, ids binary, codes binary, scales binary"))
    spans = max(1, -(-n // SPAN))
    sample = queries.filter(chance(2) <= AUDIT / total).orderBy("id").collect() or queries.orderBy("id").limit(1).collect()
    x = np.array([r.v for r in sample], np.float64)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    truth = vectors.mapInArrow(_nearest([r.id for r in sample], x, k), "query_id long, id long, score double")
    truth = written(truth.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k).select("query_id", "id"))
    wanted, refine = truth.count(), min(refine, n)
    audited = written(_blocks(queries.join(truth.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")))
    while refine < n and truth.join(_candidates(packed, audited, books, refine, spans), ["query_id", "id"]).count() < recall * wanted:
        refine = min(2 * refine, n)

    chosen = _candidates(packed, written(_blocks(queries)), books, refine, spans)
    both = chosen.join(vectors, "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = both.select("query_id", "id", F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))
    return scored.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
