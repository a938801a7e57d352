"""Packing of token ids into rows of one length: best fit decreasing, with a segment tree over capacities.

Each document's ids are cut into segments of at most the row length, losing nothing; segments, longest
first, go to the fullest row that still has room, found by a segment tree over the capacities in use.
A packed row holds its ids (padded), the cumulative lengths of its segments, and positions that start
from 0 at each segment; with each segment's document and its place there, so documents can be rebuilt.

Defined results: a null or empty document has no segment and stands in no row. Segments of one length
keep the order of the input. Repeated rows are packed as often as they occur. Ids below 0 or beyond
`PAD` are an error. Rows are packed within groups of GROUP tokens of a partition, in bounded memory.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Ids in a row, tokens that are packed together, and the id that fills rows up.
LENGTH, GROUP, PAD = 2048, 2_000_000, 65535


class Capacities:
    """A segment tree over the free places of open rows: the least capacity in use that is large enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.number = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.number[at] += by
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest open row with `size` free places, which is then no longer open."""
        at = size + self.leaves
        if not self.number[at]:
            while at > 1 and (at & 1 or not self.number[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.number[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """The segments of each row."""
    rows: list[list[int]] = []
    free = Capacities(length)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = free.take(size)
        if found is None:
            capacity, row = length, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(i)
        if capacity > size:
            free.add(capacity - size, row)
    return rows


SCHEMA = "row_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, doc_starts array<long>"


def _packed(group: list[tuple[int | None, np.ndarray]], length: int, first: int) -> pa.RecordBatch:
    parts = [(doc, start, ids[start : start + length]) for doc, ids in group for start in range(0, len(ids), length)]
    rows = best_fit(np.array([len(p[2]) for p in parts], np.int64), length)
    out: list[list] = [[] for _ in range(7)]
    for number, row in enumerate(rows):
        ids, places = np.full(length, PAD, np.uint16), np.zeros(length, np.uint16)
        ends = [0]
        for i in row:
            a, b = ends[-1], ends[-1] + len(parts[i][2])
            ids[a:b], places[a:b] = parts[i][2], np.arange(b - a)
            ends.append(b)
        for column, value in zip(out, (first + number, ends[-1], ids.astype("<u2").tobytes(), ends, places.astype("<u2").tobytes(), [parts[i][0] for i in row], [parts[i][1] for i in row]), strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ("row_id", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "doc_starts")
    return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], list(names))


def _grouped(rows, length: int):
    """Packed batches of (id, ids array) rows; row ids start from the partition's number."""
    base, group, size, done = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, [], 0, 0
    for doc, ids in rows:
        if not len(ids):
            continue
        if ids.min() < 0 or ids.max() >= PAD:
            raise ValueError(f"ids must be from 0 to {PAD - 1}")
        group.append((doc, ids))
        size += len(ids)
        if size >= GROUP:
            batch = _packed(group, length, base + done)
            done += len(batch)
            yield from (batch.slice(i, 500) for i in range(0, len(batch), 500))
            group, size = [], 0
    if group:
        batch = _packed(group, length, base + done)
        yield from (batch.slice(i, 500) for i in range(0, len(batch), 500))


def pack(coded: DataFrame, length: int = LENGTH, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Packed rows of (id, ids array<int>); nothing is shuffled."""

    def run(batches):
        def rows():
            for batch in batches:
                ids = batch.column(1)
                values, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                for doc, a, b in zip(batch.column(0).to_pylist(), np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    yield doc, values[a:b]

        yield from _grouped(rows(), length)

    return coded.select(coded[id_col].cast("long").alias("id"), ids_col).mapInArrow(run, SCHEMA)


@lru_cache(maxsize=2)
def _encoding(data: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenize_and_pack(docs: DataFrame, vocabulary: bytes, pattern: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of whole texts, tokenized by a public rank file; ids never leave the task that packs them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoding = _encoding(shared.value, pattern)
        yield from _grouped(((doc, np.array(encoding.encode_ordinary(text or ""), np.int64)) for batch in batches for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), length)

    return docs.select(docs[id_col].cast("long").alias("id"), text_col).mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet under `path`: an id matrix, cumulative lengths and positions, row by row."""
    packed.write.mode("errorifexists").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>): the documents of packed rows put together again, if their ids are distinct."""
    from pyspark.sql import functions as F

    def run(batches):
        for batch in batches:
            out = []
            for ids, ends, docs, starts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                row = np.frombuffer(ids, "<u2")
                out += [(d, s, row[a:b].tolist()) for d, s, a, b in zip(docs, starts, ends, ends[1:], strict=False)]
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["doc_id", "start", "part"])

    parts = packed.select("ids", "cu_seqlens", "doc_ids", "doc_starts").mapInArrow(run, "doc_id long, start long, part array<int>")
    return parts.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda x: x["part"])).alias("ids"))
