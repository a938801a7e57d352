"""Work that goes by the order of a key's rows, for keys of any size: exact numbers, and folds with carried state.

Rows are dealt out by ranges of (key, order), so a key that holds a third of all rows spreads over many slices, and
a slice is read in order by one task. What goes on from slice to slice is small: a count, or a state. The driver sees
one row for each slice (as many as spark.sql.shuffle.partitions), never rows of the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import written


def sliced(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows as a written table with `slice`, the number of their range of (by, order)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, by, *order).withColumn("slice", F.spark_partition_id()))


def _in_order(table: DataFrame, by: str, order: list[str]) -> DataFrame:
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartitionByRange(parts, "slice").sortWithinPartitions("slice", by, *order)


def _pieces(batches: Iterator[pa.RecordBatch], slice_at: int, key_at: int) -> Iterator[tuple]:
    """(slice, key, batch): runs of rows of one slice and key; a long run comes in several pieces."""
    for batch in batches:
        slices = batch.column(slice_at).to_numpy()
        keys = batch.column(key_at).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((slices[1:] != slices[:-1]) | (keys[1:] != keys[:-1])) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield int(slices[a]), keys[a], batch.slice(a, b - a)


def numbered(rows: DataFrame, by: str, order: list[str], name: str = "n") -> DataFrame:
    """Rows with their exact number (from 1) among those of one `by` (not null), in order; a huge group is numbered by many tasks."""
    table = sliced(rows, by, order)
    at = (table.columns.index("slice"), table.columns.index(by))

    def edges(batches):
        own, first, firsts, last, lasts = None, None, 0, None, 0
        out = []
        for number, key, piece in _pieces(batches, 1, 0):
            if number != own:
                if own is not None:
                    out.append((own, first, firsts, last, lasts))
                own, first, firsts, last, lasts = number, key, 0, key, 0
            if key != last:
                last, lasts = key, 0
            lasts += len(piece)
            firsts += len(piece) * (key == first)
        if own is not None:
            out.append((own, first, firsts, last, lasts))
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["slice", "first", "firsts", "last", "lasts"])

    keys = _in_order(table.select(F.col(by).cast("string"), "slice", *(c for c in order if c != by)), by, order)
    seen = sorted(keys.mapInArrow(edges, "slice int, first string, firsts long, last string, lasts long").collect())
    before, running, previous = {}, 0, None
    for e in seen:
        before[e["slice"]] = running if e["first"] == previous else 0
        running = e["lasts"] + (before[e["slice"]] if e["first"] == e["last"] else 0)
        previous = e["last"]

    def run(batches):
        own, last, n = None, None, 0
        for number, key, piece in _pieces(batches, *at):
            if number != own:
                own, last, n = number, key, before[number]
            if key != last:
                last, n = key, 0
            yield pa.record_batch([*piece.columns, pa.array(np.arange(n + 1, n + 1 + len(piece)))], [*piece.schema.names, name])
            n += len(piece)

    return _in_order(table, by, order).mapInArrow(run, StructType([*table.schema.fields, StructField(name, LongType())])).drop("slice")


class Fold:
    """A state machine over a key's rows in order of time. State is a list that JSON can hold.

    `gap`: a row that comes more than so many microseconds after the one before it finds the state fresh.
    """

    gap = 0

    def start(self) -> list:
        raise NotImplementedError

    def run(self, state: list, t: np.ndarray, *columns: np.ndarray) -> tuple[list[np.ndarray], list]:
        """Verdicts (a column each) of rows of one key, and the state after them."""
        raise NotImplementedError


_EDGE = "slice int, first string, last string, first_t long, last_t long, state string"


def folded(rows: DataFrame, fold: Fold, extra: list[str], result: str) -> DataFrame:
    """Rows (key string, t long, id long, extra...) judged by `fold` in order of key, t, id: key, id and the verdicts of `result`.

    1. Each slice tells the state after its last row, told from the last gap that makes it fresh.
    2. Slices without such a gap belong to one key that is dense throughout. Only runs of these are read in sequence,
       a run by one task, which tells the state after each slice; it touches what the fold can't skip.
    3. All slices are judged at once, each from the state before it.
    """
    names = ["slice", "key", "t", "id", *extra]
    table = sliced(rows.select("key", "t", "id", *extra), "key", ["t", "id"]).select(*names)
    order, gap = ["t", "id"], fold.gap

    def values(piece: pa.RecordBatch) -> list[np.ndarray]:
        return [piece.column(i).to_numpy(zero_copy_only=False) for i in (2, *range(4, len(names)))]

    def told(batches):
        out, own = [], None
        for number, key, piece in _pieces(batches, 0, 1):
            t, *rest = values(piece)
            if own is None or number != own[0]:
                if own is not None:
                    out.append(own)
                own, state, last_t = [number, key, key, int(t[0]), 0, None], None, None
            if key != own[2]:
                own[2], state, last_t = key, fold.start(), None
            breaks = np.flatnonzero(np.diff(t, prepend=t[:1] if last_t is None else last_t) > gap)
            if len(breaks):
                state, t, rest = fold.start(), t[breaks[-1] :], [c[breaks[-1] :] for c in rest]
            if state is not None:
                state = fold.run(state, t, *rest)[1]
            last_t = int(t[-1])
            own[4:] = last_t, None if state is None else json.dumps(state)
        if own is not None:
            out.append(own)
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], [x.split()[0] for x in _EDGE.split(", ")])

    edges = sorted(_in_order(table, "key", order).mapInArrow(told, _EDGE).collect(), key=lambda e: e["slice"])
    goes_on = {b["slice"]: a["last"] == b["first"] and b["first_t"] - a["last_t"] <= gap for a, b in zip(edges, edges[1:], strict=False)}
    runs: dict[int, int] = {}  # dense slices, with the first of their run
    for before, e in zip([None, *edges], edges, strict=False):
        if e["state"] is None:
            runs[e["slice"]] = runs[before["slice"]] if before and goes_on[e["slice"]] and before["slice"] in runs else e["slice"]
    state_after = {e["slice"]: json.loads(e["state"]) for e in edges if e["state"] is not None}
    entry = {b["slice"]: state_after[a["slice"]] for a, b in zip(edges, edges[1:], strict=False) if goes_on[b["slice"]] and a["slice"] in state_after}
    if runs:
        def carried(batches):
            out, own, state = [], None, None
            for number, _, piece in _pieces(batches, 0, 1):
                if number != own:
                    if own is not None:
                        out.append((own, json.dumps(state)))
                    if runs[number] == number:
                        state = entry.get(number) or fold.start()
                    own = number
                state = fold.run(state, *values(piece))[1]
            if own is not None:
                out.append((own, json.dumps(state)))
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.string())], ["slice", "state"])

        start = F.element_at(F.create_map(*(F.lit(x) for pair in runs.items() for x in pair)), F.col("slice"))
        dense = table.withColumn("run", start).filter("run is not null").repartition("run").sortWithinPartitions("slice", *order).select(*names)
        state_after |= {r["slice"]: json.loads(r["state"]) for r in dense.mapInArrow(carried, "slice int, state string").collect()}
        entry = {b["slice"]: state_after[a["slice"]] for a, b in zip(edges, edges[1:], strict=False) if goes_on[b["slice"]]}

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in result.split(", ")]

    def judged(batches):
        own, last, state = None, None, None
        for number, key, piece in _pieces(batches, 0, 1):
            if number != own:
                own, last, state = number, key, entry.get(number) or fold.start()
            if key != last:
                last, state = key, fold.start()
            columns, state = fold.run(state, *values(piece))
            yield pa.record_batch([piece.column(1), piece.column(3), *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True))], ["key", "id", *(n for n, _ in fields)])

    return _in_order(table, "key", order).mapInArrow(judged, f"key string, id long, {result}")


def keyed(column: Callable | str) -> F.Column:
    """A key that may be null as a string that isn't: `=` and the key, or nothing."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def unkeyed(column: str) -> F.Column:
    return F.when(F.col(column) != "", F.substr(F.col(column), F.lit(2)))
