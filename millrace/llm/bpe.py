"""Byte-level BPE encoding and decoding by DuckDB recursive queries within each partition.

A text is split by the tokenizer's pattern; each distinct piece becomes a list of tokens, one for each
byte. A recursive query contracts every piece's leftmost pair of least rank and looks up in the merge
table only the two pairs that this makes, until no piece has a pair that merges. Decoding joins the ids
of whole texts, by position, with the vocabulary. Pieces that a Python worker has seen are kept in a
bounded table, so frequent ones are encoded once. Inside, a token is its place in the vocabulary by
rank; ids are looked up at the end.

Defined results: a null text has the ids of an empty one, none. Ids outside the vocabulary are an
error when decoded. Special tokens are never produced. Repeated rows, ties and other columns need
no care: rows are independent.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections import defaultdict
from functools import lru_cache
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import freed

#: Pieces in one recursive query, pieces that a worker keeps, and the bytes from which a piece is long.
TOGETHER, KEPT, LONG = 20_000, 200_000, 300
#: Stands for "these two don't merge", and for the tokens before and behind a piece.
NEVER = 1 << 25

# White_Space in Unicode, and the letters and numbers below U+0250.
_SPACE = "\\t-\\r \\x85\\xa0"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼½¾"
_FAST = re.compile(f" ?[{_LETTER}]+| ?[{_NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\\x00-\\u024f]")

#: A list's items are the rank of a token's pair with the next one, the byte where it begins and the token,
#: from the high bits to the low ones: the least item is the leftmost pair of least rank.
BYTE, RANK = 26, 36
_TOKEN, _BYTES, _BELOW = (1 << BYTE) - 1, (1 << RANK) - (1 << BYTE), (1 << RANK) - 1

_CONTRACT = f"""
WITH RECURSIVE state(w, q) AS (
  SELECT w, q FROM begun
  UNION ALL
  (WITH least AS (SELECT w, q, list_min(q) AS m FROM state),
   place AS (SELECT w, q, m, m >> {RANK} AS k, list_position(q, m)::BIGINT AS i FROM least WHERE m < {NEVER << RANK}),
   beside AS (SELECT w, q, m, k, i, q[i - 1] & {_TOKEN} AS l, q[i + 2] & {_TOKEN} AS r FROM place)
   SELECT x.w, list_concat(x.q[:x.i - 2],
                           [(coalesce(a.k, {NEVER})::BIGINT << {RANK}) + (x.q[x.i - 1] & {_BELOW}), (coalesce(b.k, {NEVER})::BIGINT << {RANK}) + (x.m & {_BYTES}) + x.k],
                           x.q[x.i + 2:])
   FROM beside AS x LEFT JOIN merges AS a ON a.pair = x.l * 4294967296 + x.k LEFT JOIN merges AS b ON b.pair = x.k * 4294967296 + x.r)
)
SELECT w, q FROM state WHERE list_min(q) >= {NEVER << RANK}
"""

#: One round for long pieces: all occurrences of a piece's least pair from the left, but none behind one
#: whose contraction makes a pair of lesser rank, for that one comes first.
_ROUND = """
CREATE OR REPLACE TEMP TABLE turn AS
WITH pairs AS (SELECT w, p, t, lead(t) OVER o AS nt, lead(t, 2) OVER o AS nnt, lag(t) OVER o AS pt FROM long_rows WINDOW o AS (PARTITION BY w ORDER BY p)),
ranked AS (SELECT x.*, m.k, min(m.k) OVER (PARTITION BY w) AS least FROM pairs AS x LEFT JOIN merges AS m ON m.pair = x.t::BIGINT * 4294967296 + x.nt),
hit AS (SELECT *, p - row_number() OVER (PARTITION BY w ORDER BY p) AS run FROM ranked WHERE k = least),
chosen AS (SELECT w, p, k, pt, nnt FROM (SELECT *, (p - min(p) OVER (PARTITION BY w, run)) % 2 AS odd FROM hit) WHERE odd = 0),
sided AS (SELECT w, p, k, CASE WHEN lag(p) OVER (PARTITION BY w ORDER BY p) = p - 2 THEN k ELSE pt END AS l, nnt AS r FROM chosen),
risky AS (SELECT s.w, min(s.p) AS stop FROM sided AS s LEFT JOIN merges AS a ON a.pair = s.l::BIGINT * 4294967296 + s.k LEFT JOIN merges AS b ON b.pair = s.k::BIGINT * 4294967296 + s.r WHERE a.k < s.k OR b.k < s.k GROUP BY s.w)
SELECT s.w, s.p, s.k FROM sided AS s LEFT JOIN risky USING (w) WHERE stop IS NULL OR s.p <= stop
"""
_APPLY = """
CREATE OR REPLACE TEMP TABLE long_rows AS
SELECT x.w, row_number() OVER (PARTITION BY x.w ORDER BY x.p) AS p, coalesce(c.k, x.t) AS t
FROM long_rows AS x LEFT JOIN turn AS c ON c.w = x.w AND c.p = x.p LEFT JOIN turn AS d ON d.w = x.w AND d.p = x.p - 1
WHERE d.p IS NULL
"""

# Fixed value: the pattern for which _FAST is the same below U+0250.
STANDARD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE = _SPACE + "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Coder:
    """Encodes and decodes with one vocabulary: a DuckDB connection and a bounded table of known pieces."""

    def __init__(self, data: bytes, pattern: str):
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        tokens = sorted(ids, key=ids.__getitem__)
        if len(tokens) > NEVER:
            raise ValueError("the vocabulary is too large")
        self.ranks = ranks = {t: i for i, t in enumerate(tokens)}
        self.ids = np.array([ids[t] for t in tokens], np.int32)
        self.names = pa.array([b"%d," % i for i in self.ids], pa.large_binary())
        halves = [(ranks[t[:i]], ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*halves, strict=True)) if halves else (np.empty(0, np.int64),) * 3
        self.first = np.array([ranks.get(bytes([i]), NEVER) for i in range(256)], np.int64)
        self.second = np.full((256, 256), NEVER, np.int64)
        for t, k in ranks.items():
            if len(t) == 2 and t[:1] in ranks and t[1:] in ranks:
                self.second[t[0], t[1]] = k
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "160MB"})
        self._load("merges", {"pair": left * 4294967296 + right, "k": rank.astype(np.int32)})
        self._load("vocabulary", {"id": self.ids, "bytes": pa.array(tokens, pa.binary())})
        self.fast = pattern == STANDARD
        self.pattern = regex.compile(pattern.replace(r"\S", f"[^{_WIDE}]").replace(r"[^\s", f"[^{_WIDE}").replace(r"\s", f"[{_WIDE}]"))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("loaded", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM loaded")
        self.db.unregister("loaded")

    def _asked(self, name: str, columns: dict, sql: str) -> pa.Table:
        """The answer of a query on these columns, which it knows by `name`."""
        self.db.register(name, pa.table(columns))
        got = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return got

    def rest(self) -> None:
        """Lets go of what the last pieces needed: a worker lives on, and may do other work next."""
        for name in ("long_rows", "turn"):
            self.db.execute(f"DROP TABLE IF EXISTS {name}")
        pa.default_memory_pool().release_unused()

    def split(self, text: str) -> list[str]:
        return _FAST.findall(text) if self.fast and not _BEYOND.search(text) else self.pattern.findall(text)

    def _begun(self, pieces: list[bytes]) -> dict:
        """Lists (w, q) for the recursive query: each byte a token, between two that never merge."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 2
        ends = np.cumsum(sizes)
        within = np.ones(ends[-1], bool)
        within[ends - sizes] = within[ends - 1] = False
        data = np.zeros(ends[-1], np.uint8)
        data[within] = np.frombuffer(b"".join(pieces), np.uint8)
        rank = np.full(ends[-1], NEVER, np.int64)
        rank[:-1] = np.where(within[:-1] & within[1:], self.second[data[:-1], data[1:]], NEVER)
        begin = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        items = (rank << RANK) + (begin << BYTE) + np.where(within, self.first[data], NEVER)
        return {"w": np.arange(len(pieces), dtype=np.int32), "q": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(items))}

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of each piece, as the bytes of an int32 array."""
        whole = [self.ranks.get(p) for p in pieces]
        out = [b"" if k is None else k.to_bytes(4, sys.byteorder) for k in whole]
        small = [i for i, p in enumerate(pieces) if whole[i] is None and 0 < len(p) <= LONG]
        for start in range(0, len(small), TOGETHER):
            part = small[start : start + TOGETHER]
            got = self._asked("begun", self._begun([pieces[i] for i in part]), _CONTRACT)
            lists = got.column(1).combine_chunks()
            tokens = (lists.values.to_numpy() & _TOKEN).astype(np.int32).tobytes()
            places = (lists.offsets.to_numpy() * 4).tolist()
            for w, begin, end in zip(got.column(0).to_pylist(), places, places[1:], strict=False):
                out[part[w]] = tokens[begin + 4 : end - 4]
        for i in (i for i, p in enumerate(pieces) if whole[i] is None and len(p) > LONG):
            tokens = self.first[np.frombuffer(pieces[i], np.uint8)].astype(np.int32)
            self._load("long_rows", {"w": np.zeros(len(tokens), np.int32), "p": np.arange(1, len(tokens) + 1), "t": tokens})
            while True:
                self.db.execute(_ROUND)
                if not self.db.sql("SELECT count(*) FROM turn").fetchall()[0][0]:
                    break
                self.db.execute(_APPLY)
            out[i] = self.db.sql("SELECT t FROM long_rows ORDER BY p").to_arrow_table().column(0).to_numpy().astype(np.int32).tobytes()
        return out

    def known(self, pieces: list[str]) -> list[bytes]:
        """The tokens of each piece, from the table of known ones where it stands there."""
        found = [*map(self.young.get, pieces)]
        absent = [i for i, x in enumerate(found) if x is None]
        for i in absent:
            found[i] = self.old.get(pieces[i])
        new = [i for i in absent if found[i] is None]
        for i, x in zip(new, self.contract([pieces[i].encode() for i in new]), strict=True):
            found[i] = x
        self.young |= {pieces[i]: found[i] for i in absent if len(pieces[i]) < 64}
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {}
        return found

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts, and the bounds of each text among them."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        rows = []
        for text in texts:
            pieces = self.split(text)
            rows.append(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)))
        number.default_factory = None  # else it refers to itself and stays
        found = self.known([*number])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = np.concatenate(rows)
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        begin = (np.cumsum(sizes) - sizes)[which] - ends + lengths
        tokens = np.frombuffer(b"".join(found), np.int32)[np.repeat(begin, lengths) + np.arange(lengths.sum())]
        if (tokens >= len(self.ids)).any():
            raise ValueError("a byte is not in the vocabulary")
        return tokens, np.concatenate([[0], ends])[np.cumsum([0, *map(len, rows)])]

    def decoded(self, ids: np.ndarray) -> pa.Array:
        """The bytes of each id, in their order: a join of positions with the vocabulary."""
        got = self._asked("given", {"p": np.arange(len(ids)), "id": ids}, "SELECT p, bytes FROM given JOIN vocabulary USING (id)")
        if len(got) != len(ids):
            raise ValueError("an id is not in the vocabulary")
        place, data = got.column(0).to_numpy(), got.column(1).cast(pa.large_binary()).combine_chunks()
        return data if (place[1:] > place[:-1]).all() else data.take(pa.array(np.argsort(place)))


@lru_cache(maxsize=2)
def coder(data: bytes, pattern: str) -> Coder:
    """One for each Python worker and vocabulary."""
    return Coder(data, pattern)


def _groups(texts: list[str | None], letters: int = 1_000_000):
    """Texts by some letters at a time."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= letters:
            yield group
            group, size = [], 0
    if group:
        yield group


def _spans(items: pa.Array, bounds: np.ndarray) -> tuple[memoryview, list[int]]:
    """The bytes of all items in a row, and where each span of items begins and ends in them."""
    if not len(items):
        return memoryview(b""), [0] * len(bounds)
    return memoryview(items.buffers()[2]), np.frombuffer(items.buffers()[1], np.int64)[items.offset + bounds].tolist()


def digests(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row: its text encoded, and the ids decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = coder(shared.value, pattern)
        for batch in batches:
            n, ids, back = [], [], []
            for group in _groups(batch.column(1).to_pylist()):
                tokens, bounds = own.encoded(group)
                n += np.diff(bounds).tolist()
                names, ends = _spans(own.names.take(pa.array(tokens)), bounds)
                ids += [hashlib.sha256(names[i : max(i, j - 1)]).hexdigest() for i, j in pairwise(ends)]
                data, ends = _spans(own.decoded(own.ids[tokens]), bounds)
                back += [hashlib.sha256(data[i:j]).hexdigest() for i, j in pairwise(ends)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.rest()

    return docs.select(docs[id_col].cast("long").alias("id"), text_col).mapInArrow(freed(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = coder(shared.value, pattern)
        for batch in batches:
            parts = [own.encoded(group) for group in _groups(batch.column(1).to_pylist())]
            ends = np.cumsum([0, *(n for _, bounds in parts for n in np.diff(bounds))]).astype(np.int32)
            ids = np.concatenate([own.ids[tokens] for tokens, _ in parts]) if parts else np.empty(0, np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("id"), text_col).mapInArrow(freed(run), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded_docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes of each row's ids; null ids decode to no bytes."""
    shared = coded_docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = coder(shared.value, pattern)
        for batch in batches:
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                ids = [np.array(x or [], np.int64) for x in part.column(1).to_pylist()]
                data, ends = _spans(own.decoded(np.concatenate(ids)), np.cumsum([0, *map(len, ids)]))
                yield pa.record_batch([part.column(0), pa.array([bytes(data[i:j]) for i, j in pairwise(ends)], pa.binary())], ["id", "data"])

    return coded_docs.select(coded_docs[id_col].cast("long").alias("id"), ids_col).mapInArrow(freed(run), "id long, data binary").withColumnRenamed("id", id_col)
