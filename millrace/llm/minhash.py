"""Near-duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

A document's elements are its distinct shingles of five words, weighted by how often each occurs.
Every element sends a Poisson process of arrivals (rate: its weight) to the signature's slots; a
slot keeps the element that came first. Two slots agree with the probability Jaccard similarity of
the two weighted sets. A document's processes end as soon as no arrival can come before the latest
first arrival of its slots. Documents that share a band of slots are candidates; a candidate is a
link if the Jaccard similarity of their shingle sets, computed exactly from all shingles, is at least
the threshold. Weights are damped, 1 + ln n for n occurrences, so the similarity that a signature
estimates stays near the one that is tested; a text that repeats a shingle is signed once more with weights of 1,
which estimates exactly that one.

Defined results: a null or wordless text links with nothing. A text of one to four words has one
shingle, of all its words. Letter case, punctuation and white space don't count. Copies of one
text are taken as one member, so a group of thousands costs one. A row whose id is null takes no
part and is its own class, null. Repeated rows come back repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, freed, scrambled, words, written
from .components import connected

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of slots: at similarity 0.8 a pair shares none of 32 bands of 6 slots once in 16,000 cases.
BANDS, ROWS = 32, 6
#: Words that a task works on at a time, about.
BLOCK = 100_000
#: Low bits of a slot's key that name its element; the bits above are the arrival time.
NAME_BITS = 24


def shingles(hashes: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words (of the whole text, if it has fewer), and where each text's end."""
    hashes = hashes.view(np.uint64)
    counts = np.diff(ends, prepend=0)
    starts = ends - counts
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    out_ends = np.cumsum(n)
    at = np.repeat(starts - (out_ends - n), n) + np.arange(out_ends[-1] if len(n) else 0)
    last = np.repeat(ends, n) - 1
    made = np.full(len(at), 0x1234567, np.uint64)
    for i in range(size):
        made = np.where(at + i <= last, scrambled(made * np.uint64(31) + hashes[np.minimum(at + i, last)]), made)
    return made, out_ends


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, slots: int) -> np.ndarray:
    """[n, slots] keys of the first arrival at each slot; documents without elements keep the largest key."""
    never = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full((n, slots), never, np.uint64)
    flat, low = best.reshape(-1), np.uint64((1 << NAME_BITS) - 1)
    name = scrambled(elements) & low
    time, arrival = np.zeros(len(elements)), 0
    alive = np.arange(len(elements))
    while len(alive):
        arrival += 1
        mix = scrambled(elements[alive] ^ scrambled(np.full(1, arrival, np.uint64)))
        u = ((mix >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740993.0
        time[alive] -= np.log(u) / weights[alive]
        slot = (scrambled(mix) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
        key = (time[alive].view(np.uint64) & ~low) | name[alive]
        np.minimum.at(flat, owner[alive] * slots + slot.astype(np.int64), key)
        if arrival % 8 == 0 or arrival < 4:
            docs, where = np.unique(owner[alive], return_inverse=True)
            alive = alive[key <= best[docs].max(axis=1)[where]]
    return best


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets of distinct elements: what signatures estimate."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    below = np.concatenate([[0], np.cumsum(y)[:-1]])  # where the ratio is lower, b's weight is the greater
    above = np.cumsum(x[::-1])[::-1]
    return float((1 / ((above + only_a) / x + (below + only_b) / y)).sum())


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two texts by their sorted distinct shingle hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def _distinct(batch: pa.RecordBatch):
    """Of blocks of a batch's rows (id, content, words): the rows, distinct shingles, their counts, owners and where each text's end."""
    listed = batch.column(2)
    sizes = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes + 250) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(listed)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        ends = np.cumsum(sizes[start:end]).astype(np.int64)
        made, ends = shingles(listed.slice(start, end - start).flatten().to_numpy(zero_copy_only=False), ends)
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        order = np.lexsort((made, owner))
        made, owner = made[order], owner[order]
        first = np.ones(len(made), bool)
        first[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        yield batch.slice(start, end - start), made[at], np.diff(at, append=len(made)), owner[at], np.searchsorted(owner[at], np.arange(len(ends)), "right")


def _banded(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """[n, BANDS] hashes of the bands of n texts' signatures."""
    keys = signatures(elements, weights, owner, n, BANDS * ROWS)
    slots = (keys & np.uint64((1 << NAME_BITS) - 1)).reshape(n, BANDS, ROWS)
    band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS))
    for i in range(ROWS):
        band = scrambled(band * np.uint64(31) + slots[:, :, i])
    return band


def _signed(batches):
    """Bands of each batch's texts; none for those without words.

    A text that repeats a shingle has bands of its set too, all weights 1. At equal weights both kinds agree,
    so it meets a text that has the passage once as often as their sets are alike, however often it repeats it.
    """
    for batch in batches:
        for rows, elements, counts, owner, ends in _distinct(batch):
            n = len(ends)
            bands, keep = np.zeros((n, 2, BANDS), np.uint64), np.zeros((n, 2, BANDS), bool)
            bands[:, 0] = _banded(elements, 1 + np.log(counts), owner, n)
            keep[:, 0] = (np.diff(ends, prepend=0) > 0)[:, None]
            again = np.zeros(n, bool)
            again[owner[counts > 1]] = True
            mine = again[owner]
            bands[again, 1] = _banded(elements[mine], np.ones(int(mine.sum())), (np.cumsum(again) - 1)[owner[mine]], int(again.sum()))
            keep[:, 1] = again[:, None] & (bands[:, 0] != bands[:, 1])
            offsets = np.concatenate([[0], np.cumsum(keep.sum((1, 2)))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[keep].view(np.int64)))
            yield pa.record_batch([rows.column(0), rows.column(1), listed], ["id", "content", "bands"])


def _shingled(batches):
    """(id, size, shingles): the sorted distinct shingle hashes of each text."""
    for batch in batches:
        for rows, elements, _, _, ends in _distinct(batch):
            starts = np.concatenate([[0], ends[:-1]])
            packed = pa.array([elements[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
            yield pa.record_batch([rows.column(0), pa.array(ends - starts), packed], ["id", "size", "shingles"])


def _verified(threshold: float):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            ok = pa.array([i for i in range(len(a)) if similarity(x[i].as_buffer(), y[i].as_buffer()) >= threshold], pa.int64())
            yield pa.record_batch([a.take(ok), b.take(ok)], ["a", "b"])

    return run


def _listed(batches):
    """(id, c, size, s): the distinct shingles of each text, one row for each."""
    for batch in batches:
        sizes = batch.column(2).to_numpy()
        block = np.cumsum(sizes) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            s = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3).slice(start, end - start)] or [np.empty(0, np.int64)])
            of = np.repeat(np.arange(start, end), sizes[start:end])
            yield pa.record_batch([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(sizes[of]), pa.array(s)], ["id", "c", "size", "s"])


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, content, p): p is the text's words, content their hash; both null without words."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("p")).select("id", F.when(F.col("p") != "", F.col("p")).alias("p"))
    return plain.select("id", F.unhex(F.md5("p")).alias("content"), "p")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("id", "content", F.transform(F.split("p", " "), lambda w: F.xxhash64(w)).alias("w"))


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, size, shingles) are similar enough; sizes alone refuse most others."""
    sizes = texts.groupBy("id").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    near = pairs.join(sizes.toDF("a", "low_a", "high_a"), "a").join(sizes.toDF("b", "low_b", "high_b"), "b")
    near = near.filter((F.col("high_a") >= threshold * F.col("low_b")) & (F.col("high_b") >= threshold * F.col("low_a"))).select("a", "b")
    x, y = texts.select(F.col("id").alias("a"), F.col("shingles").alias("x")), texts.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return written(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(freed(_verified(threshold)), "a long, b long").distinct())


def across(open_rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of `open_rows` (id, c) in different classes c that may reach the threshold: all that do are among them.

    Two sets of that similarity share one of the rarest shingles of each (the first n - ceil(threshold n) + 1
    in one order for all, the rarest first), and the first that they share stands so early in both that enough
    can follow. So texts that have only a passage or the ground of a group of copies in common, however
    many they are, never meet.
    """
    rows = texts.join(open_rows, "id").select("id", "c", "size", "shingles")
    each = written(rows.mapInArrow(freed(_listed), "id long, c long, size long, s long"))
    # shingles of one text only stand first, and need not move: their number is enough
    number = each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = Window.partitionBy("id", "size")
    rank = F.row_number().over(own.orderBy("n", "s")) - F.count(F.lit(1)).over(own)
    ranked = each.join(number, "s").withColumn("rank", F.col("size") + rank)
    first = ranked.filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    first = written(first.select("s", "id", "c", "size", "rank"))
    discard(each)
    apart = first.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("s")
    near = first.join(apart, "s", "left_semi")
    other = near.select("s", F.col("id").alias("b"), F.col("c").alias("d"), F.col("size").alias("size_b"), F.col("rank").alias("rank_b"))
    # behind the first element that both share, at most so many more are common
    enough = 1 + F.least(F.col("size") - F.col("rank"), F.col("size_b") - F.col("rank_b")) >= threshold / (1 + threshold) * (F.col("size") + F.col("size_b")) - 1e-9
    pairs = written(near.withColumnRenamed("id", "a").join(other, "s").filter(enough & F.expr("c <> d and a > b")).select("a", "b").distinct())
    discard(first)
    return pairs


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, n_checked_links) for each row of `docs`: the least id of its near-duplicate class, and how
    many other distinct texts were linked to its text while the class was found (not all of a class's links).

    Pass 1 checks each bucket's members against its central one, which shares the most buckets with
    others: the text that a group of near copies was made from. Pass 2 looks, among the other members of
    buckets that are still in more than one class, for all links across classes. So no candidate link
    between two classes is lost, and a bucket of one class (the large ones) costs its size, not its square.

    Bands only, some 256 bytes a text, are kept for all texts; those that share a band with another text
    fetch their words by one join on the id.
    """
    rows = _prepared(docs, id_col, text_col)
    signed = written(_hashed(rows).mapInArrow(freed(_signed), "id long, content binary, bands array<long>"))
    usable = signed.filter("id is not null and content is not null")
    # rows that share an id count as one document, linked if any of their texts is
    copies = written(usable.groupBy("content").agg(F.min(F.struct("id", "bands")).alias("x")).select("content", "x.id", "x.bands"))
    bands = copies.select("id", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(bands.join(sizes, "band"))
    needed = rows.filter("content is not null").join(shared.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "content"])
    texts = written(_hashed(needed).mapInArrow(freed(_shingled), "id long, size long, shingles binary"))

    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = written(shared.join(weight, "id").groupBy("band").agg(F.max_by("id", F.struct(F.col("weight"), -F.col("id"))).alias("hub")))
    others = written(shared.join(hubs, "band").filter("id <> hub").select("band", "id", "hub"))
    pairs = others.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
    links = verify(pairs, texts, threshold)
    found = written(connected(links))

    # all members were compared with the central one; what is open are links between the others
    where = others.join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    split = where.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("band")
    open_rows = written(where.join(split, "band", "left_semi").select("id", "c").distinct())
    if not open_rows.isEmpty():
        more = verify(across(open_rows, texts, threshold), texts, threshold)
        if not more.isEmpty():
            links = links.unionByName(more)
            found = written(connected(links))
    discard(texts, shared, hubs, others, open_rows)

    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_checked_links"))
    joined = found.join(degree, "id").withColumnRenamed("id", "first")
    of_text = copies.select("content", F.col("id").alias("first")).join(joined, "first", "left").select("content", F.coalesce("component", "first").alias("class_id"), F.coalesce("n_checked_links", F.lit(0)).cast("long").alias("n_checked_links"))
    known = usable.select("id", "content").join(of_text, "content").select("id", "class_id", "n_checked_links")
    rest = signed.filter("id is null or content is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_checked_links"))
    return known.unionByName(rest)
