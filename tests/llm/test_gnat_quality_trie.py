"""op11 to op13 against brute force, with nulls, ties, repeats, hot groups, long rows, clashing columns and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import gnat, prefix_trie, quality
from millrace.llm import queries as registered

VECTORS = "vec_id long, embedding array<double>, label int, score string"


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 0.4
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.1).tolist(), int(rng.integers(0, 10)), "x") for i in range(2400)]
    rows += [(3000 + i, rows[7][1], int(rng.integers(0, 3)), "x") for i in range(1300)]  # one vector, a third of all rows
    rows += [(5000 + i, [0.5, -0.25][: i % 3], 1, None) for i in range(30)]  # other lengths
    rows += [(6000, None, 1, "x"), (6100, [float("nan")] * 16, 1, "x"), (6200, [None] * 16, 1, "x"), (6300, [0.1] * 16, None, "x"), (None, [0.1] * 16, 1, "x")]
    rows += [(100, rows[100][1], rows[100][2], "x"), (200, [9.0] * 16, 99, "x"), (6400, [1e30] * 16, 1, "x")]
    rows += [(7000 + i, [float(2**20 + i)] * 16, i % 2, "x") for i in range(4)] + [(6500, [float(2**20)] * 16, 0, "x")]
    return rows


def mined(rows):
    """Everything against everything, with Python's whole numbers."""
    fine = {}
    for i, v, label, _ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(x) >= 2**23 for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        fine[i] = min(row, fine.get(i, row))
    by = collections.defaultdict(list)
    for i, (label, v) in fine.items():
        by[len(v)].append((i, label, v))
    out = []
    for n, group in by.items():
        ids, labels = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        every = np.array([g[2] for g in group], dtype=object).reshape(len(group), n)
        for i, label, v in group:
            if i % 100:
                continue
            score = every @ np.array(v, dtype=object) if n else np.zeros(len(group), dtype=object)
            near = sorted((-score[k], ids[k]) for k in range(len(ids)) if labels[k] == label and ids[k] != i)[:5]
            other = sorted((-score[k], ids[k]) for k in range(len(ids)) if labels[k] != label)
            for p, j in near:
                found = [(s, k) for s, k in other if 80 * -p <= 100 * -s <= 100 * -p][:5]
                out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(found, 1)]
    return sorted(tuple(map(int, x)) for x in out)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(gnat, "SHARD", 500)
    rows = vectors()
    got = gnat.hard_negatives(gnat.usable(spark.createDataFrame(rows, VECTORS).repartition(5)), F.col("id") % 100 == 0)
    found = sorted(tuple(r) for r in got.collect())
    assert found == mined(rows) and len(found) > 300
    assert gnat.hard_negatives(gnat.usable(spark.createDataFrame([], VECTORS)), F.col("id") % 100 == 0).count() == 0
    assert gnat.hard_negatives(gnat.usable(spark.createDataFrame(rows[:1], VECTORS)), F.col("id") % 100 == 0).count() == 0


def test_tree_passes_over_subtrees():
    """Clusters that are far off aren't scanned, and what is found is what a scan finds."""
    rng = np.random.default_rng(2)
    v = np.floor(256 * (rng.normal(size=(40, 8)).repeat(100, 0) + rng.normal(size=(4000, 8)) * 0.02))
    norm2 = float((v * v).sum(1).max())
    tree = gnat.Tree(np.arange(4000), np.zeros(4000, int), v, norm2, 6)
    score = v[:50] @ v.T
    high = np.sort(score, 1)[:, -40].astype(int)
    q = gnat.Questions(np.arange(50) - 100, np.ones(50, int), v[:50], high - 2000, high, False, 5, norm2)
    seen, meet = [], gnat.Questions.meet
    q.meet = lambda at, ids, *rest: (seen.append(len(at) * len(ids)), meet(q, at, ids, *rest))
    tree.ask(q)
    assert sum(seen) < 0.5 * score.size
    for i in range(50):
        fine = [k for k in range(4000) if high[i] - 2000 <= score[i, k] <= high[i]]
        want = sorted(fine, key=lambda k: (-score[i, k], k))[:5]
        assert [x for x in q.found[i] if x < 4000] == want


GAP = re.compile(r"[\x20\x09-\x0D]+")


def judged(rows):
    """quality.assess by loops."""
    normal = lambda x: re.sub("[0-9]+", "0", GAP.sub(" ", x.lower())).strip(" ")
    texts, lines = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for x in (text or "").split("\n"):
            if normal(x):
                lines[host, normal(x)].add(text or "")
    out = []
    for i, text, host in rows:
        text = text or ""
        words = [w for w in GAP.split(text) if w]
        windows = collections.defaultdict(list)
        for k in range(len(words) - 4):
            windows[tuple(words[k : k + 5])].append(k)
        covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
        own = [x for x in text.split("\n") if GAP.sub("", x)]
        cut = lambda x: bool(normal(x)) and len(lines[host, normal(x)]) > 10 and 100 * len(lines[host, normal(x)]) > 5 * len(texts[host])
        gone = sum(len([w for w in GAP.split(x) if w]) for x in text.split("\n") if cut(x))
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        kept = not failed and 100 * (len(words) - gone) >= 30 * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(own) - len(set(own)), len(covered), failed, gone, kept, "\n".join(x for x in text.split("\n") if not cut(x))))
    return sorted(out, key=str)


def test_quality(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("w" + str(x) + "é" * (x % 3) for x in rng.integers(0, 5000, n))
    rows = [(i, f"{prose(30)}\nRead  more in Issue {i}\n{prose(12)}", "a") for i in range(40)]
    rows += [(100 + i, f"read more in issue 7 \n\t\nREAD MORE IN ISSUE {i}\n{prose(3)}\nRead more in issue 1 and {i}", "a") for i in range(20)]
    rows += [(200 + i, f"read more in issue {i}\n{prose(30)}", "b") for i in range(9)] + [(300, "read more in issue 1", None)]
    rows += [(400, None, "a"), (401, "", "a"), (402, " \n\t\r\n", None), (403, "a b c d e f a b c d e", "a"), (404, "x " * 500, "b"), (405, "# * $% & |<> x\x1cy", "b"), (None, prose(20), "a")]
    rows += [(500 + i, "the same clean text of more than ten words in a row, copied often", "c") for i in range(60)]  # copies are one text
    rows += [(600, prose(60_000) + "\n" + prose(20) * 2, "c"), (601, "\n".join(prose(6) for _ in range(4000)), "c"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, kept string, n_words int").repartition(6)
    got = [tuple(r) for r in quality.assess(docs).collect()]
    assert sorted(got, key=str) == judged(rows)
    assert sum(r[7] > 0 for r in got) == 62 and sum(not r[8] and not r[6] for r in got) == 20
    assert quality.assess(docs.limit(0)).count() == 0


def test_quality_is_native(spark):
    plan = quality.assess(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, source string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def trie(rows):
    """Every node by loops over all prefixes."""
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            told = f"{len(role or '')}:{role or ''}{text or ''}"
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(told.encode()).digest(), role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if whole[c] == p))).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], ends(p)) for p, cs in members.items())


def talks():
    rng = np.random.default_rng(8)
    rows = []
    for c in [*range(60), *range(100, 160), *range(205, 240), -3, -150, -200, 10**12]:
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {rng.integers(0, 3)} é") for t in range(int(rng.integers(0, 9)))]
    rows += [(1000 + c, t, "user", f"the same {t}") for c in range(200) for t in range(4)]  # one conversation, half of all
    rows += [(2000, t, "user", f"long {t % 7}") for t in range(400)]
    rows += [(3000, None, "user", "a"), (3000, 5, None, None), (3000, 5, "", ""), (3000, 5, "user", "b"), (3000, -1, "user", None), (None, 1, "user", "lost"), (3001, 0, "user", "x" * 50_000)]
    return rows + rows[:3]


SCHEMA = "conv_id long, turn long, role string, text string, depth int, ids string"


@pytest.mark.parametrize("shard", [1, 40, 500_000])
def test_trie(spark, shard):
    rows = talks()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.sequences(table)), shard)
    assert sorted(tuple(r) for r in got.collect()) == trie(rows)
    if shard == 1:
        assert prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.sequences(table.limit(0)))).count() == 0


def test_turnless(spark):
    """A conversation that is left without turns is a member of the root, which is childless."""
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.sequences(spark.createDataFrame([(c, 0, "user", "gone", 1, "x")], SCHEMA))))
    assert [tuple(r) for r in got.collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_sql_of_planted_tables(spark, tmp_path):
    """The registered queries give their SQL's rows on planted conversations and vectors."""
    import duckdb

    rows = [r for r in talks()[:-3] if r[0] != 3000]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    fine = [r[:3] for r in vectors()[:2400]] + [r[:3] for r in vectors() if r[0] and 5000 < r[0] <= 6300]
    spark.createDataFrame(fine, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("op11_gnat_hard_negatives", "op13_prefix_trie"):
        got = registered.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registered.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
