"""The operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats and empty tables."""

import base64
import collections
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, components, hnsw, langid, licenses, minhash, mixing, packing, pii, secrets
from millrace.llm import queries as registered

SF = "/root/testdata/sf0.001"
DATA = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
ENCODING = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [None, "", " ", "\n\n", "a" * 3000, "ab" * 700, "你好世界" * 50, "\x1c\x1d a\x85 b", "it's I'D <|endoftext|> 😀😀 ½²x Ⅷ", "!" * 500, "é́", " " * 400]


def docs_of(spark, rows):
    """documents, with an extra column whose name clashes with columns that operators make."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_bpe(spark, texts):
    rows = [*enumerate(ODD), *((100 + i, t) for i, t in texts.items()), (100 + min(texts), texts[min(texts)])]
    got = bpe.digests(docs_of(spark, rows), DATA, P.PATTERN).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        ids = ENCODING.encode_ordinary(by[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((by[r.doc_id] or "").encode()).hexdigest()
    coded = bpe.encode(docs_of(spark, list(enumerate(ODD))), DATA, P.PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(coded, DATA, P.PATTERN).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.digests(docs_of(spark, []), DATA, P.PATTERN).count() == 0


def test_bpe_large_ids(spark):
    """Ids beyond 2^17 keep their pairs apart."""
    shift = 150_000
    data = b"\n".join(base64.b64encode(t) + b" " + str(i + shift).encode() for t, i in RANKS.items())
    rows = [(i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: r.ids_sha256 for r in bpe.digests(docs_of(spark, rows), data, P.PATTERN).collect()}
    assert got == {i: hashlib.sha256(",".join(str(x + shift) for x in ENCODING.encode_ordinary(t or "")).encode()).hexdigest() for i, t in rows}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.connected(spark.createDataFrame([*edges, (5, None)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(texts):
    shingled = {}
    for i, t in texts.items():
        w = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        shingled[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in shingled if shingled[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = shingled[a], shingled[b]
            if 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


def test_minhash(spark, texts):
    base = " ".join(f"w{i}" for i in range(400))
    near = {1000 + i: base.replace(f"w{7 * i + 3} ", "z ") for i in range(40)}  # copies of a text that differ from each other twice as much
    some = texts | near | {2000: base, 2001: base.upper() + "!", 2002: None, 2003: "", 2004: "one two", 2005: "One, two.", 2006: "..."}
    rows = [*some.items(), (2004, "one two")]
    got = minhash.classes(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.id: r.class_id for r in got} == brute_classes(some)
    assert minhash.classes(docs_of(spark, [])).count() == 0
    assert minhash.classes(docs_of(spark, [(None, "a b c d e f"), (3, "a b c d e f")])).filter("id is null").first().class_id is None


def test_minhash_repeated_passages(spark):
    """Each pair's first text says its passage 50 times, the second once; as sets they are 0.817 alike, by weight 0.7."""
    some = {}
    for i in range(200):
        passage, rest = ([f"{kind}{i}x{k}" for k in range(size)] for kind, size in (("p", 120), ("r", 100)))
        other = ["z" if k % 25 == 12 else w for k, w in enumerate(rest)]
        some |= {2 * i: " ".join(passage * 50 + rest), 2 * i + 1: " ".join(passage + other)}
    got = {r.id: r.class_id for r in minhash.classes(docs_of(spark, [*some.items()])).collect()}
    assert got == {i: i - i % 2 for i in some}
    assert {i: got[i] for i in range(20)} == brute_classes({i: some[i] for i in range(20)})


def test_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = np.arange(0, 300, dtype=np.uint64), np.arange(60, 340, dtype=np.uint64)
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 280).astype(float)
    keys = minhash.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], [300, 280]), 2, 4096)
    names = keys & np.uint64((1 << minhash.NAME_BITS) - 1)
    assert abs((names[0] == names[1]).mean() - minhash.probability_jaccard(a, wa, b, wb)) < 0.03


def test_packing(spark, texts):
    rows = [(i, ENCODING.encode_ordinary(t or "")) for i, t in {**texts, 9001: "", 9002: None}.items()]
    coded = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    packed = packing.pack(coded, 256)
    assert {r.doc_id: r.ids for r in packing.unpack(packed).collect()} == {i: x for i, x in rows if x}
    for r in packed.collect():
        ends, places = r.cu_seqlens, np.frombuffer(r.positions, "<u2")
        assert len(r.ids) == 512 and ends[0] == 0 and ends[-1] == r.n_tokens <= 256
        assert all(places[a:b].tolist() == list(range(b - a)) for a, b in zip(ends, ends[1:]))
    assert packing.pack(coded.limit(0), 256).count() == 0


def test_best_fit():
    sizes = np.random.default_rng(2).integers(1, 101, 500)
    rows = packing.best_fit(sizes, 100)
    assert sorted(i for r in rows for i in r) == list(range(500)) and all(sizes[r].sum() <= 100 for r in rows)
    free: list[int] = []  # best fit decreasing by brute force
    for s in sorted(sizes.tolist(), reverse=True):
        room = [c for c in free if c >= s]
        if room:
            free.remove(min(room))
        free.append((min(room) if room else 100) - s)
    assert len(rows) == len(free)


def test_language(spark, docs):
    got = registered.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    test = [r for r in got if r.held_out]
    assert test and sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    model = langid.fit(docs)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs_of(spark, [(1, None), (2, ""), (3, "12 !"), (4, "the " * 200_000)]), model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[4][0] == "en"
    assert langid.predict(docs_of(spark, [(1, "a")]), langid.fit(docs_of(spark, []))).first().lang_pred == "und"


def test_many_languages(spark):
    rng = np.random.default_rng(5)
    words = [["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(20)] for _ in range(70)]
    rows = [(n * 10 + k, " ".join(rng.choice(words[n], 200)), f"l{n:02}") for n in range(70) for k in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(frame, langid.fit(frame)).collect()
    assert all(r.lang == r.lang_pred for r in got)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_ann(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = frame.collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in table}
    got = collections.defaultdict(list)
    for r in registered.op5_additive_quantisation(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in (i for i in x if i % 20 == 0):
        best = sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:20]
        hit += len({i for _, i in best} & {i for i, _ in got[q]})
        assert len(got[q]) == 20 and all(abs(s - x[q] @ x[i]) < 1e-9 for i, s in got[q])
    assert hit / (20 * len(got)) >= 0.9


def test_ann_audit(spark):
    """Uniform directions, of which far fewer than the first candidates suffice at first: the audit doubles them until recall holds."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    frame = vectors_of(spark, [(i, [float(c) for c in v], 1) for i, v in enumerate(x)])
    v = ann.usable(frame)
    got = collections.defaultdict(set)
    for r in ann.search(v, v.filter("id % 20 = 0"), 20, refine=25).collect():
        got[r.query_id].add(r.id)
    near = x.astype(np.float64) @ x[::20].astype(np.float64).T
    near[np.arange(0, 6000, 20), np.arange(300)] = -np.inf
    best = np.argsort(-near, axis=0, kind="stable")[:20].T
    assert sum(len(got[20 * q] & set(b.tolist())) for q, b in enumerate(best)) / 6000 >= 0.93


def test_ann_sizes(spark):
    """Finite components beyond single precision, tiny ones, other lengths, repeated rows, clashing columns, no usable query."""
    rows = [(i, [float(i), 1.0], 1) for i in range(1, 30)] + [(40, [1e300, 0.0], 1), (41, [1e-300, 0.0], 1), (42, [1.0], 1), (20, [20.0, 1.0], 1)]
    frame = spark.createDataFrame([(i, v, c, "x", "y") for i, v, c in rows], "vec_id long, embedding array<double>, label int, part string, ids string")
    v = ann.usable(frame)
    got = {(r.query_id, r["rank"]): r.id for r in ann.search(v, v.filter("id = 20"), 3).collect()}
    assert got == {(20, 1): 40, (20, 2): 29, (20, 3): 28}
    assert ann.search(v, v.filter("id = 42"), 3).count() == ann.search(v, v.filter("id = -1"), 3).count() == 0


def test_ann_odd(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1), (7, [-1.0, 0.5], None)]
    v = ann.usable(vectors_of(spark, rows))
    got = [(r.query_id, r["rank"], r.id) for r in ann.search(v, v.filter("id = 0"), 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 7)]
    none = ann.usable(vectors_of(spark, []))
    assert ann.search(none, none, 20).count() == 0


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "print(1)"), ("a/b/c/y.py", "text.\nLicensed under the Apache License, Version 2.0.\nmore text of no meaning at all"), ("a/b/c/z.py", None), ("d/w.py", "nothing here about it"), (None, "x"), ("e/GPL", "This work is licensed under the GNU General Public License, version 3."), ("e/v", "")]
    got = {r.path: (r.licence, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/LICENSE"][0] == "MIT" and got["a/b/x.py"] == ("MIT", "inherited") and got["a/b/c/y.py"] == ("Apache-2.0", "header")
    assert got["a/b/c/z.py"] == ("MIT", "inherited") and got["d/w.py"] == got[None] == (None, None) and got["e/v"] == ("GPL-3.0", "inherited")
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_licences_brute(spark, docs, texts):
    """Every piece's cosines by brute force over all terms; wrapped headers, SPDX lines, whole licence files, clashing columns, repeats."""
    import math

    from millrace.llm.licence_texts import TEMPLATES

    mit = next(t for n, t in TEMPLATES if n == "MIT" and t.endswith("IN THE SOFTWARE."))
    apache = next(t for n, t in TEMPLATES if n == "Apache-2.0" and "governing" in t)

    def wrapped(t, mark, width=60):
        lines, line = [], ""
        for w in t.split():
            if len(line) + len(w) > width:
                lines, line = [*lines, mark + line], ""
            line += w + " "
        return "\n".join([*lines, mark + line])

    rows = [("p/LICENSE", "The MIT License\n\nCopyright (c) 2024 Someone\n\n" + wrapped(mit, "")), ("p/a/b/c.py", "x = 1"), ("q/a.c", "/*\n" + wrapped(apache, " * ") + "\n */\nint main;"), ("q/b.py", "# SPDX-License-Identifier: GPL-2.0-or-later\nx"), ("t/c.py", "# copyright of nobody, permission to be asked"), ("s/d.sh", wrapped(next(t for n, t in TEMPLATES if n == "ISC"), "# ")), ("r/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy"), ("r/x", None), ("r/x", None)]
    rows += [(f"docs/{i}", t) for i, t in texts.items()]
    frame = spark.createDataFrame([(p, t, i, "a") for i, (p, t) in enumerate(rows)], "path string, text string, content int, own string")
    got = licenses.scan(frame, carry=("content", "own")).collect()
    assert len(got) == len(rows) and all(r.own == "a" for r in got)
    by = {r.path: (r.licence, r.origin) for r in got}
    assert by["p/LICENSE"] == ("MIT", "file") and by["p/a/b/c.py"] == ("MIT", "inherited") and by["q/a.c"][0] == "Apache-2.0" and by["q/b.py"] == ("GPL-2.0", "header")
    assert by["t/c.py"] == (None, None) and by["s/d.sh"][0] == "ISC" and by["r/COPYING"][0] == "GPL-3.0" and by["r/x"] == ("GPL-3.0", "inherited")

    def terms(t):
        return re.sub(r"[^\w]+|_", " ", (t or "").lower()).split()

    vocabulary = {w for _, t in TEMPLATES for w in terms(t)}
    df = collections.Counter(w for _, t in rows for w in set(terms(t)) & vocabulary)
    idf = {w: math.log((len(rows) + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    mean = sum(idf.values()) / len(idf)

    def vector(t):
        v = {w: (1 + math.log(n)) * idf.get(w, mean) for w, n in collections.Counter(terms(t)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    known = [(n, vector(t)) for n, t in TEMPLATES]
    marked = frame.filter(F.col("text").rlike(licenses.TRIGGER)).select(F.col("path").alias("content"), "text")
    every = licenses.pieces(marked).select(F.struct("content", "piece").alias("key"), F.col("piece").alias("text")).distinct()
    near = {tuple(r.key): (r.licence, r.cosine) for r in licenses.similar(every, licenses.frequencies(frame)).collect()}
    for (path, piece), (licence, cosine) in near.items():
        v = vector(piece)
        best = max(sum(x * k.get(w, 0) for w, x in v.items()) for _, k in known)
        assert abs(best - cosine) < 1e-9 and licence in {n for n, k in known if abs(sum(x * k.get(w, 0) for w, x in v.items()) - best) < 1e-9}
    assert len(near) > 30


def test_hnsw(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 16))
    x = [*(centre[i % 30] + rng.normal(size=16) * 0.12 for i in range(600))]
    rows = [(i, [float(np.float32(c)) for c in v], i % 3 if i % 50 else None) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[1][1], 1) for i in range(20)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("inf")] * 16, 1), (2003, [1.0], 1)]
    u = {i: np.array(v, np.float64) / np.linalg.norm(v) for i, v, label in rows if v and label is not None and np.isfinite(v).all() and any(v) and len(v) == 16}
    label = {i: b for i, _, b in rows}
    links = {i: [j for j in u if j != i and label[i] == label[j] and u[i] @ u[j] >= 0.93] for i in u}
    root = {i: i for i, _, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, near in links.items():
        for j in near:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    old = hnsw.SHARD
    hnsw.SHARD = 60  # several shards a label
    try:
        got = {r.id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(vectors_of(spark, rows)).collect()}
    finally:
        hnsw.SHARD = old
    assert got == {i: (len(links.get(i, [])), find(i)) for i, _, _ in rows}
    assert hnsw.near_duplicates(vectors_of(spark, [])).count() == 0


def test_pii(spark):
    rows = [(1, "mail Ann.Lee7@mail.example.com, ANN.LEE7@MAIL.EXAMPLE.COM and b@c.org"), (2, "call +1 (017) 555-7713 or +1 (017) 555-7713; ip 10.20.30.40 and 1.2.3.4.5"), (3, "card 4264645872074229 or 4264 6458 7207 4229, not 9177399536541148"), (4, "Mrs. Jane Miller met Mr. Miller and Dr. Kim"), (5, None), (6, ""), (7, "nothing 123 at all"), (7, "nothing 123 at all"), (8, "x" * 50_000 + " a1@b2.net"), (9, "Анна Иванова пришла"), (10, "ssn 123-45-6789")]
    got = {r.doc_id: r for r in pii.replaced(docs_of(spark, rows), "k").collect()}
    a, b, c = re.search(r"mail (\S+), (\S+) and (\S+)", got[1].text).groups()
    assert b == a.upper() and a.lower() != "ann.lee7@mail.example.com" and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@[a-z]{4}\.[a-z]{7}\.com", a) and c != "b@c.org" and got[1].n_entities == 3
    m = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \(\d{3}\) \d{3}-\d{4}); ip (\d+\.\d+\.\d+\.\d+) and 1\.2\.3\.4\.5", got[2].text)
    assert m and m[1] == m[2] != "+1 (017) 555-7713" and m[3] != "10.20.30.40"
    m = re.fullmatch(r"card (\d{16}) or (\d{4} \d{4} \d{4} \d{4}), not 9177399536541148", got[3].text)
    digits = [int(d) for d in m[1]][::-1]
    assert m[2].replace(" ", "") == m[1] != "4264645872074229" and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) and Dr\. (\w+)", got[4].text)
    assert m and m[1] in pii.GIVEN["f", "latin"] and "Miller" not in got[4].text and "Kim" not in got[4].text
    assert got[5].text is None and got[6].text == "" and got[7].text == "nothing 123 at all" and "a1@b2.net" not in got[8].text
    first, last = got[9].text.split()[:2]
    assert first in pii.GIVEN["f", "cyrillic"] and re.fullmatch(r"[А-Я][а-я]+", last)
    assert "123-45-6789" not in got[10].text
    assert pii.replaced(docs_of(spark, []), "k").count() == 0


def test_pii_coreference(spark):
    rows = [(1, "John Smith came. Later Mr. Smith left; Smith, said Anna Smith, was John Smith. The Smithers stayed."), (2, "Dr. Wei Zhang and Priya Patel met Mr Smith. Name: Kwame Okafor. Okafor!"), (3, "call +44 20 7946 0958 or +442079460958"), (4, "IBAN GB82 WEST 1234 5698 7654 32 not GB83 WEST 1234 5698 7654 32")]
    frame = docs_of(spark, rows).withColumns({"content": F.lit("c"), "new": F.lit("n"), "n_entities": F.lit("old"), "row": F.lit("r")})
    out = pii.replaced(frame, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [c for c in frame.columns if c != "n_entities"] + ["n_entities"] and got[1].content == "c" and got[1].new == "n" and got[1].row == "r"
    m = re.fullmatch(r"([\w-]+) (\w+) came\. Later Mr\. (\w+) left; (\w+), said ([\w-]+) (\w+), was ([\w-]+) (\w+)\. The Smithers stayed\.", got[1].text)
    assert m and len({m[2], m[3], m[4], m[6], m[8]}) == 1 and m[2] != "Smith" and m[1] == m[7] != m[5] and got[1].n_entities == 5
    assert all(n in pii.GIVEN["m", "latin"] for n in m[1].split("-")) and all(n in pii.GIVEN["f", "latin"] for n in m[5].split("-"))
    n = re.fullmatch(r"Dr\. [\w-]+ (\w+) and [\w-]+ (\w+) met Mr (\w+)\. Name: [\w-]+ (\w+)\. (\w+)!", got[2].text)
    assert n and n[3] == m[2] and n[4] == n[5] and len({n[1], n[2], n[3], n[4]}) == 4 and not {"Zhang", "Patel", "Smith", "Okafor"} & {*n.groups()}
    p = re.fullmatch(r"call \+44 (\d\d) (\d{4}) (\d{4}) or \+44(\d{10})", got[3].text)
    assert p and p[1] + p[2] + p[3] == p[4] != "2079460958"
    i = re.fullmatch(r"IBAN (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) not GB83 WEST 1234 5698 7654 32", got[4].text).group(1).replace(" ", "")
    assert i != "GB82WEST12345698765432" and int("".join(str(int(c, 36)) for c in i[4:] + i[:4])) % 97 == 1
    assert {r.doc_id: r.text for r in pii.replaced(frame, "other").collect()}[1] != got[1].text


def test_pii_corpus(spark, docs, texts):
    """Whole tables by brute force: what the patterns find goes, the rest of a text stays, entities and surrogates match one to one."""
    got = {r.doc_id: r for r in pii.replaced(docs, "k").collect()}
    there = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w.-]*\w\.[^\W\d_]{2,}|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")
    pairs = set()
    for i, t in texts.items():
        was, now = there.findall(t), there.findall(got[i].text)
        assert len(was) == len(now) and (got[i].n_entities >= len(was))
        pairs |= set(zip(map(str.lower, was), map(str.lower, now)))
        assert was or got[i].n_entities or got[i].text == t
    assert pairs and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and not {a for a, _ in pairs} & {b for _, b in pairs}


def test_pii_distinct(spark):
    rows = spark.range(3000).select(F.lit("ssn").alias("kind"), F.lpad(F.col("id").cast("string"), 4, "0").alias("canonical"), F.lit("n").alias("sex"), F.lit("latin").alias("script"))
    names = spark.range(3000).select(F.explode(F.array(F.lit("given"), F.lit("surname"))).alias("kind"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("canonical"), F.lit("m").alias("sex"), F.lit("latin").alias("script"))
    got = pii.surrogates(names.unionByName(rows.limit(400)), "k")
    assert got.count() == got.select("kind", F.lower("surrogate")).distinct().count() == 6400
    assert got.join(rows.limit(400).select(F.col("canonical").alias("surrogate")), "surrogate", "left_semi").filter("kind = 'ssn'").count() == 0
    # more entities than half of the space: longer numbers are drawn, and no one's own value
    own = rows.filter("canonical < '0900'").withColumn("canonical", F.substring("canonical", 2, 3))
    phones = spark.createDataFrame([("phone", "+1", "n", "latin"), ("phone", "+4412", "n", "latin")], own.schema)
    full = pii.surrogates(own.unionByName(phones), "k").collect()
    real = {r.canonical for r in full}
    assert len(full) == len({(r.kind, r.surrogate) for r in full}) == 902 and not real & {r.surrogate for r in full}


def length(n):
    return bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")


def der(tag, *parts):
    body = b"".join(parts)
    return bytes([tag]) + length(len(body)) + body


def test_secrets(spark):
    rsa = der(0x30, der(2, b"\0"), *(der(2, bytes([1]) + b"\x11" * 63) for _ in range(8)))
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, b"\x07" * 32)))
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32))
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"1"}', b"s" * 32))
    fake = base64.b64encode(b"just some words that are no key at all, long enough").decode()
    good = [base64.b64encode(rsa).decode(), pkcs8.hex(), base64.b64encode(ssh).decode(), token, "-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(pkcs8).decode() + "\n-----END PRIVATE KEY-----"]
    rows = [*enumerate(good), (10, fake), (11, None), (12, ""), (13, 'éé Token = "abcdef" password: x secret:abcde AKIA' + "A" * 16 + " " + "0f" * 12), (13, "plain"), (14, "a" * 24 + "ſecret=abcdefgh")]
    got = collections.defaultdict(list)
    for r in secrets.digests(docs_of(spark, rows)).collect():
        got[r.doc_id].append(r)
    kinds = {i: {s.split(":")[0] for s in got[i][0].spans.split(",")} for i in range(5)}
    assert "der" in kinds[0] and "der" in kinds[1] and "ssh" in kinds[2] and "jwt" in kinds[3] and "pem" in kinds[4]
    assert got[10][0].spans == got[11][0].spans == got[12][0].spans == ""
    base = next(r for r in got[13] if r.n_assign)
    assert (base.n_assign, base.n_access, base.n_hex) == (1, 1, 1) and base.spans.startswith("assign:3:18,")
    assert got[14][0].n_assign == 0 and got[14][0].n_hex == 1
    assert base.base_sha256 == hashlib.sha256(base.spans.encode()).hexdigest()
    assert secrets.scan(docs_of(spark, rows)).filter("doc_id = 3 and kind = 'jwt'").count() == 1


def test_mixing(spark, docs):
    odd = spark.createDataFrame([(90_000, None, "src1"), (90_001, "", None), (90_002, "a b c", None), (90_003, "word " * 5000, None), (90_003, "word " * 5000, None)], "doc_id long, text string, source string")
    frame = docs.select("doc_id", "text", "source").unionByName(odd)
    got = [r.asDict() for r in mixing.mix(frame).collect()]
    again = sorted((r["doc_id"], r["taken"]) for r in got)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(frame.repartition(7)).collect()) == again
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in frame.collect()}
    taken, total, target = collections.Counter(), collections.Counter(), {}
    source = {r.doc_id: r.source for r in frame.collect()}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        total[s] += r["size"]
        target[s] = r["target"]
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(total.values()), set(order), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]:
        for s in over:
            want[s] = 2 * total[s]
        left -= sum(want[s] for s in over)
        free -= set(over)
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in order:
        own = [r["size"] for r in got if source[r["doc_id"]] == s and r["size"]]
        rest = int(target[s]) % total[s]
        sums = {0}
        for n in own:
            sums |= {x + n for x in sums if x + n <= rest}
        assert abs(target[s] - want[s]) < 1e-6 and taken[s] == int(target[s]) - rest + max(sums)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 60, 6))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 10))
        take = mixing.fit(lengths, counts, budget, 1)
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            reach = {r + n * k for r in reach for k in range(c + 1)}
        assert (take <= counts).all() and (take * lengths).sum() == max(r for r in reach if r <= budget)


def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    base = " ".join(f"the of and word{i}" for i in range(60))
    rows = [(i, t) for i, t in texts.items()] + [(5000, base), (5001, base + " end"), (5002, "12 34 !"), (5003, None)]
    frame = docs_of(spark, rows).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")))
    frame = frame.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("l")), "doc_id", "left").withColumn("lang", F.coalesce("l", "lang")).select("doc_id", "text", "lang", "source", "n_chars")
    step = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SF).write.parquet(str(tmp_path / name))
        step[name] = frame = spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id for r in step["language"].collect()} == {i for i, _ in rows} - {5002, 5003}
    classes = brute_classes({i: t for i, t in rows if i not in (5002, 5003)})
    assert {r.doc_id for r in step["near_duplicates"].collect()} == set(classes.values())
    assert step["personal_data"].count() == len(set(classes.values())) and step["personal_data"].columns == step["language"].columns
    number = collections.Counter(r.doc_id for r in step["mixture"].collect())
    assert set(number.values()) <= {1, 2}
    text = {r.doc_id: r.text for r in step["mixture"].collect()}
    out = step["tokens"].collect()
    assert len(out) == sum(number.values()) and all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in out)
