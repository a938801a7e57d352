"""op7 finds every link of clustered vectors and of a dense group, through the graph."""

import numpy as np
import pytest

from millrace.llm import hnsw


def _vectors(kind: str) -> np.ndarray:
    rng = np.random.default_rng(1)
    if kind == "clusters":
        x = rng.normal(size=(60, 64))[np.arange(3000) % 60] + rng.normal(size=(3000, 64)) * 0.3
    else:
        x = np.concatenate([rng.normal(size=(1, 64)) + rng.normal(size=(700, 64)) * 0.15, rng.normal(size=(800, 64))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["clusters", "dense"])
def test_no_link_is_lost(spark, kind, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 300)
    monkeypatch.setattr(hnsw, "GATHER", 2)
    x = _vectors(kind)
    near = x @ x.T >= hnsw.COSINE
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(table).collect()}
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate((near.sum(1) - 1).tolist()))
    root = np.arange(len(x))
    while True:
        new = np.where(near, root[None], len(x)).min(1)
        if (new == root).all():
            break
        root = new
    assert {i: c for i, (_, c) in got.items()} == dict(enumerate(root.tolist()))


def _widths(graph) -> list[int]:
    """Grows by the width of every query's beam, whenever `graph` is asked."""
    widths = []
    for name in ("within", "wider"):
        search = getattr(graph, name)
        setattr(graph, name, lambda q, width, limit, at=None, search=search: (widths.extend([width] * len(q)), search(q, width, limit, at))[1])
    return widths


def test_beams_stay_narrow():
    """Beams are widened for the queries that lack a link, not for their block, and none ends in a scan."""
    x = _vectors("clusters")
    graph = hnsw.Graph(x)
    stored = graph.saved()
    graph = hnsw.Graph.load(stored["x"], stored["links"], stored["levels"], stored["entry"], len(x))
    widths = _widths(graph)
    found = sum(len(hnsw.links_of(graph, x[i : i + 512], 0.93)[0]) for i in range(0, len(x), 512))
    assert found == (x @ x.T >= 0.93).sum() and max(widths) <= 256 and sum(w > 32 for w in widths) < 30


def test_vectors_apart():
    """Where nothing is near, a vector's search begins at itself and ends there: no beam is widened."""
    x = np.random.default_rng(3).normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    stored = graph.saved()
    graph = hnsw.Graph.load(stored["x"], stored["links"], stored["levels"], stored["entry"], len(x))
    widths = _widths(graph)
    rows, found = hnsw.links_of(graph, x[512:1024], 0.93, np.arange(512, 1024))
    assert (rows + 512 == found).all() and len(rows) == 512 and set(widths) == {32}


def test_a_link_out_of_a_crowd():
    """A vector amid copies of itself has one more link, away from them: a wider beam finds it, in few waves."""
    rng = np.random.default_rng(5)
    crowd = rng.normal(size=64) + rng.normal(size=(600, 64)) * 0.02
    across = rng.normal(size=64)
    across -= crowd[0] * (across @ crowd[0]) / (crowd[0] @ crowd[0])
    unit = crowd[0] / np.linalg.norm(crowd[0])
    lone = 0.931 * unit + np.sqrt(1 - 0.931**2) * across / np.linalg.norm(across)
    x = np.concatenate([crowd, lone[None], rng.normal(size=(2000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    stored = hnsw.Graph(x).saved()
    graph = hnsw.Graph.load(stored["x"], stored["links"], stored["levels"], stored["entry"], len(x))
    widths = _widths(graph)
    truth = x @ x.T >= 0.93
    found = np.zeros_like(truth)
    for i in range(0, len(x), 512):
        rows, near = hnsw.links_of(graph, x[i : i + 512], 0.93, np.arange(i, min(i + 512, len(x))))
        found[i + rows, near] = True
    assert (found == truth).all() and truth[0, 600] and max(widths) < len(x)
    rows, near = graph.wider(x[:600], 64, 0.93, np.arange(600))
    assert len(rows) == truth[:600].sum()
