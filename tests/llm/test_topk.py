"""Exact top-k against all products."""

import math
import random

import numpy as np

from cadenza.llm import topk as topk_module
from cadenza.llm.topk import Tile, topk


def plain(rows, k=5):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_all_queries(spark):
    rng = random.Random(2)
    rows = [(i, [np.float32(rng.gauss(0, 0.13)).item() for _ in range(16)]) for i in range(900)]
    rows += [(i, [0.5, -0.25] * 8) for i in range(900, 1000)] + [(2000, None), (2050, []), (2100, [None] * 16), (2150, [float("nan")] * 16), (2200, [float("inf")] * 16), (3000, [1.0, 2.0]), (3001, [2.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk(vectors).collect())
    assert got == plain(rows)
    assert topk(vectors.limit(0)).collect() == []


def test_ties_and_large_numbers():
    x = np.array([[3, -2]] * 40 + [[2**40, 2**41]] * 3)
    tile = Tile(np.array([100]), np.array([[1, 1]]), 5)
    for lo in (20, 0, 40):
        tile.meet(np.arange(lo, min(43, lo + 20)), x[lo : lo + 20])
    assert tile.found.tolist() == [[40, 41, 42, 0, 1]] and tile.scores.tolist() == [[2**40 + 2**41] * 3 + [1, 1]]
    tile = Tile(np.array([100]), np.array([[2**40, 2**40]]), 1)
    tile.meet(np.arange(43), x)
    assert tile.scores.tolist() == [[2**63 - 1]]


def skewed(rng, n, d=64):
    """Components that fall off, and lengths that differ."""
    return np.floor(256 * rng.normal(0, 0.3, (n, d)) * 0.8 ** np.arange(d) * rng.lognormal(0, 0.7, (n, 1))).astype(np.int64)


def test_reads_fewer_components_than_the_product():
    rng = np.random.default_rng(3)
    x = skewed(rng, 12_000)
    q, k = x[::40], 5
    tile = Tile(np.arange(0, 12_000, 40), q, k)
    for lo in range(0, 12_000, 3_000):
        tile.meet(np.arange(lo, lo + 3_000), x[lo : lo + 3_000])
    scores = x @ q.T
    scores[np.arange(0, 12_000, 40), np.arange(len(q))] = -(1 << 62)
    for i in range(len(q)):
        best = np.lexsort((np.arange(12_000), -scores[:, i]))[:k]
        assert tile.found[i].tolist() == best.tolist() and tile.scores[i].tolist() == scores[best, i].tolist()
    assert tile.reads < 0.3 * q.shape[0] * x.size


def test_any_vectors():
    rng = np.random.default_rng(4)
    for t in range(150):
        n, d, m, k = rng.integers(1, 60), rng.integers(1, 20), rng.integers(1, 8), int(rng.integers(1, 7))
        x = rng.integers(-4, 5, (n, d)) * (2 ** rng.integers(0, 50, (1, d)) if t % 5 == 0 else 1)
        ids = rng.integers(0, 40, n)
        q, qids = rng.integers(-3, 4, (m, d)), np.arange(m) * 7
        tile = Tile(qids, q, k)
        cuts = np.sort(rng.integers(0, n + 1, 2))
        for lo, hi in zip([0, *cuts], [*cuts, n], strict=True):
            if hi > lo:
                tile.meet(ids[lo:hi], x[lo:hi])
        for i in range(m):
            want = sorted((-int(x[j].astype(object) @ q[i].astype(object)), int(ids[j])) for j in range(n) if ids[j] != qids[i])[:k]
            got = [(-int(s), int(v)) for s, v in zip(tile.scores[i][: tile.held[i]], tile.found[i], strict=False)]
            assert got == want


def test_tiles_ranges_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [np.float32(rng.gauss(0, 0.3)).item() for _ in range(4)]) for i in range(600)] + [(50, [0.1] * 4), (60, [0.2] * 4), (60, [0.2] * 4)]
    monkeypatch.setattr(topk_module, "RANGE", 100)
    monkeypatch.setattr(topk_module, "QUERIES", 5)
    vectors = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, tile string, score string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk(vectors).collect()]
    least = dict(sorted(((i, [math.floor(256 * c) for c in v]) for i, v in rows), reverse=True))
    want = []
    for i, a in least.items():
        if i % 50 == 0:
            scores = sorted((-sum(x * math.floor(256 * y) for x, y in zip(a, b)), j) for j, b in rows if j != i)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])]
    assert sorted(got) == sorted(want)
