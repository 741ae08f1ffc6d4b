"""Exact top-k retrieval by cells: equal to all products, with few cells looked at."""

import numpy as np
import pytest

from momentrank.operators import retrieve


def made(spark, n, d, groups, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, d))
    x = centre[rng.integers(0, groups, n)] + 0.15 * rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[-20:] = x[0]  # ties
    q = x[rng.integers(0, n, 30)] + 0.05 * rng.standard_normal((30, d))
    frames = spark.createDataFrame([(i, i % 9, v.tolist()) for i, v in enumerate(x)], "frame_id long, video long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    return x, q, frames, queries


@pytest.mark.parametrize("k,chunk,cells", [(1, 50_000, 0), (10, 40, 0), (25, 50_000, 1), (3000, 100, 0)])
def test_equals_all_products(spark, k, chunk, cells):
    x, q, frames, queries = made(spark, 2000, 16, 40)
    got = {}
    for r in retrieve.top_k(queries, frames.repartition(5), k, chunk, cells).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.frame_id, r.video, round(r.score, 9)))
    sims = np.round(q @ x.T, 12)
    for i in range(len(q)):
        order = sorted(range(len(x)), key=lambda j: (-sims[i, j], j))[:k]
        rows = sorted(got[i])
        assert [v for *_, v in rows] == pytest.approx([float(sims[i, j]) for j in order], abs=2e-9)
        assert {f for _, f, _, v in rows if v > rows[-1][3] + 1e-8} == {j for j in order if sims[i, j] > rows[-1][3] + 1e-8}


def test_few_cells_are_looked_at(spark):
    x, q, frames, queries = made(spark, 4000, 16, 60)
    held, cells = retrieve.celled(frames)
    assert len(cells.sizes) > 40 and cells.sizes.sum() == 4000
    first = retrieve.asked(queries, cells, 10)
    floors = spark.createDataFrame([(i, float(np.sort(q[i] @ x.T)[-10])) for i in range(len(q))], "query_id long, floor double")
    visited = first.count() + retrieve.asked(queries, cells, 10, floors).count()
    assert visited < 0.25 * len(q) * len(cells.sizes)


def test_nothing_to_ask_and_nothing_to_find(spark):
    _, _, frames, queries = made(spark, 50, 4, 3)
    assert retrieve.top_k(queries.limit(0), frames, 3).count() == 0
    assert retrieve.top_k(queries, frames.limit(0), 3).count() == 0
    assert retrieve.top_k(queries, frames.limit(2), 3).count() == 60
