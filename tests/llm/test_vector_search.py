"""Vector searches against brute force."""

import numpy as np

from postloom.llm import hnsw, va_file


def table(vectors, n, dim=16, seed=0):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(6, dim))
    points = (centres[random.integers(0, 6, n)] + 0.4 * random.normal(size=(n, dim))).astype(np.float32)
    return points, vectors(*[(i, p.tolist()) for i, p in enumerate(points)])


def test_recall(vectors):
    points, rows = table(vectors, 1500)
    found = hnsw.nearest(rows, every=25, k=10).toPandas()
    exact = points.astype(np.float64)
    hits = 0
    for query, part in found.groupby("query_id"):
        apart = np.sqrt(((exact - exact[query]) ** 2).sum(axis=1))
        apart[query] = np.inf
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 11))
        assert np.allclose(part["score"], apart[part["vec_id"]], rtol=0, atol=1e-12)
        assert list(zip(part["score"], part["vec_id"], strict=True)) == sorted(zip(part["score"], part["vec_id"], strict=True))
        hits += len(set(np.argsort(apart, kind="stable")[:10]) & set(part["vec_id"]))
    assert hits / len(found) >= 0.9


def test_shards_are_merged(vectors):
    points, rows = table(vectors, 400)
    usable = hnsw.vectors.usable(rows)
    found = hnsw.search(hnsw.index(usable, 5, shard_rows=60), usable.where("vec_id % 40 = 0"), 5).toPandas()
    exact = points.astype(np.float64)
    for query, part in found.groupby("query_id"):
        apart = ((exact - exact[query]) ** 2).sum(axis=1)
        apart[query] = np.inf
        assert len(set(np.argsort(apart, kind="stable")[:5]) & set(part["vec_id"])) >= 4


def test_hot_vector_and_odd_rows(vectors):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0]) for i in range(0, 300)]
    odd = [(400, None), (401, [nan, 1.0]), (402, [inf, 1.0]), (403, [None, 1.0]), (404, [0.0, 0.0]), (None, [1.0, 2.0]),
           (500, [1.0, 2.5]), (600, [1.0, 2.0, 3.0])]
    found = hnsw.nearest(vectors(*same, *odd), every=100, k=4).toPandas()
    of = {q: list(p.sort_values("rank")["vec_id"]) for q, p in found.groupby("query_id")}
    assert of[0] == [1, 2, 3, 4] and of[100] == [0, 1, 2, 3] and of[500] == [0, 1, 2, 3]
    assert set(of) == {0, 100, 200, 500}  # 400 and 404 take no part, 600 has no candidate
    top = va_file.highest(vectors(*same, *odd), every=100, k=3).toPandas()
    of = {q: list(p.sort_values("rank")["vec_id"]) for q, p in top.groupby("query_id")}
    assert of[0] == [500, 1, 2] and of[500] == [0, 1, 2] and set(of) == {0, 100, 200, 500}
    assert hnsw.nearest(vectors().limit(0), 2, 3).count() == 0 and va_file.highest(vectors().limit(0), 2, 3).count() == 0


def test_exact_top(vectors):
    points, rows = table(vectors, 700, seed=1)
    values = np.floor(256 * points.astype(np.float64)).astype(np.int64)
    stored = va_file.blocks(va_file.vectors.usable(rows), block_rows=90)
    found = va_file.search(stored, va_file.vectors.usable(rows).where("vec_id % 10 = 0"), 5).toPandas()
    assert found["query_id"].nunique() == 70
    for query, part in found.groupby("query_id"):
        scores = values @ values[query]
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != query)[:5]
        assert [(-r.score, r.vec_id) for r in part.sort_values("rank").itertuples()] == want


def test_huge_components(vectors):
    rows = vectors((0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 5.0]), (3, [0.5, 0.25]))
    found = va_file.highest(rows, every=3, k=3).toPandas().sort_values(["query_id", "rank"])
    assert list(found[found["query_id"] == 3]["vec_id"]) == [0, 1, 2]
    assert list(found[found["query_id"] == 0]["score"])[0] == 2**63 - 1


def test_cells_bound_the_values():
    values = np.floor(np.random.default_rng(3).normal(size=(50, 8)) * 256)
    cells, low, step = va_file.cells_of(values)
    floor = low + cells * step
    assert (floor <= values).all() and (values <= floor + step - 1).all() and cells.max() < va_file.CELLS
