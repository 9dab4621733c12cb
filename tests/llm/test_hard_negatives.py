"""Hard negatives against brute force, and the certainty of the intervals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import hard_negatives as hard


@pytest.fixture
def rows(spark):
    def make(*some):
        return spark.createDataFrame([(*r, 1, 2) for r in some], "vec_id bigint, label int, embedding array<float>, dim int, parts int")

    return make


def brute(some, every, positives, negatives):
    kept = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in some]
    out = set()
    for anchor, label, q in kept:
        if anchor % every:
            continue
        scored = [(-min(sum(x * y for x, y in zip(q, v)), 2**63 - 1), i, other) for i, other, v in kept if i != anchor and len(v) == len(q)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out |= {(anchor, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fit, 1)}
    return out


def found(df, every=10, positives=5, negatives=3):
    return {tuple(r) for r in hard.mined(df, F.col("label"), every, positives, negatives).collect()}


def test_equals_brute_force(rows, monkeypatch):
    random = np.random.default_rng(0)
    centres = random.normal(size=(5, 20))
    some = []
    for i in range(300):
        label = int(random.integers(0, 5))
        some.append((i, label, (0.2 * (centres[label] + random.normal(size=20))).astype(np.float32).tolist()))
    assert found(rows(*some)) == brute(some, 10, 5, 3)
    monkeypatch.setattr(hard, "BLOCK_VALUES", 800)
    monkeypatch.setattr(hard, "ANCHOR_VALUES", 100)
    assert found(rows(*some)) == brute(some, 10, 5, 3)


def test_hot_vector_and_odd_rows(rows):
    nan = float("nan")
    same = [(i, i % 2, [1.0, 2.0]) for i in range(200)]
    near = [(500 + i, 1 - i % 2, [0.5 + 0.01 * i, 1.0]) for i in range(40)]
    odd = [(None, 1, [1.0, 2.0]), (600, None, [1.0, 2.0]), (610, 1, None), (620, 1, [nan, 1.0]), (630, 1, [None, 1.0]), (640, 1, []), (650, 1, [1.0])]
    some = [*same, *near, (650, 1, [1.0])]
    assert found(rows(*same, *near, *odd, *near, same[0])) == brute(some, 10, 5, 3) != set()
    assert found(rows().limit(0)) == set()


def test_huge_components(rows):
    some = [(0, 1, [1e30, 0.5]), (10, 1, [2.0, 0.5]), (20, 1, [1.0, 0.5]), (3, 2, [1.0, 0.25]), (4, 2, [1e30, 0.5])]
    got = {r[:4] for r in found(rows(*some))}
    assert got == {r[:4] for r in brute(some, 10, 5, 3)}


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_intervals_hold_the_products(dim):
    random = np.random.default_rng(dim)
    values = np.floor(256 * random.normal(size=(200, dim)))
    mean = values.mean(axis=0)
    codes, alignment, rest = hard.encoded(values - mean)
    block = hard.Block.__new__(hard.Block)
    block.coded(codes, alignment, rest)
    block.means, block.mean_of = mean[None, :], np.zeros(200, dtype=int)
    for query in np.floor(256 * random.normal(size=(20, dim))):
        low, high = block.bounds(hard.Anchor(query), slice(None))
        exact = values @ query
        assert (low <= exact).all() and (exact <= high).all()
        spread = np.abs(query).sum() * np.abs(values).max()
        assert (high - low).mean() < spread  # and say something


def test_most_rows_are_not_scored():
    random = np.random.default_rng(5)
    values = np.floor(256 * 0.02 * random.normal(size=(2000, 64)))
    values[:20] += 200
    codes, alignment, rest = hard.encoded(values - values.mean(axis=0))
    block = hard.Block.__new__(hard.Block)
    block.coded(codes, alignment, rest)
    block.means, block.mean_of = values.mean(axis=0)[None, :], np.zeros(2000, dtype=int)
    low, high = block.bounds(hard.Anchor(values[0]), slice(None))
    assert (high >= np.sort(low)[-5]).sum() < 200
