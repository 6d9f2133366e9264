import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import hard_negatives as hn
from sensorframe.llm import norm_search as ns
from sensorframe.llm import vector_blocks as vb
from sensorframe.llm.session import ready

#: Further columns with the names of the operators' own.
SCHEMA = "vec_id long, embedding array<double>, label int, id string, norm string, key int, keys string, part int, kind int, rank int, score string, level int, size int"
LIMIT = 2**63 - 1


def usable(rows):
    return [(i, v, y) for i, v, y in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -LIMIT), LIMIT)


def brute_top(rows, every, k, scale):
    known = [(n, i, whole(v, scale)) for n, (i, v, _) in enumerate(usable(rows))]
    out = []
    for n, i, v in known:
        if i % every == 0:
            found = sorted((-product(v, w), j) for m, j, w in known if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def brute_mined(rows, every, positives, negatives, low, high, scale):
    known = [(n, i, whole(v, scale), y) for n, (i, v, y) in enumerate(usable(rows)) if y is not None]
    out = []
    for n, i, v, y in known:
        if i % every:
            continue
        scored = sorted((-product(v, w), j, m, z) for m, j, w, z in known if m != n)
        for s, j, _, _ in [r for r in scored if r[3] == y][:positives]:
            fit = [r for r in scored if r[3] != y and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, j, r, f[1], -s, -f[0]) for r, f in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture
def vectors(spark):
    ready(spark)

    def make(rows, partitions=3):
        return spark.createDataFrame([(*r, "x", None, 1, "k", 2, 3, 4, "s", 5, 6) for r in rows], SCHEMA).repartition(partitions)

    return make


def clustered(n, dims, seed, spread=0.05, directions=6, shape=1.5):
    """Vectors of very different lengths around a few directions, so that both ways of pruning have work."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(directions, dims))
    which = rng.integers(0, directions, n)
    v = centres[which] / np.linalg.norm(centres[which], axis=1, keepdims=True) + spread * rng.normal(size=(n, dims))
    v *= rng.pareto(shape, n)[:, None] + 0.05 * shape
    return [(i, [float(x) for x in row], int(c)) for i, (row, c) in enumerate(zip(v, which))]


ODD = [
    (0, [1.0, 0.0], 1), (10, [0.0, 0.0], 1), (10, [0.0, 0.0], 1), (20, [], 2), (30, [1.0, 2.0, 3.0], None), (40, None, 1), (50, [1.0, None], 1), (60, [float("nan"), 1.0], 2),
    (70, [float("inf")], 2), (None, [1.0, 1.0], 1), (80, [-1.0, -1.0], 2), (1, [1.0, 0.0], 2), (2, [1.0, 0.0], 1), (3, [0.5], 2), (-10, [0.5, 0.5], 1), (90, [1e30, 1.0], 3),
    (91, [1e30, -1e30], 1), (92, [-1e30, 5.0], 2),
]


def test_top_products_by_both_ways(vectors):
    rows = clustered(900, 8, 3)
    found = ns.top_products(vectors(rows), F.col("vec_id") % 10 == 0, 5, 64).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 10, 5, 64)


def test_small_blocks_and_groups(vectors, monkeypatch):
    monkeypatch.setattr(vb, "GROUP_ROWS", 16)
    rows = clustered(500, 5, 4)
    found = ns.top_products(vectors(rows, 7), F.col("vec_id") % 4 == 0, 3, 32).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 4, 3, 32)


def test_every_way_of_pruning_is_met():
    rows = clustered(4000, 12, 5, 0.02, 60, 20)
    values = np.floor(64 * np.array([v for _, v, _ in rows]))
    norms = np.linalg.norm(values, axis=1)
    order = np.argsort(-norms)
    block = lambda at: vb.Block(at, at, np.zeros(len(at), np.int64), norms[at], values[at])
    search = ns.NormSearch(block(order[:200]), 5)
    for at in range(0, len(order), 200):
        search.meet(block(order[at : at + 200]))
    assert all(search.counts.values())
    best = defaultdict(list)
    for o, i, s in zip(search.best.owner, search.best.ids, search.best.scores):
        best[int(search.ids[o])].append((-int(s), int(i)))
    scores = values @ values.T
    for i, found in best.items():
        assert found == sorted((-int(s), j) for j, s in enumerate(scores[i]) if j != i)[:5]


@pytest.mark.parametrize("component, cosine", [(0.9, 0.8), (0.1, 0.95), (-0.7, 0.6), (0.0, 0.99)])
def test_interval_holds_every_near_direction(component, cosine):
    rng = np.random.default_rng(1)
    q = np.array([component, *([math.sqrt((1 - component**2) / 4)] * 4)])
    p = rng.normal(size=(20000, 5)) * 0.3 + q
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    low, high = ns.interval(component, cosine)
    near = p[p @ q >= cosine]
    assert len(near) and (near[:, 0] >= low).all() and (near[:, 0] <= high).all()


def test_ties_go_to_the_smaller_id(vectors):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 0.0], 1) for i in range(200)]
    found = ns.top_products(vectors(rows), F.col("vec_id") % 50 == 0, 10, 4).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 50, 10, 4)


def test_odd_vectors(vectors, spark):
    found = ns.top_products(vectors(ODD), F.col("vec_id") % 10 == 0, 4, 1024).collect()
    assert sorted(map(tuple, found)) == brute_top(ODD, 10, 4, 1024)
    mined = hn.hard_negatives(vectors(ODD), F.col("vec_id") % 10 == 0, F.col("label"), 3, 2, 0, 100).collect()
    assert sorted(map(tuple, mined)) == brute_mined(ODD, 10, 3, 2, 0, 100, 256)
    with pytest.raises(ValueError):
        hn.hard_negatives(vectors(ODD), F.col("vec_id") % 10 == 0, F.col("label"), low=50, high=120)
    empty = vectors(ODD).limit(0)
    assert ns.top_products(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(empty, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


@pytest.mark.parametrize("low, high", [(50, 95), (0, 100), (90, 91)])
def test_mined_negatives(vectors, low, high):
    rng = random.Random(low)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(4)], rng.choice([0, 0, 0, 1, 2, None])) for i in range(400)]
    rows += [(10, [1.0, 1.0, 1.0, 1.0], 0)] * 3
    found = hn.hard_negatives(vectors(rows), F.col("vec_id") % 5 == 0, F.col("label"), 4, 3, low, high, 8).collect()
    assert sorted(map(tuple, found)) == brute_mined(rows, 5, 4, 3, low, high, 8)
    assert found


def test_windows_are_streamed():
    """The iterator asks for the next record only after it has given all rows of the one before."""
    read = []

    def records():
        for n, (down, kind, vec) in enumerate([(-100, 0, 1), (-90, 1, 2), (-80, 0, 3), (-70, 1, 4), (-60, 1, 5), (-55, 1, 6), (-10, 1, 7)]):
            read.append(n)
            yield (7, down, kind, vec, vec), 70

    rows = hn.mined(records(), 2, 50, 95)
    assert read == []
    assert next(rows) == (70, 1, 1, 2, 100, 90) and read == [0, 1]
    assert list(rows) == [(70, 1, 2, 4, 100, 70), (70, 3, 1, 4, 80, 70), (70, 3, 2, 5, 80, 60)]
