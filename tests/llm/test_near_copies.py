import math
import random
import re

import numpy as np
import pytest

from sensorframe.llm import near_copies as n
from sensorframe.llm.components import components


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows, percent=85):
    """id -> (set sizes, least id reachable); rows without an id are left out."""
    sets = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def group(rng, base_id, size):
    """Copies of one text with 0 to 8 edits, some of them edits of edits, and some texts with a shared half."""
    base = [f"w{base_id}x{rng.randrange(200)}" for _ in range(rng.choice([30, 120, 300]))]
    texts = [base]
    for _ in range(size - 1):
        texts.append(edited(rng, rng.choice(texts) if rng.random() < 0.3 else base, rng.randrange(9)))
    texts.append(base[: len(base) // 2] + [f"o{rng.randrange(10**6)}" for _ in base[: len(base) // 2]])
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(table, seed, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_ROWS", 8)  # several blocks
    rng = random.Random(seed)
    texts = [t for g in range(8) for t in group(rng, g, rng.choice([2, 5, 40]))]
    ids = rng.sample(range(10_000), len(texts))
    rows = [(i, t, "s") for i, t in zip(ids, texts)] + [(20_000 + k, texts[3].upper(), "s") for k in range(30)]
    wanted = brute(rows)
    assert len(set(wanted.values())) < len(wanted)
    found = n.near_copies(table(rows)).collect()
    assert {x.doc_id: x.component_id for x in found} == wanted
    assert all(x.n_shingles == len(shingles(t)) for x, t in ((x, dict((i, t) for i, t, _ in rows)[x.doc_id]) for x in found))
    assert all(x.kept == (x.doc_id == x.component_id) for x in found)


def test_odd_rows(table, odd):
    docs = table(odd)
    found = n.near_copies(docs).collect()
    assert len(found) == len(odd)
    component = {x.doc_id: x.component_id for x in found if x.doc_id is not None}
    assert component[6] == 5 and component[1] == 1 and component[2] == 2 and component[3] == 3
    assert component[9] == component[10] == component[11] == 9
    assert all(x.kept and x.component_id is None for x in found if x.doc_id is None)
    kept = n.one_of_each(docs)
    assert kept.columns == docs.columns
    left = [x.doc_id for x in kept.collect()]
    assert sorted(i for i in left if i is not None) == [1, 2, 3, 4, 5, 7, 7, 8, 9, 12] and left.count(None) == 2
    assert n.near_copies(docs.limit(0)).count() == 0 and n.one_of_each(docs.limit(0)).count() == 0


def test_common_sizes():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 80), dtype=np.uint64)) for _ in range(14)]
    got = n._common(sets[:6], sets[6:], slab=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[6:]] for a in sets[:6]]


@pytest.mark.parametrize("edges,wanted", [
    ([], {}), ([(1, 1)], {}), ([(k, k + 1) for k in range(60)], {k: 0 for k in range(61)}),
    ([(99, k) for k in range(50, 99)] + [(7, 3), (3, 7), (7, 3)], {**{k: 50 for k in range(50, 100)}, 3: 3, 7: 3})])
def test_star_contraction(spark, edges, wanted):
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x.node: x.component for x in found} == wanted and len(found) == len(wanted)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_signatures_drop_less_than_one_pair_in_a_million(percent):
    agree, p = n.least_equal(percent), percent / 100
    fewer = sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(agree))
    assert fewer < 1e-6 < fewer + math.comb(128, agree) * p**agree * (1 - p) ** (128 - agree)
    # the minima of a pair that agree in as many places go on to the comparison of sets
    one = np.arange(128, dtype=np.uint32)
    two = np.where(np.arange(128) < agree, one, one + 1000).astype(np.uint32)
    assert n._alike_minima(percent)(memoryview(one), memoryview(two))


def test_one_of_each_at_another_similarity(table):
    words = [f"w{k}" for k in range(100)]
    # 86 of 106 shingles are common: 81 %
    docs = table([(1, " ".join(words), "a"), (2, " ".join(words[:50] + ["x", "y", "z", "u", "v", "q"] + words[56:]), "a"), (3, "something else in a few words", "a")])
    assert sorted(x.doc_id for x in n.one_of_each(docs, percent=80).collect()) == [1, 3]
    assert sorted(x.doc_id for x in n.one_of_each(docs).collect()) == [1, 2, 3]
