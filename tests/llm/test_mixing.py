import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from sensorframe.llm import mixing as m


def goals(sizes):
    """Targets by sharing the excess again and again, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, held = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        rest, share = total - sum(2 * sizes[s] for s in held), sum(weight[s] for s in order if s not in held)
        above = {s for s in order if s not in held and rest * weight[s] > 2 * sizes[s] * share}
        if not above:
            return {s: Fraction(2 * sizes[s]) if s in held or not share else rest * weight[s] / share for s in order}
        held |= above


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 4), (3, 16)])
def test_mix(table, seed, block):
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        source = rng.choice(["hot"] * 6 + ["a", "B", "é", None, f"s{rng.randrange(9)}"])
        rows.append((i, " ".join(["w"] * int(rng.paretovariate(1.1) % 400)) if rng.random() < 0.97 else None, source))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    wanted = goals(sizes)
    found = m.mixed_rows(table(rows), block=block).collect()
    assert sorted(x.doc_id for x in found) == list(range(3000))
    taken = Counter()
    for x in found:
        assert x.size == len((rows[x.doc_id][1] or "").split()) and x.source_size == sizes[rows[x.doc_id][2]]
        assert x.target == pytest.approx(float(wanted[rows[x.doc_id][2]])) and x.taken == x.copies * x.size <= 2 * x.size
        rate = x.target / x.source_size if x.size else 0
        assert int(rate) <= x.copies <= -int(-rate // 1) or abs(rate - round(rate)) < 1e-9 and x.copies == round(rate)
        taken[rows[x.doc_id][2]] += x.taken
    largest = max(len((t or "").split()) for _, t, _ in rows)
    for source, goal in wanted.items():
        assert abs(taken[source] - goal) <= max(Fraction(2, 100) * goal, 2 * largest)
    again = m.mixed_rows(table(rows, 7), block=block).collect()
    assert sorted(again, key=lambda x: x.doc_id) == sorted(found, key=lambda x: x.doc_id)


def test_expected_copies(table):
    """Over many rows of one size the extra copies are as many as the probabilities say, in every block."""
    rows = [(i, "one two three", "ab"[i % 2]) for i in range(2000)]
    found = m.mixed_rows(table(rows), block=64).collect()
    for source in "ab":
        own = [x for x in found if x.source == source]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 3


def test_equal_rows_share_copies(table):
    rows = [(1, "a b c", "s")] * 500 + [(2, "d e", "t")] * 301
    found = m.mixed_rows(table(rows)).collect()
    assert len(found) == 801
    for i, n in ((1, 500), (2, 301)):
        own = [x for x in found if x.doc_id == i]
        assert len(own) == n and abs(sum(x.taken for x in own) - own[0].target) <= own[0].size


def test_documents_are_repeated(table, odd):
    docs = table(odd)
    plan = Counter()
    for x in m.mixed_rows(docs).collect():
        plan[x.doc_id] += x.copies
    out = m.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(x.doc_id for x in out.collect()) == +plan
    assert m.mixed(docs.limit(0)).count() == 0 and m.mixed_rows(docs.limit(0)).count() == 0
    assert m.mixed_rows(docs).count() == len(odd)


def test_only_wordless_texts(table):
    found = m.mixed_rows(table([(1, None, "a"), (2, " ", None)])).collect()
    assert [(x.size, x.source_size, x.target, x.taken) for x in found] == [(0, 0, 0.0, 0)] * 2


def test_no_python_in_the_plan(table, odd):
    plan = m.mixed_rows(table(odd))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
