import random
from collections import Counter

import pyarrow as pa
import pytest

from sensorframe.llm import repetition as r


def brute(words, least):
    windows = Counter(tuple(words[i : i + least]) for i in range(len(words) - least + 1))
    covered = {p for i in range(len(words) - least + 1) if windows[tuple(words[i : i + least])] > 1 for p in range(i, i + least)}
    longest = 0
    for i in range(len(words)):
        for j in range(i):
            k = 0
            while i + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
    return covered, longest if longest >= least else 0


@pytest.mark.parametrize("least", [1, 2, 3, 5, 8])
def test_spans_and_longest_repeat(least):
    rng = random.Random(least)
    docs = []
    for _ in range(120):
        words = [str(rng.randrange(rng.choice([1, 2, 5, 40]))) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))]
        docs.append(words + words[3:15] + words if len(words) >= 20 and rng.random() < 0.5 else words)
    figures = r.measured(pa.array(["\n".join([" ".join(d)]) for d in docs]), least, 30, 60)
    for words, n, longest, spans in zip(docs, *(figures[k].to_pylist() for k in ("n_repeat_words", "longest_repeat", "spans"))):
        covered, wanted = brute(words, least)
        assert (n, longest) == (len(covered), wanted)
        assert {p for s in spans for p in range(s["first"], s["last"] + 1)} == covered


def test_odd_rows(table, odd):
    docs = table(odd)
    found = r.repetition(docs).collect()
    assert sorted(str(x.doc_id) for x in found) == sorted(str(i) for i, _, _ in odd)
    by_id = {x.doc_id: x for x in found}
    assert (by_id[1].n_words, by_id[2].n_words, by_id[1].base_failed, by_id[1].kept) == (0, 0, True, False)
    assert by_id[5].n_words == 30_000 and by_id[5].kept
    assert by_id[12].n_dup_lines == 2 and by_id[11].word_chars == 4
    kept = r.without_repetitive(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in found if x.kept)
    assert r.repetition(docs.limit(0)).count() == 0 and r.without_repetitive(docs.limit(0)).count() == 0


def test_limits(table, prose):
    clean, once = prose(400), prose(70)
    docs = table([(1, clean, "a"), (2, f"{clean} {once} {prose(300)} {once}", "a"), (3, " ".join([prose(9)] * 30), "a")])
    assert {x.doc_id: (x.base_failed, x.kept, x.longest_repeat >= 70) for x in r.repetition(docs).collect()} == {
        1: (False, True, False), 2: (False, False, True), 3: (True, False, True)}
