import random
import re

import pytest

from sensorframe.llm import phrase_index as p

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        if name is None or not w:
            continue
        k = min(window, len(w))
        pieces = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(own) - k + 1):
            if tuple(own[i : i + k]) in pieces:
                hit |= set(range(i, i + k))
                found.add(str(name))
    return len(own), hit, found


@pytest.fixture
def corpus():
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "É", "dd", "x-y", "9"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 200]))) for _ in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 4, 9])))) for i in range(40)] + [(None, "a"), (41, None), (3, "a b c dd")]
    items += [(50, texts[7].upper()), (51, "never seen words here")]
    return [(i, t, "s") for i, t in enumerate(texts)], items


@pytest.mark.parametrize("slice_words", [p.SLICE_WORDS, 40])
def test_exact_phrases(spark, table, corpus, slice_words, monkeypatch):
    monkeypatch.setattr(p, "BLOCK_BYTES", 500)
    monkeypatch.setattr(p, "CANDIDATES", 64)
    rows, items = corpus
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = p.contamination(table(rows), benchmark, window=4, slice_words=slice_words).collect()
    assert len(found) == len(rows)
    for x in found:
        n, hit, own = brute(rows[x.doc_id][1], items, 4)
        assert (x.n_words, x.n_hit, set(x["items"])) == (n, len(hit), own)
        assert {q for s in x.spans for q in range(s["first"], s["last"] + 1)} == hit


def test_proximity(spark, table, corpus):
    rows, _ = corpus
    items = [(1, "a dd 9"), (2, "b b"), (3, "zz a")]
    found = p.find_phrases(p.build_index(table(rows)), spark.createDataFrame(items, "item_id long, text string"), within=3).collect()
    for x in found:
        own, wanted = words(rows[x.id][1]), set()
        for name, item in items:
            terms = words(item)
            order = sorted(range(len(terms)), key=lambda k: (sum(words(t).count(terms[k]) for _, t, _ in rows), k))
            if any(all(terms[k] in own[max(0, i - 3) : i + 4] for k in order) for i in range(len(own)) if own[i] == terms[order[0]]):
                wanted.add(str(name))
        assert set(x["items"]) == wanted


def test_odd_rows(spark, table, odd):
    docs = table(odd)
    benchmark = spark.createDataFrame([(1, "some text"), (2, None), (3, ""), (None, "word")], "item_id long, text string")
    found = p.contamination(docs, benchmark).collect()
    assert len(found) == len(odd)
    assert [x.doc_id for x in found if x.n_hit] == [None]
    left = p.without_contaminated(docs, benchmark)
    assert left.columns == docs.columns and left.count() == len(odd) - 1
    assert left.filter("doc_id is null").count() == 1
    empty = spark.createDataFrame([], "item_id long, text string")
    assert p.contamination(docs, empty).filter("n_hit > 0").count() == 0
    assert p.without_contaminated(docs, empty).count() == len(odd)
    assert p.contamination(docs.limit(0), benchmark).count() == 0
