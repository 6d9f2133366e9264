import random
import re
from collections import Counter

import numpy as np
import pytest

from sensorframe.llm import collocations as c

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split("[ \t]", p) if w] for p in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(FOLD))]


def counted(rows, most):
    """Occurrences of every (lang, words) of 1 to most words."""
    out = Counter()
    for text, lang in rows:
        for words in pieces(text):
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    out[lang or "und", tuple(words[i : i + size])] += 1
    return out


def brute(rows, top, least, most, share):
    f = counted(rows, most)
    n = Counter()
    for (lang, words), k in f.items():
        n[lang] += k if len(words) == 1 else 0
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    dropped = set()
    for (lang, words), longer in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, words[i : i + size])
                if 100 * longer >= share * f[part]:
                    dropped.add(part)
    found = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in dropped:
            score, _, left, right = min((1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, xs in found.items() for r, (s, a, p, left, right) in enumerate(sorted(xs)[:top], 1))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "CITY", "the", "of", "a", "état", "über", "日本", "x-y", "don't", "st"]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.choice([0, 1, 2, 5, 30])):
            words += rng.choice([["new", "York", "city"], ["of", "the"], ["of", "the"], [rng.choice(vocabulary)], [rng.choice(vocabulary) + rng.choice([",", ".", "\n", "?", " \t"])]])
        out.append((" ".join(words), rng.choice(["en", "en", "en", "de", None])))
    return out


def table(spark, rows, partitions=5):
    from sensorframe.llm.session import ready

    ready(spark)
    return spark.createDataFrame([(i, t, g, "x", 1, 2, "k", 3, 4) for i, (t, g) in enumerate(rows)],
                                 "doc_id long, text string, lang string, word string, k1 int, size int, codes string, n int, rank int").repartition(partitions)


@pytest.mark.parametrize("least, most, shards", [(10, 3, 3), (2, 4, 2), (3, 2, 4)])
def test_against_brute_force(spark, monkeypatch, least, most, shards):
    # small blocks, so that every shard has some
    monkeypatch.setattr(c, "BLOCK_BYTES", 700)
    rows = corpus(least, 400)
    found = c.collocations(table(spark, rows), 15, least, most, shards).collect()
    assert sorted(map(tuple, found)) == brute(rows, 15, least, most, c.SHARE)


@pytest.mark.parametrize("slots", [64, 1 << 12])
def test_counts_are_exact_whatever_the_table(spark, monkeypatch, slots):
    monkeypatch.setattr(c, "BLOCK_BYTES", 500)
    monkeypatch.setattr(c, "LEAST_SLOTS", slots)
    monkeypatch.setattr(c, "MOST_SLOTS", slots)
    rows = corpus(5, 300)
    counted_ = c.phrase_counts(table(spark, rows).select("text", "lang"), 4, 3, 3)
    assert 6 <= counted_.scans <= 9
    names = {}
    for block in counted_.blocks.collect():
        names.update(zip(np.frombuffer(block.hashes, np.int64).tolist(), [(block.lang, w) for w in block.words]))
    found = {}
    for r in counted_.phrases.collect():
        words = [names[k] for k in (r.k1, r.k2, r.k3)[: r["size"]]]
        key = words[0][0], tuple(w for _, w in words)
        assert key not in found
        found[key] = r.n
    assert found == {key: n for key, n in counted(rows, 3).items() if n >= 4 or len(key[1]) == 1}


def test_phrases_wait_for_both_subphrases():
    """Scan by scan over one block a shard: nothing is counted before its subphrases are known, and then for one cycle."""
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 5, 2000).astype(np.int32)
    hashes = c.mixed(np.arange(1, 6, dtype=np.uint64))
    table = np.full(1 << 12, c.EMPTY, np.uint8)
    begins = np.array([0], np.int32)
    sizes = lambda scan: [len(k) for k, _, _ in c.count_block(codes, begins, hashes, table, scan, 3, 3)]
    assert sizes(0) == [1] and sizes(1) == [1] and sizes(3) == []
    for slot in np.concatenate(c._slots([hashes[:4]], len(table))):
        table[slot] = 1
    assert sizes(1) == [1, 2] and sizes(3) == [2] and sizes(4) == []
    keys, counts, begun = list(c.count_block(codes, begins, hashes, table, 1, 3, 3))[1]
    assert set(keys[0]) | set(keys[1]) <= set(hashes[:4]) and (begun == 1).all()
    assert counts.sum() == ((codes[:-1] < 4) & (codes[1:] < 4)).sum()
    for slot in np.concatenate(c._slots([hashes[[0, 1]], hashes[[1, 0]]], len(table))):
        table[slot] = 2
    [(keys, counts, begun)] = [x for x in c.count_block(codes, begins, hashes, table, 4, 3, 3)]
    assert len(keys) == 3 and (begun == 2).all() and sorted(zip(*keys)) == sorted([tuple(hashes[[0, 1, 0]]), tuple(hashes[[1, 0, 1]])])


def test_languages_that_share_a_code_are_told_apart(spark, monkeypatch):
    true = c._code
    monkeypatch.setattr(c, "_code", lambda lang, key: 5 if key == 0 else true(lang, key))
    rows = corpus(10, 60)
    assert sorted(map(tuple, c.collocations(table(spark, rows), 50, 3).collect())) == brute(rows, 50, 3, 3, c.SHARE)


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    true = c._hashes

    def clashing(words, lang, key):
        return true(words, lang, key) % np.uint64(7) if key == 0 else true(words, lang, key)

    monkeypatch.setattr(c, "_hashes", clashing)
    rows = corpus(9, 60)
    assert sorted(map(tuple, c.collocations(table(spark, rows), 50, 3).collect())) == brute(rows, 50, 3, 3, c.SHARE)


def test_odd_texts(spark):
    long = "one two three " * 30_000
    rows = [(None, "en"), ("", "en"), (" \t \n.,!", None), ("word", "de"), (long, None), ("A B C D " * 9 + "\n a b", "xx"), ("A B C D " * 9 + "\n a b", "xx"), ("a b c " * 12, "x\ny")]
    assert sorted(map(tuple, c.collocations(table(spark, rows)).collect())) == brute(rows, 2000, 10, 3, 50)
    assert c.collocations(table(spark, rows).limit(0)).count() == 0
    assert c.collocations(table(spark, rows[:4])).count() == 0
