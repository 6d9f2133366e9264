import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import pytest

from sensorframe.llm import suffix_tree as t


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))) + [None]


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


class Brute:
    """The same tree in dictionaries."""

    def __init__(self, rows, depth, p_min):
        self.c = [defaultdict(Counter) for _ in range(depth + 1)]
        for i, text in rows:
            own = tokens(text)
            for k, w in enumerate(own if not held_out(i) else []):
                for d in range(min(k, depth) + 1):
                    self.c[d][tuple(own[k - d : k])][w] += 1
        root = self.c[0][()]
        self.n, self.v = sum(root.values()), len(root)
        candidates = [{s for s in self.c[d] if sum(self.c[d][s].values()) >= max(p_min * self.n, 2)} for d in range(depth + 1)]
        kept, price = set(), 0.5 * math.log(max(self.n, 2))
        for d in range(1, depth + 1):
            for s in candidates[d]:
                own, above = self.c[d][s], self.c[d - 1][s[1:]]
                n, up = sum(own.values()), sum(above.values())
                gain = sum(c * math.log(c / n / (above[w] / up)) for w, c in own.items() if c > 1)
                once, twice = sum(c == 1 for c in own.values()), sum(c > 1 for c in own.values())
                if once:
                    gain += once * (math.log(once / n) - math.log(max(1 - sum(above[w] / up for w, c in own.items() if c > 1), 1e-12)))
                if gain > price * (twice + 1):
                    kept |= {s[k:] for k in range(d)}
        self.kept, self.depth = kept, depth

    def chance(self, s, w):
        own = self.c[len(s)][s]
        if not s:
            return (own[w] + 0.1) / (self.n + 0.1 * (self.v + 1))
        n = sum(own.values())
        spare = (sum(c == 1 for c in own.values()) + 0.5 * sum(c > 1 for c in own.values())) / n
        below = spare * self.chance(s[1:], w)
        return (own[w] - 0.5) / n + below if own[w] > 1 else below

    def score(self, text):
        own, base, total = tokens(text), 0.0, 0.0
        for k, w in enumerate(own):
            s = max((tuple(own[k - d : k]) for d in range(min(k, self.depth) + 1) if d == 0 or tuple(own[k - d : k]) in self.kept), key=len)
            base += math.log10(self.chance((), w))
            total += math.log10(self.chance(s, w))
        return base, total


@pytest.mark.parametrize("depth,p_min", [(1, 1e-3), (3, 1e-3), (3, 1e-6), (5, 1e-6)])
def test_scores_match_brute_force(table, depth, p_min, monkeypatch):
    monkeypatch.setattr(t, "chunks", lambda batches, column, limit: (b.slice(k, 7) for b in batches for k in range(0, b.num_rows, 7)))  # many blocks
    rng = random.Random(depth)
    # what follows "mid" depends on up to three words, or on up to five
    between = ["of", "the"] if depth > 3 else []
    endings = [[f"a{k % 2}", f"b{k // 2}", *between, "mid", f"end{k}"] for k in range(4)]
    rows = []
    for i in range(150):
        words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(40))]
        rows.append((i, " ".join(words[:9] + [w for _ in range(8) for w in rng.choice(endings)] * (rng.random() < 0.6) + words[9:]) + ("\n" if i % 3 else "")))
    brute = Brute(rows, depth, p_min)
    assert any(len(s) == depth for s in brute.kept)
    found = t.suffix_tree_scores(table([(i, x, "s") for i, x in rows]), depth=depth, p_min=p_min).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for x in found:
        base, total = brute.score(texts[x.doc_id])
        assert x.base_score == pytest.approx(base, rel=1e-9) and x.score == pytest.approx(total, rel=1e-9)
        assert x.n_known == sum(brute.c[0][()][w] > 0 for w in tokens(texts[x.doc_id])) and x.train_tokens == brute.n
        assert (x.fold == 0) == held_out(x.doc_id) and x.n_tokens == len(tokens(texts[x.doc_id]))
    # what a context gives to all known words and the unknown one is 1
    for s in list(brute.kept)[:20] + [()]:
        assert sum(brute.chance(s, w) for w in brute.c[0][()]) + brute.chance(s, b"unseen") == pytest.approx(1)


def test_odd_rows(table, odd):
    docs = table(odd)
    found = t.suffix_tree_scores(docs).collect()
    assert len(found) == len(odd)
    by_id = {x.doc_id: x for x in found}
    assert by_id[1].n_tokens == by_id[2].n_tokens == by_id[3].n_tokens == 1 and by_id[5].n_tokens == 30_001
    assert all(x.score <= 0 and x.base_score <= 0 for x in found)
    assert t.suffix_tree_scores(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        t.suffix_tree_scores(docs, depth=t.DEEPEST + 1)
    assert [x.score for x in t.suffix_tree_scores(docs.filter("doc_id is null")).collect()] == [0.0, 0.0]


def test_rare_contexts_stay_in_a_larger_corpus(table):
    ids = [i for i in range(400) if not held_out(i)][:84]
    # three occurrences among more than 600,001 tokens are fewer than 5 in a million
    rows = [(i, "seldom answer" if k < 3 else " ".join(f"v{(i * 7 + j * j) % 97}" for j in range(8000))) for k, i in enumerate(ids)]
    brute = Brute(rows, 1, 0.0)
    assert (b"seldom",) in brute.kept and 5e-6 * brute.n > 3
    by_id = {x.doc_id: x for x in t.suffix_tree_scores(table([(i, x, "s") for i, x in rows]), depth=1).collect()}
    for i, text in rows[:5]:
        assert by_id[i].score == pytest.approx(brute.score(text)[1], rel=1e-9)


def test_a_follower_is_sent_by_one_block(table, monkeypatch, tmp_path):
    monkeypatch.setattr(t, "chunks", lambda batches, column, limit: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))  # a block a row
    packed = t._packed

    def noted(by, shards, columns, **fixed):
        if "gain" in columns:
            (tmp_path / uuid.uuid4().hex).write_text("\n".join(map(str, columns["key"])))
        return packed(by, shards, columns, **fixed)

    monkeypatch.setattr(t, "_packed", noted)
    text = " ".join(f"a{k} mid end{k}" for k in range(40))
    t.suffix_tree_scores(table([(i, text, "s") for i in range(60)])).count()
    sent = [key for f in tmp_path.iterdir() for key in f.read_text().split()]
    assert sent and len(sent) == len(set(sent))


def test_a_held_out_text_is_scored_by_contexts_whose_followers_it_does_not_have(table):
    train = [i for i in range(400) if not held_out(i)][:60]
    rows = [(i, "seldom answer " * (k < 4) + " ".join(f"v{(i + j) % 23} often" for j in range(300))) for k, i in enumerate(train)]
    rows.append((next(i for i in range(400) if held_out(i)), "seldom often seldom often"))
    brute = Brute(rows, 1, 0.0)
    assert (b"seldom",) in brute.kept
    by_id = {x.doc_id: x for x in t.suffix_tree_scores(table([(i, x, "s") for i, x in rows]), depth=1).collect()}
    assert by_id[rows[-1][0]].score == pytest.approx(brute.score(rows[-1][1])[1], rel=1e-9)
