import random

import pytest

from sensorframe.llm import line_runs as r


def brute(rows, least, long_words=50):
    """Texts without later copies of runs and of long lines, rows in order."""
    seen, out = set(), {}
    for i, text in rows:
        lines = (text or "").split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for a in range(len(filled) - least + 1):
            piece = tuple(lines[k] for k in filled[a : a + least])
            if piece in seen:
                gone |= set(filled[a : a + least])
            seen.add(piece)
        for k in filled:
            if len(lines[k].split()) > long_words:
                if (lines[k],) in seen:
                    gone.add(k)
                seen.add((lines[k],))
        out[i] = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_later_copies_go(table, least):
    rng = random.Random(least)
    block = [f"line {k}" for k in range(23)]
    rows = []
    for i in range(60):
        lines = [rng.choice(["x", "y", "", " ", "z", "hot"]) if rng.random() < 0.5 else f"own {rng.randrange(40)}" for _ in range(rng.choice([0, 1, 4, 12]))]
        if rng.random() < 0.4:
            a = rng.randrange(20)
            lines += block[a : a + rng.randrange(1, 23)] + ["tail"] + block
        rows.append((i, "\n".join(lines)))
    found = r.without_repeated_runs(table([(i, t, "s") for i, t in rows]), min_lines=least).collect()
    assert {x.doc_id: x.text for x in found} == brute(rows, least)
    assert sum(x.n_deleted for x in found) == sum(len(x.deleted) for x in found) > 0


def test_long_single_lines_go(table):
    """Copies of a passage on one line go, whatever stands around it; short lines stay."""
    passage = " ".join(f"w{k}" for k in range(200))
    rows = [(i, f"own {i} a\n{passage}\nown {i} b\nshort line of all") for i in range(3)] + [(3, passage), (4, " ".join(passage.split()[:50])), (5, " ".join(passage.split()[:50]))]
    rows += [(6, f"{passage}\n{passage} "), (7, f"x\n{passage} ")]
    # 50 and 51 words between other white space
    odd = ["  ".join(passage.split()[:50]), "\t".join(passage.split()[:51]), " \f".join(passage.split()[:50]) + "\r", " " + "\v".join(passage.split()[:51])]
    rows += [(8 + i, f"{i}\n" + t) for i, t in enumerate(odd + odd)]
    found = {x.doc_id: x for x in r.without_repeated_runs(table([(i, t, "s") for i, t in rows])).collect()}
    assert {i: x.text for i, x in found.items()} == brute(rows, 2)
    assert [found[i].n_deleted for i in range(16)] == [0, 1, 1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 1] and found[1].text == "own 1 a\nown 1 b\nshort line of all"
    few = r.without_repeated_runs(table([(i, t, "s") for i, t in rows]), long_words=30).collect()
    assert {x.doc_id: x.text for x in few} == brute(rows, 2, 30)


def test_prefixes_are_those_of_a_suffix_array(table):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.choice([3, 9, 20])))) for i in range(25)]
    lines = r.stored(r.line_table(table([(i, t, "s") for i, t in rows]).selectExpr("doc_id as id", "text", "doc_id as doc")).drop("line_number", "long"))
    every, _, levels = r.doubled_ranks(lines)
    array = sorted(r.common_prefixes(every, levels, 2).collect(), key=lambda x: x.place)
    texts = {i: t.split("\n") for i, t in rows}
    suffix = lambda x: texts[x.doc][x.at :]
    shared = {}
    for i, t in texts.items():
        for a in range(len(t) - 1):
            shared.setdefault(tuple(t[a : a + 2]), []).append((i, a))
    assert sorted((x.doc, x.at) for x in array) == sorted(p for v in shared.values() if len(v) > 1 for p in v)
    for x, y in zip(array, array[1:]):
        k = 0
        while k < min(len(suffix(x)), len(suffix(y))) and suffix(x)[k] == suffix(y)[k]:
            k += 1
        assert y.common == k or (k < 2 and y.common < 2)
    # sorted by the order of line ids, so equal beginnings are together at every length
    for width in (2, 3, 5):
        runs = [tuple(suffix(x)[:width]) for x in array if len(suffix(x)) >= width]
        assert len([1 for a, b in zip(runs, runs[1:]) if a != b]) + 1 == len(set(runs)) or not runs


def test_odd_rows(table, odd):
    docs = table(odd)
    found = r.without_repeated_runs(docs).collect()
    assert len(found) == len(odd)
    by_id = {x.doc_id: x for x in found if x.doc_id is not None}
    assert by_id[1].text is None and by_id[2].text == "" and by_id[3].text == " \n\t " and by_id[5].text
    assert by_id[12].text == "line one\nline two\n\n" and by_id[12].n_deleted == 2
    assert r.without_repeated_runs(docs.limit(0)).count() == 0
