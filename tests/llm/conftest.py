import random

import pytest

from sensorframe.llm.session import ready

#: Documents with clashing further columns.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, kept string, node int, key int, n_shingles string, "
          "rank int, part int, block int, tie int, size string, copies int, score string, label string, component string")


def documents(rows):
    """(doc_id, text, source) rows with the further columns filled with nulls and noise."""
    return [(i, t, None, s, None if t is None else len(t), "x", None, 1, None, "n", 2, 3, None, 4, "big", 5, "s", "l", "c") for i, t, s in rows]


@pytest.fixture
def table(spark):
    ready(spark)

    def make(rows, partitions=3):
        return spark.createDataFrame(documents(rows), SCHEMA).repartition(partitions)

    return make


@pytest.fixture
def prose():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "delta", "é", "über", "the", "of", "and", "x1"]

    def make(n):
        return " ".join(rng.choice(words) + (str(rng.randrange(30)) if rng.random() < 0.6 else "") for _ in range(n))

    return make


@pytest.fixture
def odd(prose):
    """Null and empty texts, blanks, one word, a very long text, repeated rows, a null id and a null source."""
    long = prose(30_000)
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "word", "b"), (5, long, "a"), (6, long, None), (7, prose(40), "b"), (7, prose(40), "b"),
            (8, "twice the same row here ok", "a"), (8, "twice the same row here ok", "a"), (None, "no id at all but some text", "b"), (None, None, None),
            (9, "a b c d", "c"), (10, "a b c d", "c"), (11, "A B\nC D", "c"), (12, "line one\nline two\nline one\nline two\n\n", "c")]
