import random

import numpy as np
import pyarrow as pa
import pytest

from sensorframe.llm import catalog, quality, toxicity
from sensorframe.llm.learning import fold_of, labelled_sample

FOLDER = "/root/testdata/sf0.1"


def judged(spark, found, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", label)
    return found.join(labels, "doc_id").filter("held_out").toPandas()


@pytest.mark.parametrize("query,label,threshold,least", [("op2_toxicity", "toxic", 0.5, 0.97), ("op10_quality", "quality", 0.3, 0.98)])
def test_held_out_accuracy(spark, query, label, threshold, least):
    found = catalog.QUERIES[query](spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = judged(spark, found, label)
    assert len(rows) > 300 and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= threshold)).all()
    assert (rows.predicted == rows[label]).mean() >= least
    for value in (0, 1):
        assert (rows.predicted[rows[label] == value] == value).mean() >= 0.85


def test_pairwise_identity():
    rng = np.random.default_rng(1)
    begins = np.array([0, 3, 4, 9])
    features, values = rng.integers(0, 20, 9), rng.normal(size=9)
    weights, vectors = rng.normal(size=20), rng.normal(size=(20, 3))
    got, _ = quality.raw_scores(begins, features, values, weights, vectors)
    for row, (a, b) in enumerate(zip(begins[:-1], begins[1:])):
        wanted = sum(weights[features[i]] * values[i] for i in range(a, b))
        wanted += sum(vectors[features[i]] @ vectors[features[j]] * values[i] * values[j] for i in range(a, b) for j in range(i + 1, b))
        assert got[row] == pytest.approx(wanted)


def test_pairs_are_learnt():
    """Neither word alone says anything; their meeting does."""
    rng = random.Random(2)
    texts, labels = [], []
    for _ in range(400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["left" if a else "right", "up" if b else "down"]))
        labels.append(int(a == b))
    recorded = np.zeros(len(texts))
    model = quality.fitted(np.array(labels, float), *quality.statistics(pa.array(texts), recorded), steps=400)
    assert ((quality.scored(pa.array(texts), recorded, model) >= 0.5) == labels).mean() > 0.95


def test_grams_cover_words():
    grams, at = toxicity.word_grams(pa.array(["ab", "x", "école", "Ab"]), (3, 4), 1 << 16)
    own = [grams[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert [len(g) for g in own] == [2 + 1, 1, 5 + 4, 3]  # <ab> has two 3-grams and one 4-gram
    assert own[0] == own[3]


def test_word_sums_equal_feature_sums():
    texts = pa.array(["idiot the cat", "the the dog", "", None, "  x "])
    described = toxicity.features(texts, toxicity.ORDERS, 1 << 12)
    model = toxicity.Model(np.random.default_rng(0).normal(size=1 << 12).astype(np.float32), 0.3)
    for (bucket, share), got in zip(described, toxicity.scored(texts, model)):
        assert got == pytest.approx(1 / (1 + np.exp(-(model.weights[bucket] @ share) - 0.3)), rel=1e-5)


def test_sample_is_bounded_and_one_row_an_id(spark, table):
    docs = table([(i % 50, f"text {i}", "a") for i in range(200)] + [(None, "x", "a")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 0), (None, 1), (2, 7), (99, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 20).collect()
    assert len(rows) <= 20
    assert len(labelled_sample(docs, labels, "toxic", 1000).collect()) == labels.filter("doc_id < 50").select("doc_id").distinct().filter(fold_of(labels["doc_id"]) != 0).count()


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, table, odd, module, label):
    docs = table(odd)
    run = module.toxicity if module is toxicity else module.quality
    few = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (7, 0), (8, 1), (9, 0), (10, 1), (11, None), (12, 0)], f"doc_id long, {label} int")
    none = few.limit(0)
    one = few.filter(f"{label} = 1")
    for labels in (few, none, one):
        found = run(docs, module.fit(docs, labels)).collect()
        assert sorted(str(x.doc_id) for x in found) == sorted(str(i) for i, _, _ in odd)
        assert all(0 <= x.score <= 1 for x in found)
    assert run(docs.limit(0), module.fit(docs.limit(0), few)).count() == 0
    first, again = (sorted((str(x.doc_id), x.score) for x in run(docs.repartition(n), module.fit(docs.repartition(n), few)).collect()) for n in (2, 5))
    assert first == again
