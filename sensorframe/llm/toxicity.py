"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the hashed character n-grams of its lower-cased words (with marks at both
ends), each as its share of the text's words. A feature is multiplied by its log-count ratio: the log of
how much likelier it is to be present in a toxic than in another training text, each smoothed. A logistic
regression with a quadratic penalty is fitted on the scaled features, so the ratios set how far each
weight can easily move.

Fitting uses at most ``SAMPLE`` labelled rows, those with the least hash of their id; features of the
sample are made in parallel and the fit runs in one task on that bounded matrix. Scoring is one pass:
the weight of each distinct word of a batch is the sum over its n-grams, and a text's score is the mean
weight of its words through the logistic function.

Results for odd input: null and empty texts have no features and score by the intercept alone; labels
other than 0 and 1, and label rows without a document, are ignored; where an id carries both labels it
is trained as toxic; without both classes in the sample the intercept alone is fitted; an empty table
gives an empty result; further columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sensorframe.llm.learning import FOLDS, labelled_sample
from sensorframe.llm.words import PLAIN, chunks, mixed, split_words

ORDERS = (3, 4, 5)
BUCKETS = 1 << 17
#: Labelled rows that the fit uses at most.
SAMPLE = 4000
SMOOTHING = 1.0
PENALTY = 1e-5
STEPS = 200
#: How far the few toxic texts of the sample are weighted up: 0 not at all, 1 to half of all.
BALANCE = 0.5


class Model(NamedTuple):
    weights: np.ndarray  # log-count ratio times fitted weight, per bucket
    intercept: float


def word_grams(vocabulary: pa.Array, orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word, and where each word's begin."""
    lowered = pc.utf8_lower(vocabulary)
    marked = pc.binary_join_element_wise("<", lowered, ">", "")
    lengths = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(lengths)), lengths)
    left = ends[word] - np.arange(len(points))  # characters from here to the word's end
    grams, owners = [], []
    for n in orders:
        if len(points) < n:
            continue
        rolling = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            rolling = (rolling + points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            rolling ^= rolling >> np.uint64(29)
        at = np.flatnonzero(left[: len(rolling)] >= n)
        grams.append((mixed(rolling[at]) % np.uint64(buckets)).astype(np.int32))
        owners.append(word[at])
    gram, owner = np.concatenate([*grams, np.zeros(0, np.int32)]), np.concatenate([*owners, np.zeros(0, np.int64)])
    order = np.argsort(owner, kind="stable")
    return gram[order], np.searchsorted(owner[order], np.arange(len(lengths) + 1))


def features(texts: pa.Array, orders: tuple[int, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its n-gram buckets and their counts per word."""
    words = split_words(texts, PLAIN)
    grams, at = word_grams(words.vocabulary, orders, buckets)
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        code, times = np.unique(words.codes[a:b], return_counts=True)
        many = (at[1:] - at[:-1])[code]
        own = np.repeat(at[:-1][code] - np.cumsum(many) + many, many) + np.arange(many.sum())
        bucket, place = np.unique(grams[own], return_inverse=True)
        count = np.bincount(place, np.repeat(times, many), len(bucket))
        out.append((bucket.astype(np.int32), (count / max(b - a, 1)).astype(np.float32)))
    return out


def fitted(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, smoothing: float = SMOOTHING, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """The classifier from (label, buckets, values) rows."""
    label = np.array([r[0] for r in rows], np.float64)
    if not len(label):
        return Model(np.zeros(buckets, np.float32), 0.0)
    toxic = label.sum()
    prior = float(np.log((toxic + 0.5) / (len(label) - toxic + 0.5)))
    if toxic in (0, len(label)):
        return Model(np.zeros(buckets, np.float32), prior)
    lengths = np.array([len(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    bucket = np.concatenate([r[1] for r in rows]).astype(np.int64)
    value = np.concatenate([r[2] for r in rows])
    present = np.bincount(bucket, label[row], buckets), np.bincount(bucket, 1 - label[row], buckets)
    ratio = np.log((present[0] + smoothing) / (toxic + 2 * smoothing)) - np.log((present[1] + smoothing) / (len(label) - toxic + 2 * smoothing))
    value = value * ratio[bucket].astype(np.float32)
    # texts have few percent toxic words, so features are brought to unit mean square together
    scale = 1 / np.sqrt(max(np.bincount(row, value.astype(np.float64) ** 2, len(rows)).mean(), 1e-12))
    value = value * np.float32(scale)
    share = np.where(label == 1, (len(label) / (2 * toxic)) ** BALANCE, (len(label) / (2 * (len(label) - toxic))) ** BALANCE)
    share /= share.sum()
    weight, intercept = np.zeros(buckets), prior
    first, second = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for step in range(1, steps + 1):
        score = np.bincount(row, value * weight[bucket], len(rows)) + intercept
        error = (1 / (1 + np.exp(-score)) - label) * share
        slope = np.append(np.bincount(bucket, value * error[row], buckets) + penalty * weight, error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weight, intercept = weight - move[:-1], intercept - move[-1]
    return Model((weight * ratio * scale).astype(np.float32), float(intercept))


def scored(texts: pa.Array, model: Model, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    words = split_words(texts, PLAIN)
    grams, at = word_grams(words.vocabulary, orders, len(model.weights))
    total = np.concatenate([[0.0], np.cumsum(model.weights[grams], dtype=np.float64)])
    of_word = (total[at[1:]] - total[at[:-1]])[words.codes]
    so_far = np.concatenate([[0.0], np.cumsum(of_word)])
    mean = (so_far[words.bounds[1:]] - so_far[words.bounds[:-1]]) / np.maximum(np.diff(words.bounds), 1)
    return 1 / (1 + np.exp(-np.clip(mean + model.intercept, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE,
        orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, folds: int = FOLDS) -> Model:
    """The classifier from labelled documents outside fold 0."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            found = features(piece.column("text"), orders, buckets)
            yield pa.RecordBatch.from_arrays(
                [piece.column("label"), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                ["label", "buckets", "shares"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(row["label"], np.frombuffer(row["buckets"], np.int32), np.frombuffer(row["shares"], np.float32)) for b in batches for row in b.to_pylist()]
        rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))  # sums do not depend on the order of arrival
        model = fitted(rows, buckets)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.intercept])], ["weights", "intercept"])

    rows = labelled_sample(docs.select(docs[id_column], docs[text_column].cast("string").alias("text")), labels, label, sample, id_column, ("text",), folds)
    described = rows.mapInArrow(describe, "label int, buckets binary, shares binary")
    row = described.repartition(1).mapInArrow(train, "weights binary, intercept double").first()
    return Model(np.frombuffer(row.weights, np.float32), row.intercept) if row else Model(np.zeros(buckets, np.float32), 0.0)


def toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """One row per document: id and score in [0, 1]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(scored(piece.column("text"), shared.value, orders))], ["id", "score"])

    source = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_column)
