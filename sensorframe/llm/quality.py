"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

The features of a text are its lower-cased words, hashed and weighted by the logarithm of their counts at
unit length; its structure statistics (lengths, shares of symbols, digits, capitals, repeated words and
lines, and so on); and its recorded character count. Statistics are cut at quantiles of the training
sample and each interval is a feature, so the pairwise term can tell a share that is odd from one that is
odd for the text's length or words. Every feature has a weight and a vector of ``RANK`` numbers; a pair
weighs the product of its vectors. With s = sum v x, all pairs together are half of the sum of s squared
minus v squared x squared, so a score takes time linear in the features of the text.

Fitting uses at most ``SAMPLE`` labelled rows, those with the least hash of their id; they are described in
parallel and the fit runs in one task on that bounded matrix. Scoring is one pass over all texts.

Results for odd input: null and empty texts have no words and the lowest statistics; a null character
count is an interval of its own; labels other than 0 and 1 and label rows without a document are ignored;
an id with both labels counts as good; without both classes in the sample the intercept alone is fitted;
an empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sensorframe.llm.learning import FOLDS, labelled_sample
from sensorframe.llm.words import FOLDED, chunks, mixed, plain_strings, split_words, text_bytes, word_hashes

WORD_BUCKETS = 1 << 15
RANK = 8
#: Labelled rows that the fit uses at most.
SAMPLE = 4000
INTERVALS = 12
STEPS = 100
PENALTY = 1e-5
SEED = 7

STATISTICS = (
    "characters", "words", "word_length", "longest_word", "symbols", "digits", "capitals", "punctuation", "other_bytes", "lines",
    "words_per_line", "repeated_lines", "distinct_words", "same_as_before", "bars", "sentence_ends", "recorded_characters",
)


class Model(NamedTuple):
    edges: np.ndarray  # statistics x inner edges, the unused ones infinite
    weights: np.ndarray
    vectors: np.ndarray
    intercept: float


def _table(characters: bytes) -> np.ndarray:
    hit = np.zeros(256, bool)
    hit[list(characters)] = True
    return hit


_SYMBOLS, _DIGITS, _CAPITALS = _table(b"#*$%&<>@^~_=+\\/"), _table(b"0123456789"), _table(bytes(range(65, 91)))
_PUNCTUATION, _BARS, _ENDS, _HIGH = _table(b".,;:!?'\"()-"), _table(b"|{}[]"), _table(b".!?"), _table(bytes(range(128, 256)))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: pa.Array, recorded: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Texts x statistics, and each text's word buckets with their weights."""
    texts = plain_strings(texts)
    words = split_words(texts, FOLDED)
    bounds, raw = text_bytes(texts)
    data = np.frombuffer(raw, np.uint8)
    size = np.maximum(np.diff(bounds), 1)
    many = np.diff(words.bounds)
    n_words = np.maximum(many, 1)
    length = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False)[words.codes].astype(np.float64)
    own = np.repeat(np.arange(len(many)), many)
    longest = np.zeros(len(many))
    np.maximum.at(longest, own, length)
    same = np.zeros(len(words.codes))
    same[1:] = words.codes[1:] == words.codes[:-1]
    lines, repeated = np.zeros(len(many)), np.zeros(len(many))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        filled = [x for x in raw[a:b].split(b"\n") if x]
        lines[i], repeated[i] = len(filled), len(filled) - len(set(filled))
    bucket = (mixed(word_hashes(words.vocabulary)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    found, distinct = [], np.zeros(len(many))
    for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
        at, times = np.unique(bucket[words.codes[a:b]], return_counts=True)
        weight = np.log1p(times)
        found.append((at.astype(np.int32), (weight / max(np.sqrt((weight**2).sum()), 1e-9)).astype(np.float32)))
        distinct[i] = len(at)
    share = lambda table: _per_text(table[data], bounds) / size
    columns = {
        "characters": np.log1p(np.diff(bounds)), "words": np.log1p(many), "word_length": _per_text(length, words.bounds) / n_words,
        "longest_word": np.log1p(longest), "symbols": share(_SYMBOLS), "digits": share(_DIGITS), "capitals": share(_CAPITALS),
        "punctuation": share(_PUNCTUATION), "other_bytes": share(_HIGH), "lines": np.log1p(lines), "words_per_line": np.log1p(many / np.maximum(lines, 1)),
        "repeated_lines": repeated / np.maximum(lines, 1), "distinct_words": distinct / n_words, "same_as_before": _per_text(same, words.bounds) / n_words,
        "bars": share(_BARS), "sentence_ends": _per_text(_ENDS[data], bounds) / n_words, "recorded_characters": np.where(np.isnan(recorded), -1, np.log1p(np.maximum(recorded, 0))),
    }
    return np.stack([columns[name] for name in STATISTICS], axis=1), found


def cut_at_quantiles(values: np.ndarray) -> np.ndarray:
    """Inner edges of about equally filled intervals of each column; repeated quantiles count once."""
    edges = np.full((values.shape[1], INTERVALS), np.inf)
    for j in range(values.shape[1]):
        own = np.unique(np.quantile(values[:, j], np.arange(1, INTERVALS) / INTERVALS))
        edges[j, : len(own)] = own
    return edges


def joined(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row begins, features, values): each text's statistic intervals, then its words."""
    width = INTERVALS + 1
    interval = np.stack([np.searchsorted(edges[j], stats[:, j], side="left") for j in range(stats.shape[1])], axis=1)
    interval = WORD_BUCKETS + np.arange(stats.shape[1]) * width + interval
    value = np.full(stats.shape[1], 1 / np.sqrt(stats.shape[1]), np.float32)
    features = [x for row, (b, _) in zip(interval, words) for x in (row, b)]
    values = [x for _, v in words for x in (value, v)]
    begins = np.concatenate([[0], np.cumsum([stats.shape[1] + len(b) for b, _ in words])]).astype(np.int64)
    return begins, np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*values, np.zeros(0, np.float32)])


def raw_scores(begins: np.ndarray, features: np.ndarray, values: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear and pairwise terms without the intercept, and the sums s of each text; every text has features."""
    if len(begins) == 1:
        return np.zeros(0), np.zeros((0, vectors.shape[1]))
    scaled = vectors[features] * values[:, None]
    sums = np.add.reduceat(scaled, begins[:-1], axis=0)
    squares = np.add.reduceat((scaled**2).sum(axis=1), begins[:-1])
    return np.add.reduceat(weights[features] * values, begins[:-1]) + ((sums**2).sum(axis=1) - squares) / 2, sums


def fitted(label: np.ndarray, stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], rank: int = RANK, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    total = WORD_BUCKETS + len(STATISTICS) * (INTERVALS + 1)
    good = label.sum()
    prior = float(np.log((good + 0.5) / (len(label) - good + 0.5)))
    edges = cut_at_quantiles(stats) if len(label) else np.full((len(STATISTICS), INTERVALS), np.inf)
    weights, intercept = np.zeros(total), prior
    if good in (0, len(label)):
        return Model(edges, weights.astype(np.float32), np.zeros((total, rank), np.float32), intercept)
    vectors = np.random.default_rng(SEED).normal(0, 0.05, (total, rank))
    begins, features, values = joined(stats, words, edges)
    values = values.astype(np.float64)
    row = np.repeat(np.arange(len(label)), np.diff(begins))
    squared = values**2
    first, second = np.zeros((total, rank + 1)), np.zeros((total, rank + 1))
    for step in range(1, steps + 1):
        score, sums = raw_scores(begins, features, values, weights, vectors)
        error = (1 / (1 + np.exp(-score - intercept)) - label) / len(label)
        pull = values * error[row]
        slope = np.empty((total, rank + 1))
        slope[:, 0] = np.bincount(features, pull, total) + penalty * weights
        own = np.bincount(features, squared * error[row], total)
        for f in range(rank):
            slope[:, f + 1] = np.bincount(features, pull * sums[row, f], total) - own * vectors[:, f] + penalty * vectors[:, f]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        weights, vectors = weights - move[:, 0], vectors - move[:, 1:]
        intercept -= 2.0 * error.sum()
    return Model(edges, weights.astype(np.float32), vectors.astype(np.float32), float(intercept))


def scored(texts: pa.Array, recorded: np.ndarray, model: Model) -> np.ndarray:
    stats, words = statistics(texts, recorded)
    score, _ = raw_scores(*joined(stats, words, model.edges), model.weights, model.vectors)
    return 1 / (1 + np.exp(-np.clip(score.astype(np.float64) + model.intercept, -500, 500)))


def _recorded(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _source(docs: DataFrame, id_column: str, text_column: str, size_column: str) -> DataFrame:
    return docs.select(docs[id_column], docs[text_column].cast("string").alias("text"), docs[size_column].try_cast("double").alias("recorded"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars",
        sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """The machine from labelled documents outside fold 0."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            stats, words = statistics(piece.column("text"), _recorded(piece.column("recorded")))
            yield pa.RecordBatch.from_arrays([
                piece.column("label"), pa.array([s.tobytes() for s in stats], pa.binary()), pa.array([b.tobytes() for b, _ in words], pa.binary()),
                pa.array([v.tobytes() for _, v in words], pa.binary())], ["label", "stats", "buckets", "shares"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(row.values()) for b in batches for row in b.to_pylist()]
        rows.sort()  # sums do not depend on the order of arrival
        stats = np.array([np.frombuffer(r[1], np.float64) for r in rows]).reshape(-1, len(STATISTICS))
        words = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows]
        model = fitted(np.array([r[0] for r in rows], np.float64), stats, words)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in model[:3]] + [pa.array([model.intercept])], ["edges", "weights", "vectors", "intercept"])

    rows = labelled_sample(_source(docs, id_column, text_column, size_column), labels, label, sample, id_column, ("text", "recorded"), folds)
    described = rows.mapInArrow(describe, "label int, stats binary, buckets binary, shares binary")
    row = described.repartition(1).mapInArrow(train, "edges binary, weights binary, vectors binary, intercept double").first()
    return Model(np.frombuffer(row.edges).reshape(len(STATISTICS), -1), np.frombuffer(row.weights, np.float32),
                 np.frombuffer(row.vectors, np.float32).reshape(-1, RANK), row.intercept)


def quality(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """One row per document: id and score in [0, 1]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about WORD_BUCKETS x (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text", 2 << 20):
            score = scored(piece.column("text"), _recorded(piece.column("recorded")), shared.value)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(score)], ["id", "score"])

    source = _source(docs, id_column, text_column, size_column).withColumnRenamed(id_column, "id")
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_column)
