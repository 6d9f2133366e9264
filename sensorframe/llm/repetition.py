"""Repetition inside a document, from a suffix array over its words.

The words of a batch of documents are sorted as suffixes by prefix doubling, every document for
itself (its number leads the first key). Only suffixes that still share a prefix with another one go
into the next doubling, so prose costs a few sorts and only repeated passages cost more. The longest
common prefixes of neighbouring suffixes are read off the ranks kept from each doubling, longest
step first. A repeat is a prefix of ``min_words`` or more shared by neighbours; the spans of all
repeats are united into the covered words.

Results for odd input: null or empty text has no words and no repeats; equal rows are measured one by
one; an empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorframe.llm.words import PLAIN, chunks, plain_strings, split_words, text_bytes

MIN_WORDS = 8
#: Share of the words that repeats may cover, in hundredths.
MAX_COVERED = 20
#: Words of the longest repeat that a document may have.
MAX_LONGEST = 60
#: Least words, and share of words in repeated windows in hundredths, of the base rule.
LEAST_WORDS, BASE_COVERED = 20, 30

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

FIGURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, "
    "spans array<struct<first:long,last:long>>, base_failed boolean, kept boolean"
)


def suffix_ranks(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all documents, and the ranks by the first 1, 2, 4, ... words."""
    n = len(codes)
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][document]
    key = document * np.int64(codes.max(initial=0) + 1) + codes
    active = np.arange(n)
    order = np.empty(n, np.int64)
    rank = np.empty(n, np.int64)
    base = np.zeros(n, np.int64)  # place in the suffix array where the group of an active suffix begins
    levels: list[np.ndarray] = []
    step = 0
    while True:
        by_key = np.argsort(key, kind="stable")
        active, key, base = active[by_key], key[by_key], base[by_key]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        # groups keep their order, so a subgroup begins as far behind its group as it does here
        group_new = np.ones(len(base), bool)
        group_new[1:] = base[1:] != base[:-1]
        group_at = np.flatnonzero(group_new)
        offset = np.repeat(starts, sizes) - np.repeat(group_at, np.diff(np.append(group_at, len(base))))
        place = base + offset
        rank[active] = place
        order[place + np.arange(len(key)) - np.repeat(starts, sizes)] = active
        levels.append(rank.astype(np.int32))
        shared = np.repeat(sizes > 1, sizes)
        if not shared.any():
            return order, levels
        step = 2 * step if step else 1
        active, base = active[shared], place[shared]
        ahead = active + step
        inside = ahead < end[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = base * np.int64(n + 1) + second


def shared_prefixes(order: np.ndarray, levels: list[np.ndarray], bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of the suffix array with ``least`` common words or more, and how many they share."""
    n = len(order)
    floor = levels[min(least.bit_length() - 1, len(levels) - 1)]  # equal here: 2**k <= least words in common
    at = np.flatnonzero(floor[order[1:]] == floor[order[:-1]])
    left, right = order[at], order[at + 1]
    end = bounds[1:][np.searchsorted(bounds, left, side="right") - 1]
    common = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        same = (a < end) & (b < end)
        same &= levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        common[same] += 1 << k
    enough = common >= least
    return left[enough], right[enough], common[enough]


def repeats(codes: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word whether a repeat covers it, and per document its longest repeat."""
    n = len(codes)
    longest = np.zeros(len(bounds) - 1, np.int64)
    if n == 0:
        return np.zeros(0, bool), longest
    order, levels = suffix_ranks(codes, bounds)
    if 1 << len(levels) <= least:
        return np.zeros(n, bool), longest
    left, right, common = shared_prefixes(order, levels, bounds, least)
    edge = np.zeros(n + 1, np.int64)
    for begin in (left, right):
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + common, -1)
        np.maximum.at(longest, np.searchsorted(bounds, begin, side="right") - 1, common)
    return np.cumsum(edge[:-1]) > 0, longest


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measured(texts: pa.Array, least: int, max_covered: float, max_longest: int) -> dict[str, pa.Array]:
    texts = plain_strings(texts)
    words = split_words(texts, PLAIN)
    byte_bounds, raw = text_bytes(texts)
    data = np.frombuffer(raw, np.uint8)
    # a code point begins where a byte is no continuation
    chars = _sums(((data & 0xC0) != 0x80) & (data != 32) & ~((data >= 9) & (data <= 13)), byte_bounds)
    lines = []
    for begin, end in zip(byte_bounds[:-1].tolist(), byte_bounds[1:].tolist()):
        own = [x for x in raw[begin:end].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        lines.append(len(own) - len(set(own)))
    covered, longest = repeats(words.codes.astype(np.int64), words.bounds, least)
    n_words = np.diff(words.bounds)
    n_covered = _sums(covered, words.bounds)
    # spans: where covered changes, cut at document ends
    opens = covered.copy()
    opens[1:] &= ~covered[:-1]
    closes = covered.copy()
    closes[:-1] &= ~covered[1:]
    inner = words.bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(covered))]
    opens[inner] = covered[inner]
    closes[inner - 1] = covered[inner - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    span_bounds = np.searchsorted(first, words.bounds)
    own_start = np.repeat(words.bounds[:-1], np.diff(span_bounds))
    spans = pa.ListArray.from_arrays(
        pa.array(span_bounds, pa.int32()),
        pa.StructArray.from_arrays([pa.array(first - own_start), pa.array(last - own_start)], ["first", "last"]),
    )
    base_failed = (n_words < LEAST_WORDS) | (100 * n_covered > BASE_COVERED * n_words)
    kept = ~base_failed & (100 * n_covered <= max_covered * n_words) & (longest <= max_longest)
    return {
        "n_words": pa.array(n_words),
        "word_chars": pa.array(chars),
        "n_symbols": pa.array(_sums(SYMBOLS[data], byte_bounds)),
        "n_dup_lines": pa.array(lines, pa.int64()),
        "n_repeat_words": pa.array(n_covered),
        "longest_repeat": pa.array(longest),
        "spans": spans,
        "base_failed": pa.array(base_failed),
        "kept": pa.array(kept),
    }


def repetition(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS,
               max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document: its words, covered words, longest repeat, covered spans (word numbers) and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            figures = measured(piece.column("text"), min_words, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([piece.column("id"), *figures.values()], ["id", *figures])

    source = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, {FIGURES}").withColumnRenamed("id", id_column)


def without_repetitive(docs: DataFrame, text_column: str = "text", min_words: int = MIN_WORDS,
                       max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The documents that pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, text_column):
            yield piece.filter(measured(piece.column(text_column), min_words, max_covered, max_longest)["kept"])

    return docs.mapInArrow(run, docs.schema)
