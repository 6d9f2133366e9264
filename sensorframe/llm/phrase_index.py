"""Positional inverted index over training text, and the benchmark phrases found in it.

**Index.** Documents are taken in blocks of about ``BLOCK_BYTES`` of text, each block a row of a stored
table: its documents, its sorted terms and, term by term, the ascending word places of the term in the
block (documents lie one behind the other, so a place names document and position). No token of any
document is left out. Blocks are bounded, built on the map side and never shuffled.

**Search.** A phrase is a window of consecutive item words. In every block the terms of a window are
ordered by the length of their posting lists there; the rarest list, moved back by its offset in the
window, gives the candidate starts, and each further list, moved likewise, is intersected with them.
All windows advance together through binary searches in the block's postings. Proximity search keeps
the rarest term's places as anchors and asks each other list for a place at most ``within`` words away.

The test items are collected in slices of at most ``SLICE_WORDS`` words (an item longer than that is a
slice of its own), so what is broadcast is bounded; beyond one slice the blocks are searched once per
slice and the spans united.

Results for odd input: null or empty texts have no words and no hits, null or wordless items no
windows; items without an id are ignored; rows that share an item id are one item; equal document rows
are reported one by one; empty tables give empty results or rows without hits; further columns are
passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.session import dropped, stored
from sensorframe.llm.words import LETTERS, chunks, split_words

WINDOW = 10
BLOCK_BYTES = 1 << 20
SLICE_WORDS = 2_000_000
CANDIDATES = 1 << 20  # starts examined together


# ---------------------------------------------------------------- index

def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The stored table of blocks. ``keys`` holds a hash of each text, which tells rows with equal ids apart."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for piece in chunks(batches, "text", BLOCK_BYTES):
            words = split_words(piece.column("text"), LETTERS)
            by_name = pc.array_sort_indices(words.vocabulary)
            rank = np.empty(len(by_name), np.int32)
            rank[np.asarray(by_name)] = np.arange(len(by_name), dtype=np.int32)
            term = rank[words.codes]
            places = np.argsort(term, kind="stable").astype("<i4")
            ends = np.cumsum(np.bincount(term, minlength=len(rank))).astype("<i4")
            row = {
                "block": pa.array([block]),
                "ids": _one(piece.column("id")),
                "keys": _one(piece.column("key")),
                "bounds": pa.array([words.bounds.astype("<i8").tobytes()], pa.binary()),
                "terms": _one(words.vocabulary.take(by_name)),
                "ends": pa.array([ends.tobytes()], pa.binary()),
                "places": pa.array([places.tobytes()], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))
            block += 1

    source = docs.select(docs[id_column].alias("id"), F.xxhash64(docs[text_column].cast("string")).alias("key"),
                         docs[text_column].cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    blocks = source.mapInArrow(build, f"block long, ids array<{kind}>, keys array<long>, bounds binary, terms array<string>, ends binary, places binary")
    return stored(blocks, "postings", **{"parquet.page.size.row.check.min": 2, "parquet.block.size.row.check.min": 2})


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


# ---------------------------------------------------------------- what is searched

class Phrases(NamedTuple):
    vocabulary: pa.StringArray  # of the items
    terms: np.ndarray  # windows x longest window, codes, -1 behind the end
    lengths: np.ndarray
    owners: np.ndarray  # owners[at[w] : at[w + 1]] are the items of window w
    at: np.ndarray
    items: list[str]


def phrases_of(texts: list[tuple[str, str]], window: int) -> Phrases:
    """Distinct windows of the (item id, text) pairs and the items that have them."""
    words = split_words(pa.array([t for _, t in texts], pa.string()), LETTERS)
    items = sorted({i for i, _ in texts})
    number = {i: n for n, i in enumerate(items)}
    found: dict[bytes, set[int]] = {}
    codes = words.codes.astype(np.int32)
    for (item, _), a, b in zip(texts, words.bounds[:-1], words.bounds[1:]):
        width = min(window, b - a)
        for s in range(a, b - width + 1) if width else ():
            found.setdefault(codes[s : s + width].tobytes(), set()).add(number[item])
    lengths = np.array([len(k) // 4 for k in found], np.int64)
    terms = np.full((len(found), window), -1, np.int64)
    for row, key in zip(terms, found):
        own = np.frombuffer(key, np.int32)
        row[: len(own)] = own
    owners = [sorted(v) for v in found.values()]
    at = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
    return Phrases(words.vocabulary, terms, lengths, np.array([x for o in owners for x in o], np.int64), at, items)


def item_slices(items: DataFrame, id_column: str, text_column: str, window: int, slice_words: int) -> list[Phrases]:
    rows = items.select(items[id_column].cast("string").alias("i"), items[text_column].cast("string").alias("t")).filter("i is not null and t is not null")
    rows = rows.withColumn("n", F.length("t") / 2 + 1)  # words at most
    total, most = rows.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return []
    slices = int(2 * total // slice_words) + 1
    dealt = rows.withColumn("s", F.pmod(F.xxhash64("i", "t"), F.lit(slices)))
    return [phrases_of([(r.i, r.t) for r in dealt.filter(F.col("s") == s).collect()], window) for s in range(slices)]


# ---------------------------------------------------------------- search

class Block(NamedTuple):
    bounds: np.ndarray
    terms: pa.StringArray
    ends: np.ndarray
    keys: np.ndarray  # term number x block words + place, ascending


def opened(row: dict) -> Block:
    bounds, ends = np.frombuffer(row["bounds"], "<i8"), np.frombuffer(row["ends"], "<i4").astype(np.int64)
    places = np.frombuffer(row["places"], "<i4").astype(np.int64)
    term = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return Block(bounds, row["terms"], ends, term * (len(places) + 1) + places)


def _local(block: Block, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows all of whose terms the block has, their terms there, and their offsets from the rarest term on."""
    known = pc.fill_null(pc.index_in(phrases.vocabulary, value_set=block.terms), -1).to_numpy(zero_copy_only=False)
    known = np.append(known, -1).astype(np.int64)
    inside = np.arange(phrases.terms.shape[1]) < phrases.lengths[:, None]
    local = known[phrases.terms]
    window = np.flatnonzero(((local >= 0) | ~inside).all(axis=1))
    local, inside = local[window], inside[window]
    often = np.diff(block.ends, prepend=0)
    cost = np.where(inside, often[local] if len(often) else 0, np.iinfo(np.int64).max)
    return window, local, np.argsort(cost, axis=1, kind="stable")


def _candidates(block: Block, local: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, place of its rarest term), in bounded portions."""
    if not len(local):
        return
    rarest = local[np.arange(len(local)), offsets[:, 0]]
    first = np.concatenate([[0], block.ends])[rarest]
    many = block.ends[rarest] - first
    size = block.ends[-1] + 1
    upto = np.cumsum(many)
    begin = 0
    while begin < len(many):
        before = upto[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(upto, before + CANDIDATES, side="right")))
        own = many[begin:stop]
        w = np.repeat(np.arange(begin, stop), own)
        at = np.repeat(first[begin:stop] - np.cumsum(own) + own, own) + np.arange(own.sum())
        yield w, block.keys[at] - rarest[w] * size
        begin = stop


def exact_matches(block: Block, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every occurrence within one document."""
    window, local, offsets = _local(block, phrases)
    size = block.ends[-1] + 1 if len(block.ends) else 1
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for w, place in _candidates(block, local, offsets):
        start = place - offsets[w, 0]
        fits = start >= 0
        w, start = w[fits], start[fits]
        last = start + phrases.lengths[window[w]]
        fits = last <= block.bounds[np.searchsorted(block.bounds, start, side="right")]
        w, start = w[fits], start[fits]
        for k in range(1, offsets.shape[1]):
            more = phrases.lengths[window[w]] > k
            offset = offsets[w, k]
            wanted = local[w, offset] * size + start + offset
            near = block.keys[np.minimum(np.searchsorted(block.keys, wanted), len(block.keys) - 1)]
            same = ~more | (near == wanted)
            w, start = w[same], start[same]
        found.append((window[w], start))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_matches(block: Block, phrases: Phrases, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its rarest term) where every other term lies at most ``within`` words away in the document."""
    window, local, offsets = _local(block, phrases)
    size = block.ends[-1] + 1 if len(block.ends) else 1
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for w, place in _candidates(block, local, offsets):
        for k in range(1, offsets.shape[1]):
            document = np.searchsorted(block.bounds, place, side="right")
            more = phrases.lengths[window[w]] > k
            base = local[w, offsets[w, k]] * size
            low = base + np.maximum(place - within, block.bounds[document - 1])
            high = base + np.minimum(place + within, block.bounds[document] - 1)
            near = np.searchsorted(block.keys, low)
            same = ~more | ((near < len(block.keys)) & (block.keys[np.minimum(near, len(block.keys) - 1)] <= high))
            w, place = w[same], place[same]
        found.append((window[w], place))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _spans(start: np.ndarray, stop: np.ndarray, size: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last covered places, apart at document borders."""
    edge = np.bincount(start, minlength=size + 1) - np.bincount(stop, minlength=size + 1)
    covered = np.cumsum(edge)[:size] > 0
    opens, closes = covered.copy(), covered.copy()
    opens[1:] &= ~covered[:-1]
    closes[:-1] &= ~covered[1:]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < size)]
    opens[inner], closes[inner - 1] = covered[inner], covered[inner - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes)


def find_phrases(index: DataFrame, items: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW,
                 within: int | None = None, slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row per indexed document: id, key, n_words, spans (word numbers, united) and the ids of matched items.

    With ``within`` the matches are proximity matches, and spans are the places of their rarest terms.
    """
    spark = index.sparkSession
    slices = item_slices(items, id_column, text_column, window, slice_words) or [phrases_of([], window)]
    kind = index.schema["ids"].dataType.elementType
    schema = f"block long, row int, id {kind.simpleString()}, key long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"

    def searching(phrases):
        shared = spark.sparkContext.broadcast(phrases)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            names = pa.array(wanted.items, pa.string())
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i] for n in batch.schema.names}
                    block = opened({"terms": row["terms"].values, **{n: row[n].as_py() for n in ("bounds", "ends", "places")}})
                    bounds = block.bounds
                    n, size = len(bounds) - 1, int(bounds[-1])
                    if within is None:
                        w, start = exact_matches(block, wanted)
                        stop = start + wanted.lengths[w]
                    else:
                        w, start = near_matches(block, wanted, within)
                        stop = start + 1
                    first, last = _spans(start, stop, size, bounds)
                    at = np.searchsorted(first, bounds)
                    own = np.repeat(bounds[:-1], np.diff(at))
                    document = np.searchsorted(bounds, start, side="right") - 1
                    pairs = np.unique(document * len(wanted.at) + w)
                    document, w = pairs // len(wanted.at), pairs % len(wanted.at)
                    many = np.diff(wanted.at)[w]
                    owner = wanted.owners[np.repeat(wanted.at[:-1][w] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    pairs = np.unique(np.repeat(document, many) * (len(names) + 1) + owner)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, row["block"].as_py())), pa.array(np.arange(n, dtype=np.int32)), row["ids"].values, row["keys"].values,
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(first - own), pa.array(last - own)], ["first", "last"])),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // (len(names) + 1), np.arange(n + 1)), pa.int32()), names.take(pa.array(pairs % (len(names) + 1)))),
                    ], schema=None, names=["block", "row", "id", "key", "n_words", "spans", "items"])

        return index.mapInArrow(search, schema)

    found = [searching(p) for p in slices]
    if len(found) == 1:
        return found[0].drop("block", "row")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    joined = every.groupBy("block", "row").agg(
        F.first("id").alias("id"), F.first("key").alias("key"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return joined.withColumn("spans", _united("spans")).drop("block", "row")


def _united(spans: str) -> F.Column:
    """Sorted spans with overlaps joined."""
    return F.aggregate(
        spans, F.expr("cast(array() as array<struct<first:long,last:long>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= s["first"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(s))))


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                  window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Index the documents, find the items' windows, and report each document: id, key, n_words, spans, items, n_hit."""
    index = build_index(docs, id_column, text_column)
    found = find_phrases(index, items, item_column, "text", window, None, slice_words)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.withColumn("n_hit", hit).withColumnRenamed("id", id_column)


def without_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns."""
    index = build_index(docs, id_column, text_column)
    found = find_phrases(index, items).filter(F.size("spans") > 0)
    bad = stored(found.select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct(), "contaminated")
    dropped(index)  # as large as the documents
    same = docs[id_column].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text_column].cast("string")) == bad["_key"])
    return docs.join(bad, same, "left_anti")
