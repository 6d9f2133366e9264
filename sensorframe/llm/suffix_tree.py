"""Language-model scores from a probabilistic suffix tree over words.

**Tree.** A context is the last 1 to ``DEPTH`` tokens. Candidates are contexts that occur at least ``LEAST`` times
before a token of the training documents, at every corpus size, so their number grows with the corpus. A
candidate is retained if what follows it diverges from what follows its suffix (the context without its
oldest token): the gain of its followers' likelihood over the suffix's has to exceed half the logarithm of
the corpus for each follower, the usual price of a parameter. Followers seen once count together as one.
Suffixes of retained contexts are retained.

**Smoothing.** P(w | s) = (c - D) / n for followers seen twice or more, plus the mass left over times
P(w | suffix of s), down to the root (c + 0.1) / (N + 0.1 (V + 1)). Every distribution sums to one.

**Score.** Each token is scored from the longest retained suffix of the tokens before it.

**How it runs.** Documents become stored blocks of bounded size with their tokens as codes. A context of d
tokens and a follower after d - 1 are both word sequences, so one count of all sequences of 1 to ``DEPTH`` + 1
tokens gives context totals and followers alike. Blocks send their sequences' hashes with their own counts to
shards by hash, and the shard adds up and answers each block. Lengths are counted one after the other, without
sequences that are sure to be seen once or to follow a context that cannot pass the test. A shard tells one of the
blocks that hold a sequence that it is the first, so every follower's divergence term is sent once, by that block; the terms are added by
context in shards. Retained contexts are a stored
table that blocks look up by shuffled key. The counts are settled in the blocks once, so later steps read them without a shuffle, and every table is
deleted when the next one has it. The number of shards follows the number of tokens; nothing but the corpus size and the vocabulary size reaches the driver. Sequences are told apart by 61 bits of a hash.

Results for odd input: a null or empty text is the end token alone; null ids are in fold 0, which is not
trained on; without training rows all counts are 0 and every token has probability 1 / (V + 1) = 1; equal
rows are scored one by one and count each; an empty table gives an empty result; further columns are
passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.learning import fold_of
from sensorframe.llm.session import dropped, stored
from sensorframe.llm.words import FOLDED, chunks, mixed, split_words, word_hashes

DEPTH = 3
#: Occurrences of a candidate context; a context seen once never passes the divergence test.
LEAST = 2
DISCOUNT = 0.5
ADDED = 0.1
FOLDS = 10
END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LENGTH_BITS = 3
#: Text of a block; the work on one holds some sixty bytes for each of it.
BLOCK_BYTES = 4 << 20
#: Tokens for each shard that counts them, and the longest context whose sequences the length bits can name.
SHARD_TOKENS, DEEPEST = 1 << 20, (1 << _LENGTH_BITS) - 2


# ---------------------------------------------------------------- keys

def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted number in the ascending keys, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _keys(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The key of the n tokens up to each of the places, which have that many; the low bits tell the length."""
    total = np.zeros(len(at), np.uint64)
    for back in range(n):
        total += words[at - back] * (mixed(np.array([back + 1], np.uint64) * _STEP) | np.uint64(1))
    return (mixed(total + np.uint64(n)) >> np.uint64(_LENGTH_BITS) << np.uint64(_LENGTH_BITS)) | np.uint64(n)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys, and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by shard, and where each shard begins in it."""
    # numbers of two bytes are sorted by counting
    shard = (mixed(keys) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    return np.argsort(shard, kind="stable"), np.append(0, np.cumsum(np.bincount(shard, minlength=shards)))


# ---------------------------------------------------------------- blocks and shards

#: Rows of blocks are large, so files look at their size often; their bytes are compressed already.
_WHOLE_ROWS = {"parquet.page.size.row.check.min": 2, "parquet.block.size.row.check.min": 2, "parquet.enable.dictionary": "false", "compression": "uncompressed"}

def _blocks(docs: DataFrame, id_column: str, text_column: str, folds: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for piece in chunks(batches, "text", BLOCK_BYTES):
            words = split_words(piece.column("text"), FOLDED)
            bounds = words.bounds + np.arange(len(words.bounds))
            codes = np.insert(words.codes.astype(np.int32), words.bounds[1:], len(words.vocabulary)).astype("<i4")
            hashes = np.append(word_hashes(words.vocabulary), END)
            # frequent words get small codes, which squeeze well
            often = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")
            place = np.empty(len(hashes), "<i4")
            place[often] = np.arange(len(hashes), dtype="<i4")
            codes, hashes = place[codes], hashes[often]
            row = {
                "block": pa.array([block]),
                "ids": pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column("id")),
                "folds": pa.array([_squeezed(piece.column("fold").to_numpy().astype("<i4"))], pa.binary()),
                "bounds": pa.array([_squeezed(bounds.astype("<i8"))], pa.binary()),
                "hashes": pa.array([_squeezed(hashes)], pa.binary()),
                "codes": pa.array([_squeezed(codes)], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))
            block += 1

    source = docs.select(docs[id_column].alias("id"), fold_of(docs[id_column], folds).cast("int").alias("fold"), docs[text_column].cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    built = source.mapInArrow(build, f"block long, ids array<{kind}>, folds binary, bounds binary, hashes binary, codes binary")
    return stored(built, "tokens", **_WHOLE_ROWS)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes as keys use them, document bounds and folds."""
    return mixed(_loose(row["hashes"], "<u8"))[_loose(row["codes"], "<i4")], _loose(row["bounds"], "<i8"), _loose(row["folds"], "<i4")


_BLOCK_COLUMNS = ["block", "folds", "bounds", "hashes", "codes", "times", "firsts"]
_PRESS, _PRESSED = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, first bytes of all first, after one byte for their width; integers from 0 on in as few bytes as
    the largest needs, ascending keys as differences, whose last bytes are zero."""
    if values.dtype == np.uint64 and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    elif values.dtype.kind == "i" and len(values):
        values = values.astype(np.min_scalar_type(int(values.max())))
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return bytes([values.itemsize]) + _PRESS.compress(raw)


def _loose(squeezed: object, kind: str) -> np.ndarray:
    whole = memoryview(squeezed if isinstance(squeezed, bytes) else squeezed.as_buffer())
    raw, width, kind = np.frombuffer(_PRESSED.decompress(whole[1:]), np.uint8), whole[0], np.dtype(kind)
    values = np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}" if kind.kind == "i" else kind).ravel()
    return np.cumsum(values, dtype=np.uint64) if kind == np.uint64 else values.astype(kind, copy=False)


def _packed(by: np.ndarray, shards: int, columns: dict[str, np.ndarray], **fixed: object) -> Iterator[pa.RecordBatch]:
    """One row per shard that has entries: its entries of each column as bytes."""
    order, edges = _dealt(by, shards)
    filled = np.flatnonzero(np.diff(edges))
    columns = {name: values[order] for name, values in columns.items()}
    rows = {"shard": pa.array(filled.astype(np.int64))}
    rows |= {name: pa.array([value] * len(filled), pa.int64()) for name, value in fixed.items()}
    rows |= {name: pa.array([_squeezed(values[edges[s] : edges[s + 1]]) for s in filled], pa.binary()) for name, values in columns.items()}
    yield pa.RecordBatch.from_arrays(list(rows.values()), list(rows))


def _joined(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[_loose(x, kind) for x in table.column(column)]])


# ---------------------------------------------------------------- counts

class Tree(NamedTuple):
    """What every task has to know."""

    tokens: int  # of the training documents
    least: float  # occurrences of a candidate
    shards: int


def _answered(answers: pa.Table, length: int, kind: str, keys: np.ndarray, shards: int) -> np.ndarray:
    """Values of a block's ascending distinct keys from the shards' answers for this length."""
    answers = answers.filter(pa.array(answers.column("length").to_numpy() == length))
    values, (order, edges) = np.zeros(len(keys), kind), _dealt(keys, shards)
    for part, found in zip(answers.column("part").to_pylist(), answers.column("values")):
        values[order[edges[part] : edges[part + 1]]] = _loose(found, kind)
    return values


def _open_places(times: list[np.ndarray], bounds: np.ndarray, tree: Tree) -> np.ndarray:
    """Places whose context may be retained, from the counts of the sequences up to each place: of as many tokens, and of one less
    before it where there are such.

    A follower seen c times is seen o >= c times behind the suffix, so the gain of a context of total n with suffix's total a is at most
    n log(a / n). Of what is at most n and a, that is largest at a / e. Contexts for which that is below the least price, which is for
    one follower seen twice, cannot be retained, and neither can a longer one.
    """
    enough = np.append(False, times[-1][:-1] >= tree.least)
    enough[bounds[:-1]] = False
    at = np.flatnonzero(enough)
    total = times[-1][at - 1]
    above = times[-2][at - 1] if len(times) > 1 else np.full(len(at), tree.tokens)
    most = np.minimum(total, above / math.e)
    return at[most * np.log(above / most) > _least_gain(tree)]


def _least_gain(tree: Tree) -> float:
    return math.log(max(tree.tokens, 2)) - 1e-6


def _may_stay(total: np.ndarray, above: np.ndarray, times: np.ndarray | int, over: np.ndarray | int, last: bool, tree: Tree) -> np.ndarray:
    """Whether contexts may be retained, from one follower's count and its count behind the suffix: by their own gain or, unless they are
    of the greatest length, as suffixes of longer ones, whose gain is at most their suffix's total / e."""
    times = np.maximum(times, 1)
    gain = total * np.log(above / total) + times * np.log(times / np.maximum(over, times))
    return (gain > _least_gain(tree)) | (not last and total / math.e > _least_gain(tree))


def _times(row: dict, n: int) -> np.ndarray:
    """The training count of the n tokens up to each place, 0 where they are seen once or decide nothing.

    Counts of single tokens are kept once for each word of the block.
    """
    times = _loose(row["times"][n - 1], "<i8")
    return times[_loose(row["codes"], "<i4")] if n == 1 else times


def _counted_places(row: dict, n: int, tree: Tree) -> np.ndarray:
    """Places whose sequence of n tokens has to be counted: the others are seen once or decide nothing."""
    bounds = _loose(row["bounds"], "<i8")
    if n == 1:
        return np.arange(bounds[-1])
    times = [_times(row, m) for m in range(max(n - 2, 1), n)]
    at = _open_places(times, bounds, tree)
    return at[times[-1][at] > 1]


def _row(block: pa.Table) -> dict:
    return {name: block.column(name)[0].as_py() for name in _BLOCK_COLUMNS}


_ANSWER = "block long, part long, length long, values binary"


def _counted(blocks: DataFrame, longest: int, tree: Tree) -> tuple[DataFrame, int]:
    """Stored blocks with the counts of their sequences at each place, and the number of distinct training tokens.

    Lengths are counted one after the other, each for the places that the shorter ones leave open. The answers to a length are settled in the
    blocks, and the blocks and answers they come from are deleted; so every step reads one row a block.
    """
    def places(row: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places whose sequence of n tokens is to be counted, whether they are trained on, the distinct keys there, and each place's key among them."""
        words, bounds, folds = _opened(row)
        at, use = _counted_places(row, n, tree), np.repeat(folds != 0, np.diff(bounds))
        if n == 1:
            own = mixed(_loose(row["hashes"], "<u8"))
            distinct, place = _distinct(_keys(own, np.arange(len(own)), 1))
            return at, use, distinct, place[_loose(row["codes"], "<i4")]
        return at, use[at], *_distinct(_keys(words, at, n))

    def requests(n: int):
        def run(row: dict) -> Iterator[pa.RecordBatch]:
            _, use, distinct, place = places(row, n)
            times = np.bincount(place, use, len(distinct)).astype("<i4")
            yield from _packed(distinct, tree.shards, {"keys": distinct, "times": times}, block=row["block"])

        return run

    def settle(n: int):
        def run(block: pa.Table, told: pa.Table) -> pa.Table:
            row = _row(block)
            at, use, distinct, place = places(row, n)
            answers = _answered(told, n, "<i8", distinct, tree.shards)
            own = np.zeros(int(_loose(row["bounds"], "<i8")[-1]), "<i8")
            own[at] = (answers >> 1)[place]
            first = np.zeros(len(own), bool)
            if n == 1:
                places_of, own = own, np.zeros(len(_loose(row["hashes"], "<u8")), "<i8")
                own[_loose(row["codes"], "<i4")] = places_of
            else:
                one, trained = np.full(len(distinct), -1), np.flatnonzero(use)
                one[place[trained]] = at[trained]
                first[one[answers & 1 > 0]] = True
            lists = {"times": row["times"] + [_squeezed(own)], "firsts": row["firsts"] + [_squeezed(np.packbits(first))]}
            kept = block.drop_columns(list(lists))
            for name, values in lists.items():
                kept = kept.append_column(name, pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.binary())))
            return kept

        return run

    def add(n: int):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("block")
            asked = [_loose(x, "<u8") for x in table.column("keys")]
            keys, place = _distinct(np.concatenate(asked))
            own = _joined(table, "times", "<i4")
            total = np.bincount(place, own, len(keys)).astype("<i8")
            types = int((total > 0).sum())
            total[total < (1 if n == 1 else 2)] = 0
            # twice the count, and one more for the first block that trains on the sequence
            answer, held = 2 * total[place], np.flatnonzero(own)[::-1]
            first = np.full(len(keys), -1)
            first[place[held]] = held
            answer[first[total > 0]] += 1
            answers = np.split(answer, np.cumsum([len(a) for a in asked])[:-1])
            return pa.table({
                "block": table.column("block"), "part": table.column("shard"), "length": pa.array(np.full(len(asked), n)),
                "values": pa.array([_squeezed(a) for a in answers], pa.binary()), "types": pa.array([types] + [0] * (len(asked) - 1), pa.int64())})

        return run

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    fields = f"block long, ids array<{kind}>, folds binary, bounds binary, hashes binary, codes binary, times array<binary>, firsts array<binary>"
    state, types = blocks.withColumns({name: F.array().cast("array<binary>") for name in ("times", "firsts")}), 0
    for n in range(1, longest + 1):
        wanted = _each(state, requests(n), "shard long, block long, keys binary, times binary")
        found = stored(wanted.groupBy("shard").applyInArrow(add(n), _ANSWER + ", types long"), f"counts-{n}")
        if n == 1:
            types = int(found.agg(F.sum("types")).first()[0] or 0)
        told = found.select("block", "part", "length", "values").groupBy("block")
        after = stored(state.groupBy("block").cogroup(told).applyInArrow(settle(n), fields), "settled", **_WHOLE_ROWS)
        dropped(found, blocks if n == 1 else state)
        state = after
    return state, types


def _training_tokens(blocks: DataFrame) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [int(np.diff(_loose(b, "<i8"))[_loose(f, "<i4") != 0].sum()) for b, f in zip(batch.column("bounds"), batch.column("folds"))]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["n"])

    return int(blocks.select("bounds", "folds").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0)


def _each(blocks: DataFrame, work, fields: str) -> DataFrame:
    """What ``work`` makes of every settled block, one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield from work({name: batch.column(name)[at].as_py() for name in batch.schema.names})

    return blocks.select(*_BLOCK_COLUMNS).mapInArrow(run, fields)


# ---------------------------------------------------------------- divergence

def _levels(row: dict, depth: int, tree: Tree) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Counts of single tokens, and for each depth: the places whose context may be retained, and there the context's key, its total and
    the follower's count."""
    words, bounds, folds = _opened(row)
    use = np.repeat(folds != 0, np.diff(bounds))
    times, levels = [_times(row, n) for n in range(1, depth + 2)], []
    for d in range(1, depth + 1):
        at = _open_places(times[max(d - 2, 0) : d], bounds, tree)
        above = times[d - 2][at - 1] if d > 1 else tree.tokens
        # in a text that is not trained on, what is not seen twice may never have followed the context
        over = np.where(use[at] | (times[d][at] > 1), times[d - 1][at], 1)
        at = at[_may_stay(times[d - 1][at - 1], above, times[d][at], over, d == depth, tree)]
        levels.append((at, _keys(words, at - 1, d), times[d - 1][at - 1], times[d][at]))
    return times[0], levels


def _retained(blocks: DataFrame, depth: int, tree: Tree) -> DataFrame:
    """(key, spare) of the retained contexts: how much of their total is left to the suffix."""
    price = 0.5 * math.log(max(tree.tokens, 2))
    suffixes = [f"suffix{d}" for d in range(1, depth)]
    names = {"key": "<u8", **{s: "<u8" for s in suffixes}, **{n: "<i8" for n in ("total", "above", "times", "over", "twice")}, "gain": "<f8"}

    def terms(row: dict) -> Iterator[pa.RecordBatch]:
        words, _, _ = _opened(row)
        counts, found = [np.full(len(words), tree.tokens), *[_times(row, n) for n in range(1, depth + 2)]], []
        for d in range(1, depth + 1):
            # the followers seen twice or more that no other block sends
            at = np.flatnonzero(np.unpackbits(_loose(row["firsts"][d], "u1"), count=len(words)))
            at = at[_may_stay(counts[d][at - 1], counts[d - 1][at - 1], 1, 1, d == depth, tree)]
            total, above, times, over = counts[d][at - 1], counts[d - 1][at - 1], counts[d + 1][at], counts[d][at]
            keys, place = _distinct(_keys(words, at - 1, d))
            one = np.zeros(len(keys), np.int64)
            one[place] = np.arange(len(place))
            sums = [np.bincount(place, x, len(keys)) for x in (times, over, np.ones(len(at)), times * np.log(times / total / (over / above)))]
            zero = np.zeros(len(keys), np.uint64)
            ups = [_keys(words, at[one] - 1, k) if k < d else zero for k in range(1, depth)]
            found.append([keys, *ups, total[one], above[one], *sums])
        columns = [np.concatenate([f[i] for f in found]) for i in range(len(names))]
        yield from _packed(columns[0], tree.shards, {n: c.astype(t) for (n, t), c in zip(names.items(), columns)})

    def test(table: pa.Table) -> pa.Table:
        columns = {name: _joined(table, name, kind) for name, kind in names.items()}
        keys, place = _distinct(columns["key"])
        one = np.zeros(len(keys), np.int64)
        one[place] = np.arange(len(place))
        times, gain, over, twice = (np.bincount(place, columns[n], len(keys)) for n in ("times", "gain", "over", "twice"))
        total, share = columns["total"][one], over / columns["above"][one]
        once = total - times
        alone = once > 0
        rest = np.log(np.where(alone, once, 1) / total) - np.log(np.maximum(1 - share, 1e-12))
        gain += np.where(alone, once * rest, 0)
        return pa.table({
            "key": pa.array(keys.view(np.int64)), **{s: pa.array(columns[s][one].view(np.int64)) for s in suffixes},
            "spare": pa.array(once + DISCOUNT * twice), "own": pa.array(gain > price * (twice + 1))})

    fields = "shard long, " + ", ".join(f"{n} binary" for n in names)
    packed = _each(blocks, terms, fields)
    tested = stored(packed.groupBy("shard").applyInArrow(test, "key long, " + "".join(f"{s} long, " for s in suffixes) + "spare double, own boolean"), "contexts")
    # a retained context keeps its suffixes
    kept = tested.filter("own").select(F.explode(F.array("key", *suffixes)).alias("key")).distinct()
    states = stored(tested.select("key", "spare").join(kept, "key", "left_semi"), "retained")
    dropped(tested)
    return states


# ---------------------------------------------------------------- scoring

def suffix_tree_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", depth: int = DEPTH, p_min: float = 0.0,
                       folds: int = FOLDS) -> DataFrame:
    """One row per document: id, fold, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities), n_deep.

    Documents in fold 0 are scored only. ``n_deep`` counts the tokens that a context of the tree scored. ``p_min`` asks for
    more occurrences of a candidate, as a share of the training tokens.
    """
    if not 1 <= depth <= DEEPEST:
        raise ValueError(f"depth is 1 to {DEEPEST}")
    blocks = _blocks(docs, id_column, text_column, folds)
    tokens = _training_tokens(blocks)
    tree = Tree(tokens, max(p_min * tokens, LEAST), -(-tokens // SHARD_TOKENS) + 1)
    blocks, types = _counted(blocks, depth + 1, tree)
    states = _retained(blocks, depth, tree)

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        wanted = np.sort(np.concatenate([key for _, key, *_ in _levels(row, depth, tree)[1]]))
        wanted = wanted[np.append(True, wanted[1:] != wanted[:-1])[: len(wanted)]]
        yield from _packed(wanted, tree.shards, {"keys": wanted}, block=row["block"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            order = np.argsort(keys)
            yield from _packed(keys[order], tree.shards, {"keys": keys[order], "spare": batch.column("spare").to_numpy()[order]})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, spare = _joined(known, "keys", "<u8"), _joined(known, "spare", "<f8")
        order = np.argsort(keys)
        keys, spare = keys[order], np.append(spare[order], 0.0)
        found = [_squeezed(spare[_find(keys, _loose(x, "<u8"))]) for x in asked.column("keys")]
        return pa.table({
            "block": asked.column("block"), "part": asked.column("shard"), "length": pa.array(np.zeros(len(found), np.int64)), "values": pa.array(found, pa.binary())})

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = _row(block)
        bounds, folds_ = _loose(row["bounds"], "<i8"), _loose(row["folds"], "<i4")
        root, levels = _levels(row, depth, tree)
        keys, place = _distinct(np.concatenate([key for _, key, *_ in levels]))
        spares = np.split(_answered(answers, 0, "<f8", keys, tree.shards)[place], np.cumsum([len(at) for at, *_ in levels])[:-1])
        base = (root + ADDED) / (tokens + ADDED * (types + 1)) if tokens else np.ones(len(root))
        chance, deep = base.copy(), np.zeros(len(root), bool)
        for (at, _, total, follows), spare in zip(levels, spares):
            held = spare > 0  # a retained context has a follower seen twice, so mass is left
            at, total, follows, spare = at[held], total[held], follows[held], spare[held]
            chance[at] = (np.where(follows > 1, follows - DISCOUNT, 0.0) + spare * chance[at]) / total
            deep[at] = True
        sums = [np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)]) for x in (root > 0, np.log10(base), np.log10(chance), deep)]
        known_, base, chance, deep = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
        return pa.table({
            "id": block.column("ids")[0].values, "fold": pa.array(folds_), "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(known_.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(folds_), tokens)), "base_score": pa.array(base), "score": pa.array(chance), "n_deep": pa.array(deep.astype(np.int64))})

    requests = _each(blocks, ask, "shard long, block long, keys binary")
    known = states.mapInArrow(deal, "shard long, keys binary, spare binary")
    answers = stored(requests.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, _ANSWER), "spares")
    dropped(states)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    fields = f"id {kind}, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_deep long"
    # which block is the first to hold a sequence matters no more
    scored = blocks.withColumn("firsts", F.array().cast("array<binary>"))
    scores = stored(scored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, fields), "scores")
    dropped(blocks, answers)
    return scores.withColumnRenamed("id", id_column)
