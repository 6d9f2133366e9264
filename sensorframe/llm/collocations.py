"""Collocated phrases by dynamic itemset counting.

**Counting.** Texts become stored blocks of words, dealt into ``SHARDS`` shards. Shards are scanned one after the other, round
and round, and one scan counts phrases of every length that is under way. Words are under way from the start. A longer phrase is
activated by the first scan before which its two subphrases (all but the last word, all but the first) are known to have reached
``LEAST`` occurrences, and it is counted for exactly one cycle from there, so over every shard once, whichever comes first. Scanning
ends when nothing is under way.

**Activation table.** Which subphrases have reached the threshold, and before which scan, is told to the tasks by a table of one byte a
slot: a phrase has two slots, and both are filled by the scan after which it reaches the threshold, unless they are filled already. A filled
slot is never changed. So a phrase's activation follows from the table alone and is the same in every later scan; phrases that share
slots with others are activated early, never late, and are counted for a full cycle as well. Every count is therefore exact, whatever the table's size:
a fuller table only lets more rare phrases be counted. It has a slot for every ``SLOT_BYTES`` bytes of text, within fixed limits, so what
is broadcast is bounded.

**Identity.** A phrase is its language's code and the 64-bit keyed hashes of its words in order. Words are counted by a second hash as well, so two
words that share their first hash, or two languages that share a code, are seen, and all is counted anew with another key. Spellings are
read from the blocks only for phrases that are returned.

**Scores.** A cut of a phrase into two parts has the score floor(1000000 * a * a / (l * r)), taken over decimals of 38 digits; the lowest cut counts.
A phrase inside a longer candidate that makes up at least half of its occurrences is dropped.

Odd input: a null or empty text has no words; a null language is ``und``; repeated rows count as often as they come; a table without words gives
no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.session import dropped, stored
from sensorframe.llm.words import chunks, mixed, plain_strings, text_bytes

SHARDS = 2
LEAST = 10
MAX_WORDS = 3
#: A longer candidate with so many hundredths of a phrase's occurrences drops it.
SHARE = 50
UNKNOWN = "und"
#: Bytes of text for each slot of the activation table, and the limits of its size.
SLOT_BYTES, LEAST_SLOTS, MOST_SLOTS = 32, 1 << 16, 1 << 25
BLOCK_BYTES = 4 << 20
#: Counts sent on at a time.
SENT_ROWS = 1 << 16
#: Slots that one row of filled slots tells of.
SPAN = 1 << 16
EMPTY = 255
#: Added to a key for the second hash.
SECOND = 1_000_000_007
#: Bits of a phrase's kind that hold its length; its language's code is above them.
SIZE_BITS = 3
_BREAKS = b".,;:!?\n\v\f\r"
#: Breaks become line feeds, tabs become spaces, A-Z become a-z.
_TABLE = bytes.maketrans(_BREAKS + b"\t" + bytes(range(65, 91)), b"\n" * len(_BREAKS) + b" " + bytes(range(97, 123)))


def word_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Codes of all words, the positions of words that begin a piece, and the distinct words."""
    bounds, raw = text_bytes(plain_strings(texts))
    data = np.frombuffer(raw.translate(_TABLE), np.uint8)
    solid = (data != 32) & (data != 10)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    offsets = np.append(np.flatnonzero(first[solid]), np.count_nonzero(solid)).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[solid]))
    encoded = flat.dictionary_encode()
    begins = np.zeros(len(starts) + 1, bool)
    begins[np.searchsorted(starts, np.flatnonzero(data == 10))] = True
    begins[np.searchsorted(starts, bounds[:-1])] = True
    return np.asarray(encoded.indices).astype(np.int32), np.flatnonzero(begins[: len(starts)]), encoded.dictionary


def _hashes(words: pa.StringArray, lang: str, key: int) -> np.ndarray:
    named = pc.binary_join_element_wise(pa.scalar(lang), words, "\n")
    return mixed(pd.util.hash_array(named.to_numpy(zero_copy_only=False), hash_key=f"{key:016d}", categorize=False))


def _code(lang: str, key: int) -> int:
    """28 bits that stand for a language."""
    return int(pd.util.hash_array(np.array([lang], object), hash_key=f"{key:016d}", categorize=False)[0]) >> 36


def _blocks(docs: DataFrame, shards: int, key: int) -> DataFrame:
    """Stored blocks of one language: its words as codes into the hashes of its distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text", BLOCK_BYTES):
            langs = pc.fill_null(piece.column("lang"), UNKNOWN)
            for lang in pc.unique(langs).to_pylist():
                codes, begins, words = word_runs(piece.filter(pc.equal(langs, lang)).column("text"))
                if len(codes):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang]), pa.array([_code(lang, key)], pa.int32()), pa.array([len(codes)], pa.int64()), pa.array([codes.tobytes()], pa.binary()),
                        pa.array([begins.astype(np.int32).tobytes()], pa.binary()), pa.array([_hashes(words, lang, key).tobytes()], pa.binary()),
                        pa.array([_hashes(words, lang, key + SECOND).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                    ], ["lang", "code", "n", "codes", "begins", "hashes", "others", "words"])

    dealt = docs.mapInArrow(run, "lang string, code int, n long, codes binary, begins binary, hashes binary, others binary, words array<string>")
    shard = F.pmod(F.xxhash64("hashes", "n"), F.lit(shards)).cast("int")
    return stored(dealt.withColumn("shard", shard), "words", compression="zstd")


def _weights(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _slots(phrases: list[np.ndarray], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of phrases given by the hashes of their words in order."""
    total = np.full(len(phrases[0]), len(phrases), np.uint64)
    for hashes, weight in zip(phrases, _weights(len(phrases))):
        total = total + hashes * weight
    total = mixed(total)
    return (total % np.uint64(slots)).astype(np.int64), ((total >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def activation(table: np.ndarray, phrases: list[np.ndarray]) -> np.ndarray:
    """Before which scan the phrases were known to have reached the threshold; ``EMPTY`` if not yet."""
    one, two = _slots(phrases, len(table))
    return np.maximum(table[one], table[two])


def count_block(codes: np.ndarray, begins: np.ndarray, hashes: np.ndarray, table: np.ndarray, scan: int, shards: int, most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray | int]]:
    """(hashes of the words, occurrences, activation) of the block's phrases under way, a length at a time."""
    n = len(codes)
    if scan < shards:
        counts = np.bincount(codes, minlength=len(hashes))
        yield [hashes], counts, 0
    if scan == 0 or most < 2:
        return
    known = activation(table, [hashes])[codes]
    follows = np.ones(n, bool)
    follows[begins] = False
    # for phrases of ``size`` words by their first word: since when both subphrases are known, EMPTY where the phrase is none
    since = known
    joined = follows
    for size in range(2, most + 1):
        if n < size:
            return
        whole = joined[1 : n - size + 2] if size == 2 else joined[: n - size + 1] & follows[size - 1 : n]
        begun = np.where(whole, np.maximum(since[: n - size + 1], since[1 : n - size + 2]), EMPTY)
        places = np.flatnonzero((begun != EMPTY) & (begun + shards > scan))
        if len(places):
            keys = codes[places].astype(np.int64)
            for k in range(1, size):
                keys = keys * len(hashes) + codes[places + k] if len(hashes) ** size < 1 << 62 else np.unique(keys, return_inverse=True)[1] * len(hashes) + codes[places + k]
            _, firsts, counts = np.unique(keys, return_index=True, return_counts=True)
            at = places[firsts]
            yield [hashes[codes[at + k]] for k in range(size)], counts, begun[at]
        if size == most:
            return
        # since when phrases of this length are known to have reached the threshold; never before they were under way themselves
        reached = np.full(n - size + 1, EMPTY, np.uint8)
        where = np.flatnonzero(begun != EMPTY)
        reached[where] = np.maximum(activation(table, [hashes[codes[where + k]] for k in range(size)]), begun[where])
        since, joined = reached, whole


def _scan(blocks: DataFrame, scan: int, shards: int, most: int, shared: Broadcast) -> DataFrame:
    """(kind, k1, ..., begun, n) counts of the blocks of one shard; the second number of a single word is its other hash."""
    names = [f"k{i}" for i in range(1, most + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes, begins, hashes, others = (
                    np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in (("codes", np.int32), ("begins", np.int32), ("hashes", np.uint64), ("others", np.uint64)))
                code = batch.column("code")[row].as_py() << SIZE_BITS
                for keys, counts, begun in count_block(codes, begins, hashes, shared.value, scan, shards, most):
                    n, size = len(counts), len(keys)
                    columns = (keys + [others] if size == 1 else keys)[:most]
                    begun = np.broadcast_to(np.asarray(begun, np.int32), n)
                    for at in range(0, n, SENT_ROWS):
                        part = slice(at, min(at + SENT_ROWS, n))
                        m = part.stop - at
                        sent = [pa.array(k[part].view(np.int64)) for k in columns] + [pa.array(np.zeros(m, np.int64))] * (most - len(columns))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(m, code + size, np.int32)), *sent, pa.array(begun[part]), pa.array(counts[part].astype(np.int64)),
                        ], ["kind", *names, "begun", "n"])

    chosen = blocks.filter(F.col("shard") == scan % shards).select("code", "codes", "begins", "hashes", "others")
    return chosen.mapInArrow(run, "kind int, " + ", ".join(f"{k} long" for k in names) + ", begun int, n long")


def _spellings(blocks: DataFrame, shared: Broadcast) -> DataFrame:
    """(k1, word) of the words known to be frequent enough, once for each block that has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("hashes")[row].as_buffer(), np.uint64)
                frequent = np.flatnonzero(activation(shared.value, [hashes]) != EMPTY)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[frequent].view(np.int64)), batch.column("words")[row].values.take(pa.array(frequent))], ["k1", "word"])

    return blocks.select("hashes", "words").mapInArrow(run, "k1 long, word string")


def _filled(reached: DataFrame, names: list[str], slots: int) -> np.ndarray:
    """Which slots the phrases fill: one bit a slot is all that reaches the driver."""
    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("kind").to_numpy() & ((1 << SIZE_BITS) - 1)
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                both = np.unique(np.concatenate(_slots([part.column(k).to_numpy().view(np.uint64) for k in names[:size]], slots)))
                yield pa.RecordBatch.from_arrays([pa.array(both // SPAN), pa.array((both % SPAN // 64)), pa.array(both % 64)], ["span", "at", "bit"])

    bits = reached.mapInArrow(spots, "span long, at long, bit long").groupBy("span", "at").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))
    told = np.zeros(slots // 64, np.int64)
    # at most slots / 64 numbers
    found = bits.select((F.col("span") * (SPAN // 64) + F.col("at")).alias("at"), "bits").toArrow()
    told[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return np.unpackbits(told.view(np.uint8), bitorder="little").astype(bool)


def table_size(bytes_: int) -> int:
    """A power of two of slots, about one for every ``SLOT_BYTES`` bytes."""
    return min(max(1 << max(bytes_ // SLOT_BYTES, 1).bit_length(), LEAST_SLOTS), MOST_SLOTS)


class Counts(NamedTuple):
    phrases: DataFrame  # stored (size, code, k1, ..., n) of all words and of every phrase that reaches the threshold
    blocks: DataFrame
    table: np.ndarray
    scans: int


def phrase_counts(docs: DataFrame, least: int = LEAST, most: int = MAX_WORDS, shards: int = SHARDS) -> Counts:
    """Counts of the phrases of 1 to ``most`` words in ``docs`` (text, lang)."""
    if not 1 < most < 1 << SIZE_BITS:
        raise ValueError(f"phrases have 2 to {(1 << SIZE_BITS) - 1} words")
    key = 0
    while True:
        found = _counted(docs, least, most, shards, key)
        langs, codes = found.blocks.agg(F.count_distinct("lang"), F.count_distinct("code")).first()
        shared = found.phrases.filter("size = 1").groupBy("code", "k1").count().filter("count > 1")
        if langs == codes and shared.isEmpty():
            return found
        dropped(found.phrases, found.blocks)
        key += 1


def _counted(docs: DataFrame, least: int, most: int, shards: int, key: int) -> Counts:
    blocks = _blocks(docs, shards, key)
    names = [f"k{i}" for i in range(1, most + 1)]
    table = np.full(table_size(4 * (blocks.agg(F.sum("n")).first()[0] or 0)), EMPTY, np.uint8)
    size = F.col("kind").bitwiseAND((1 << SIZE_BITS) - 1)
    complete: list[DataFrame] = []
    before: DataFrame | None = None
    scan, last = 0, -shards
    # words are under way for the first cycle, and what the table activates for one cycle after
    while scan < shards or scan < last + shards:
        shared = docs.sparkSession.sparkContext.broadcast(table)
        counted = _scan(blocks, scan, shards, most, shared).withColumn("known", F.lit(False))
        if before is not None:
            counted = counted.unionByName(before.filter("not ended").select(counted.columns))
        counted = counted.groupBy("kind", *names).agg(F.min("begun").alias("begun"), F.sum("n").alias("n"), F.max("known").alias("was"))
        now = counted.withColumns({"known": F.col("n") >= least, "ended": F.col("begun") + shards <= scan + 1})
        # a phrase whose cycle is over without the threshold is done with; words all stay
        after = stored(now.filter(F.col("known") | ~F.col("ended") | (size == 1)), "counts", compression="zstd")
        shared.unpersist()
        complete.append(stored(after.filter("ended").select("kind", *names, "n"), "complete"))
        if before is not None:
            dropped(before)
        before = after
        scan += 1
        fresh = _filled(after.filter(F.col("known") & ~F.col("was") & (size < most)), names, len(table)) & (table == EMPTY)
        if fresh.any():
            last = scan
            table[fresh] = scan
    dropped(before)
    counts = complete[0]
    for other in complete[1:]:
        counts = counts.unionByName(other)
    found = stored(counts.select(size.alias("size"), F.shiftright("kind", SIZE_BITS).alias("code"), *names, "n"), "phrases")
    dropped(*complete)
    return Counts(found, blocks, table, scan)


def _score(a: str, left: str, right: str) -> str:
    whole = lambda x, digits: f"cast({x} as decimal({digits},0))"
    return f"(cast(1000000 as decimal(7,0)) * ({whole(a, 15)} * {whole(a, 15)})) div ({whole(left, 19)} * {whole(right, 19)})"


def _first(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each language: of each slice of it first, since a language can be a third of all."""
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64(*rows.columns), F.lit(slices)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    return dealt.drop("slice").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, most: int = MAX_WORDS, shards: int = SHARDS, share: int = SHARE,
                 text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to ``most`` words.

    a, l and r are the occurrences of the phrase and of the two parts of its lowest cut, n all words of the language.
    """
    found = phrase_counts(docs.select(docs[text_column].alias("text"), docs[lang_column].alias("lang")), least, most, shards)
    counts, blocks = found.phrases, found.blocks
    names = [f"k{i}" for i in range(1, most + 1)]
    candidates = counts.filter(f"size > 1 and n >= {least}").withColumnRenamed("n", "a")
    # every part of a candidate, told apart by where it begins and how long it is
    parts = F.expr("flatten(transform(sequence(1, size - 1), k -> array(struct(k as cut, 0 as side, slice(ks, 1, k) as part), struct(k as cut, 1 as side, slice(ks, k + 1, size - k) as part))))")
    cut = candidates.withColumn("ks", F.array(*names)).select("code", *names, "size", "a", F.explode(parts).alias("p")).select(
        "code", *names, F.col("size").alias("whole"), "a", F.col("p.cut").alias("cut"), F.col("p.side").alias("side"), F.size("p.part").alias("size"),
        *[F.coalesce(F.get("p.part", F.lit(i)), F.lit(0)).alias(f"p{i + 1}") for i in range(most)])
    of_word = lambda i, k: F.when(F.col("size") > i, F.col(k)).otherwise(0).alias(f"p{i + 1}")
    keys = counts.filter(f"n >= {least}").select("code", "size", *[of_word(i, k) for i, k in enumerate(names)], "n")
    sides = cut.join(keys, ["code", "size", *[f"p{i + 1}" for i in range(most)]])
    both = sides.groupBy("code", *names, "whole", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    lowest = both.withColumn("score", F.expr(_score("a", "l", "r")).cast("long")).groupBy("code", *names, "whole", "a").agg(
        F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("low")).select("code", *names, "whole", "a", "low.l", "low.r", "low.score")
    inner = F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> slice(ks, i, k))))")
    covers = candidates.filter("size > 2").withColumn("ks", F.array(*names)).select("code", "a", F.explode(inner).alias("part")).groupBy(
        "code", F.size("part").alias("whole"), *[F.coalesce(F.get("part", F.lit(i)), F.lit(0)).alias(k) for i, k in enumerate(names)]).agg(F.max("a").alias("longer"))
    kept = lowest.join(covers, ["code", "whole", *names], "left").filter(f"longer is null or 100 * longer < {share} * a")
    langs = blocks.groupBy("code", "lang").agg(F.sum("n").alias("n"))
    spoken = stored(kept.join(langs.drop("n"), "code"), "kept")
    # spellings are looked up only for what can be among the first: scores as good as the last of them
    bars = _first(spoken, [F.desc("score"), F.desc("a")], top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("bar"))
    chosen = spoken.join(bars, "lang").filter(F.struct("score", "a") >= F.col("bar")).withColumn("row", F.struct(*names))
    each = chosen.select("lang", "row", "whole", "a", "l", "r", "score", F.posexplode(F.array(*names)).alias("at", "word_key")).filter("at < whole")
    table = docs.sparkSession.sparkContext.broadcast(found.table)
    needed = each.select(F.col("word_key").alias("k1")).distinct()
    words = _spellings(blocks, table).join(needed, "k1", "left_semi").distinct()
    spelt = each.join(words.withColumnRenamed("k1", "word_key"), "word_key").groupBy("lang", "row", "whole", "a", "l", "r", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = _first(spelt, [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    best = stored(ranked.join(langs.drop("code"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    table.unpersist()
    dropped(counts, blocks, spoken)
    return best
