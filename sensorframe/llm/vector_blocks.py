"""Whole-number vectors in packed blocks, and asked vectors walked past blocks of all vectors.

Vectors become stored blocks of bounded size. Asked vectors are dealt into groups that fit a task, blocks into parts;
a task gets one group and then one part's blocks, one after the other. Nothing is collected or broadcast, no task
holds more than a group and a block, and the blocks a group cannot use are left out before they are shuffled.

A vector takes part if it, its id and all its components are there and finite. Components become floor(scale * x).
Shorter vectors are filled up with zeros. Products are exact at any size: as doubles where every sum stays below
2^53, as Python numbers otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.session import stored

#: Vectors and bytes of one block at most, unless a single vector is larger.
BLOCK_ROWS, BLOCK_BYTES = 2048, 4 << 20
#: Asked vectors of a group at most, and bytes they take in a task.
GROUP_ROWS, GROUP_BYTES = 32_768, 64 << 20
#: Blocks of a part on clusters too small to want more parts.
PART_BLOCKS = 512
#: Scores worked on at a time.
CELLS = 1 << 22
#: Whole sums of doubles are exact below this.
EXACT = float(1 << 53)
#: Scores beyond this either way count as this.
MOST = (1 << 63) - 1
#: Rounding of lengths and angles; bounds are widened by it.
SLACK = 1e-9

_VECTORS = "id long, label long, asked boolean, norm double, width int, dims int, vector binary"
_BLOCKS = "block long, top double, size int, width int, dims int, keys binary, ids binary, labels binary, norms binary, asked binary, vectors binary"
_ASKED = "key long, size int, width int, dims int, keys binary, ids binary, labels binary, norms binary, vectors binary, level double, extra binary"
#: The class of levels that rule nothing out.
_LEAST = -100_000
_KINDS = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<f8")}


class Block(NamedTuple):
    keys: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    norms: np.ndarray
    values: np.ndarray  # one row a vector, doubles
    asked: np.ndarray | None = None
    extra: list[bytes] | None = None


def _binary(column: pa.Array) -> list[bytes]:
    return column.to_pylist()


def vectors(df: DataFrame, scale: int, asked: Column, id_column: str = "vec_id", vector_column: str = "embedding", label: Column | None = None) -> DataFrame:
    """One row per vector that takes part; without a label column the label is 0, with one its null rows take no part."""
    chosen = df.select(
        df[id_column].cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"),
        F.coalesce(asked, F.lit(False)).alias("asked"), df[vector_column].cast("array<double>").alias("vector"),
    ).filter("id is not null and label is not null and vector is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            flat = np.floor(lists.values.to_numpy(zero_copy_only=False) * scale)[bounds[0] : bounds[-1]] + 0.0
            bounds = bounds - bounds[0]
            bad = np.append(0, np.cumsum(~np.isfinite(flat)))
            whole = bad[bounds[1:]] == bad[bounds[:-1]]
            flat[~np.isfinite(flat)] = 0
            norms = np.sqrt(np.add.reduceat(np.append(flat, 0.0) ** 2, np.minimum(bounds[:-1], len(flat))) * (np.diff(bounds) > 0)) if len(whole) else np.zeros(0)
            most = np.abs(flat).max(initial=0)
            width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            raw = flat.astype(_KINDS[width]).tobytes()
            packed = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds * width), pa.py_buffer(raw)]).cast(pa.binary())
            n = len(lists)
            out = pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("label"), batch.column("asked"), pa.array(norms), pa.array(np.full(n, width, np.int32)),
                pa.array(np.diff(bounds).astype(np.int32)), packed], ["id", "label", "asked", "norm", "width", "dims", "vector"])
            yield out.filter(pa.array(whole))

    return chosen.mapInArrow(run, _VECTORS)


def _matrix(raw: list[bytes], widths: list[int], dims: list[int], sizes: list[int]) -> np.ndarray:
    """Rows of packed pieces as doubles, filled up with zeros to one length."""
    total, most = sum(sizes), max(dims, default=0)
    if len(set(widths)) == 1 and len(set(dims)) == 1:
        return np.frombuffer(b"".join(raw), _KINDS[widths[0]]).reshape(total, most).astype(np.float64)
    values, at = np.zeros((total, most)), 0
    for piece, width, dim, size in zip(raw, widths, dims, sizes):
        values[at : at + size, :dim] = np.frombuffer(piece, _KINDS[width]).reshape(size, dim)
        at += size
    return values


def _squeezed(values: np.ndarray) -> tuple[int, bytes]:
    most = np.abs(values).max(initial=0)
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, values.astype(_KINDS[width]).tobytes()


def packed(rows: DataFrame, name: str = "vectors") -> DataFrame:
    """Stored blocks of consecutive rows of each partition, numbered in that order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count, seen = TaskContext.get().partitionId() << 33, 0, 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal count, seen
            n = rows.num_rows
            sizes = [1] * n
            values = _matrix(_binary(rows.column("vector")), rows.column("width").to_pylist(), rows.column("dims").to_pylist(), sizes)
            width, raw = _squeezed(values)
            norms = rows.column("norm").to_numpy()
            keys = base + seen + np.arange(n, dtype=np.int64)
            asked = np.asarray(rows.column("asked").to_numpy(zero_copy_only=False), bool)
            count, seen = count + 1, seen + n
            one = [[base + count - 1], [float(norms.max())], [n], [width], [values.shape[1]], [keys.tobytes()], [rows.column("id").to_numpy().tobytes()],
                   [rows.column("label").to_numpy().tobytes()], [norms.tobytes()], [asked.tobytes()], [raw]]
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, kinds)],
                                              ["block", "top", "size", "width", "dims", "keys", "ids", "labels", "norms", "asked", "vectors"])

        held: list[pa.RecordBatch] = []
        rows = bytes_ = 0
        for batch in batches:
            at = 0
            sizes = np.cumsum(batch.column("dims").to_numpy().astype(np.int64) * 8 + 64)
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                room = int(np.searchsorted(sizes, before + BLOCK_BYTES - bytes_, side="right")) - at
                take = min(batch.num_rows - at, BLOCK_ROWS - rows, max(room, 0 if rows else 1))
                if take:
                    held.append(batch.slice(at, take))
                    at, rows, bytes_ = at + take, rows + take, bytes_ + int(sizes[at + take - 1]) - before
                if at < batch.num_rows:
                    yield block(pa.Table.from_batches(held))
                    held, rows, bytes_ = [], 0, 0
        if held:
            yield block(pa.Table.from_batches(held))

    return stored(rows.mapInArrow(run, _BLOCKS), name)


def blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    """The packed blocks of a batch, unpacked one at a time."""
    for row in range(batch.num_rows):
        piece = batch.slice(row, 1)
        get = {name: piece.column(name)[0].as_py() for name in batch.schema.names}
        extra = get.get("extra")
        flags = get.get("asked")
        yield Block(np.frombuffer(get["keys"], np.int64), np.frombuffer(get["ids"], np.int64), np.frombuffer(get["labels"], np.int64),
                    np.frombuffer(get["norms"], np.float64), _matrix([get["vectors"]], [get["width"]], [get["dims"]], [get["size"]]),
                    None if flags is None else np.frombuffer(flags, bool), None if extra is None else [extra])


def asked_vectors(blocks: DataFrame, describe: Callable[[Block], tuple[np.ndarray, list[bytes]]]) -> DataFrame:
    """One row per asked vector, with a level below which no block is of use to it and what else its task needs.

    ``describe`` gets the asked vectors of a block and gives their levels and extras.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch):
                at = np.flatnonzero(block.asked)
                if not len(at):
                    continue
                asked = Block(block.keys[at], block.ids[at], block.labels[at], block.norms[at], block.values[at])
                levels, extras = describe(asked)
                width, raw = _squeezed(asked.values)
                n, step = len(at), asked.values.shape[1] * width
                each = lambda x: [x[i : i + 1].tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(asked.keys), pa.array(np.ones(n, np.int32)), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, asked.values.shape[1], np.int32)),
                    pa.array(each(asked.keys), pa.binary()), pa.array(each(asked.ids), pa.binary()), pa.array(each(asked.labels), pa.binary()),
                    pa.array(each(asked.norms), pa.binary()), pa.array([raw[i * step : (i + 1) * step] for i in range(n)], pa.binary()), pa.array(levels),
                    pa.array(extras, pa.binary()),
                ], ["key", "size", "width", "dims", "keys", "ids", "labels", "norms", "vectors", "level", "extra"])

    return blocks.mapInArrow(run, _ASKED)


def _classes(asked: DataFrame, rows: int) -> tuple[list[tuple[int, int, int]], list[float]]:
    """(class of levels, its first group, its groups), and each group's least level.

    There are at most some 17,000 classes, an eighth of a power of two each, whatever the input. Neighbouring small classes share a group.
    """
    counts = sorted((r["class"], r["count"]) for r in asked.groupBy("class").count().collect())
    placed: list[tuple[int, int, int]] = []
    levels: list[float] = []
    room = 0
    for number, count in counts:
        least = float("-inf") if number == _LEAST else 2.0 ** (number / 8) * (1 - SLACK)
        if count > room:
            slices = -(-count // rows)
            placed.append((number, len(levels), slices))
            levels += [least] * slices
            room = rows - count if slices == 1 else 0
        else:
            placed.append((number, len(levels) - 1, 1))
            room -= count
    return placed, levels


def walked(asked: DataFrame, blocks: DataFrame, walk: Callable[[Block], "Walk"], schema: str) -> DataFrame:
    """What ``walk`` of each group of asked vectors says after it has met every block that can be of use, in parts of the blocks.

    A group's results come once for each part and have to be combined. Levels are read once for each class, so the
    only thing that reaches the driver is a number for each group of asked vectors.
    """
    spark = blocks.sparkSession
    facts = blocks.agg(F.count(F.lit(1)), F.max("dims")).first()
    n_blocks, dims = facts[0], facts[1] or 0
    level = F.coalesce(F.col("level"), F.lit(0.0))
    asked = asked.withColumn("class", F.when(level > 0, F.floor(F.log2(level) * 8)).otherwise(_LEAST).cast("int"))
    placed, levels = _classes(asked, max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * max(dims, 1)))))
    parts = max(1, -(-n_blocks // PART_BLOCKS), min(n_blocks, 2 * spark.sparkContext.defaultParallelism))
    # one row for each class, so at most 17,000
    groups = F.broadcast(spark.createDataFrame(placed, "class int, first int, slices int"))
    shared = ["size", "width", "dims", "keys", "ids", "labels", "norms", "vectors"]
    left = asked.join(groups, "class").select(
        (F.col("first") + F.pmod(F.xxhash64("key"), F.col("slices"))).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.lit(0).alias("kind"), F.lit(0.0).alias("order"), *shared, "extra")
    of_use = F.size(F.filter(F.lit(levels).cast("array<double>"), lambda x: x <= F.col("top") * (1 + SLACK)))
    right = blocks.withColumn("of_use", of_use).filter("of_use > 0").select(
        F.explode(F.sequence(F.lit(0), F.col("of_use") - 1)).alias("group"), F.pmod(F.shiftright("block", 33) + F.col("block"), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("kind"), (-F.col("top")).alias("order"), *shared, F.lit(None).cast("binary").alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, walker = None, [], None
        for batch in batches:
            where = list(zip(batch.column("group").to_pylist(), batch.column("part").to_pylist(), batch.column("kind").to_pylist()))
            for (group, part, kind), block in zip(where, blocks_of(batch)):
                if (group, part) != now:
                    if walker is not None:
                        yield from walker.results()
                    now, held, walker = (group, part), [], None
                if kind == 0:
                    held.append(block)
                elif held:
                    walker = walk(_joined(held)) if walker is None else walker
                    walker.meet(block)
        if walker is not None:
            yield from walker.results()

    tasks = min(max(len(levels) * parts, 1), 20 * max(spark.sparkContext.defaultParallelism, 1) + n_blocks // PART_BLOCKS)
    dealt = left.unionByName(right).repartitionById(tasks, F.pmod(F.col("group") * parts + F.col("part"), F.lit(tasks)).cast("int"))
    dealt = dealt.sortWithinPartitions("group", "part", "kind", "order")
    return dealt.mapInArrow(run, schema)


class Walk:
    """A group of asked vectors on its way past blocks."""

    def meet(self, block: Block) -> None:
        raise NotImplementedError

    def results(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def _joined(blocks: list[Block]) -> Block:
    most = max(b.values.shape[1] for b in blocks)
    values = np.zeros((sum(len(b.keys) for b in blocks), most))
    at = 0
    for b in blocks:
        values[at : at + len(b.keys), : b.values.shape[1]] = b.values
        at += len(b.keys)
    return Block(*[np.concatenate([getattr(b, name) for b in blocks]) for name in ("keys", "ids", "labels", "norms")], values,
                 extra=[e for b in blocks for e in b.extra or [b""]])


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both, up to 2^63 - 1 either way; the longer vectors' further components meet zeros."""
    dims = min(left.shape[1], right.shape[1])
    left, right = left[:, :dims], right[:, :dims]
    if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(dims, 1) < EXACT:
        return left @ right.T
    whole = np.frompyfunc(int, 1, 1)
    within = np.frompyfunc(lambda s: min(max(int(s), -MOST), MOST), 1, 1)
    return within(np.dot(whole(left), whole(right).T).reshape(len(left), len(right)))


class Best:
    """The k best (score, id) of each of n owners; equal scores go by the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.owner, self.keys, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(4))
        #: Each owner's k-th score, or less.
        self.least = np.full(n, -np.inf)

    def add(self, owner: np.ndarray, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(owner):
            return
        owner, keys = np.concatenate([self.owner, owner]), np.concatenate([self.keys, keys])
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores.astype(np.int64)])
        order = np.lexsort((keys, ids, -scores, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order, owner, place = order[place < self.k], owner[place < self.k], place[place < self.k]
        self.owner, self.keys, self.ids, self.scores = owner, keys[order], ids[order], scores[order]
        last = place == self.k - 1
        kth = self.scores[last]
        # beyond the exact range of doubles nothing is pruned
        self.least[owner[last]] = np.where(np.abs(kth) < EXACT, kth, -np.inf)
