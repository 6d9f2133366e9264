"""Sums from which the statistics of any union of folds follow.

Every task adds up, for each fold it meets, what is additive: rows, known values, sums and products of the values less a shift. The shift is
the mean of the first values the task meets, so nothing cancels; partial sums of different shifts are moved to one before they are
added. A fold's training statistics are then those of all other folds together.

With k for "is known", v for the value and c for the shift, the sums are: K of k, S of k(v - c), A of the products of the k(v - c), B of k times
k(v - c), C of the products of the k. Missing values are filled with the mean m, so what the projection sees is k(v - m), whose products are
A - d B - (d B)' + d d' C with d = m - c.

Projected blocks up to ``WIDEST`` values have their products here; the products of a wider block are left to its own fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.clips import DataError
from sensorframe.schema import PCA_COMPONENTS

#: A block this wide has 8 MB of products for each fold; they are all that reaches the driver.
WIDEST = 1024
_PARTS = "fold int, block string, rows long, sums binary"


@dataclass
class Sums:
    """Additive statistics of some rows of one block; products only where they are asked for."""

    rows: int
    shift: np.ndarray
    known: np.ndarray
    first: np.ndarray
    second: np.ndarray
    products: np.ndarray | None = None
    #: Known times value products, and known products; None while every value is known.
    mixed: np.ndarray | None = None
    pairs: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, shift: np.ndarray, full: bool) -> "Sums":
        there = np.isfinite(values)
        moved = np.where(there, values - shift, 0.0)
        found = cls(len(values), shift, there.sum(axis=0).astype(np.float64), moved.sum(axis=0), (moved**2).sum(axis=0))
        if full:
            found.products = moved.T @ moved
            if not there.all():
                k = there.astype(np.float64)
                found.mixed, found.pairs = k.T @ moved, k.T @ k
        return found

    def _whole(self) -> "Sums":
        """With the products of known values spelt out."""
        if self.products is None or self.mixed is not None:
            return self
        width = len(self.shift)
        return Sums(self.rows, self.shift, self.known, self.first, self.second, self.products, np.tile(self.first, (width, 1)), np.full((width, width), float(self.rows)))

    def moved(self, shift: np.ndarray) -> "Sums":
        """The same rows with another shift."""
        d = shift - self.shift
        if not d.any():
            return self
        first = self.first - d * self.known
        second = self.second - 2 * d * self.first + d**2 * self.known
        if self.products is None:
            return Sums(self.rows, shift, self.known, first, second)
        w = self._whole()
        products = w.products - d[:, None] * w.mixed - (d[:, None] * w.mixed).T + np.outer(d, d) * w.pairs
        known = self.mixed is None
        return Sums(self.rows, shift, self.known, first, second, products, None if known else w.mixed - d[None, :] * w.pairs, None if known else w.pairs)

    def _widened(self, other: "Sums") -> "Sums":
        """Rows of missing arrays, once the width is known from others."""
        width, full = len(other.shift), other.products is not None
        none, square = np.zeros(width), np.zeros((width, width))
        return Sums(self.rows, other.shift, none, none, none, *([square] * 3 if full else []))

    def __add__(self, other: "Sums") -> "Sums":
        if len(self.shift) != len(other.shift):
            if len(self.shift) and len(other.shift):
                raise DataError(f"arrays of {len(self.shift)} and {len(other.shift)} numbers in one block")
            return self + other._widened(self) if len(self.shift) else self._widened(other) + other
        other = other.moved(self.shift)
        one, two = self, other
        if self.products is not None and (self.mixed is None) != (other.mixed is None):
            one, two = self._whole(), other._whole()
        plus = lambda a, b: None if a is None else a + b
        return Sums(self.rows + other.rows, self.shift, self.known + other.known, self.first + other.first, self.second + other.second,
                    plus(one.products, two.products), plus(one.mixed, two.mixed), plus(one.pairs, two.pairs))

    def packed(self) -> bytes:
        width = len(self.shift)
        parts = [np.array([width, self.products is not None, self.mixed is not None], np.float64), self.shift, self.known, self.first, self.second]
        parts += [p.ravel() for p in (self.products, self.mixed, self.pairs) if p is not None]
        return np.concatenate(parts).tobytes()

    @classmethod
    def unpacked(cls, rows: int, raw: bytes) -> "Sums":
        numbers = np.frombuffer(raw)
        width, full, gaps = (int(v) for v in numbers[:3])
        shift, known, first, second = numbers[3 : 3 + 4 * width].reshape(4, width)
        squares = numbers[3 + 4 * width :].reshape(-1, width, width) if full else []
        return cls(rows, shift, known, first, second, *squares[: 3 if gaps else 1])

    # ------------------------------------------------ what follows from them

    def mean_and_scale(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean of the known values, deviation of the filled ones, and the deviation or 1 where there is none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(self.known > 0, self.shift + self.first / self.known, 0.0)
            spread = np.where(self.known > 0, self.second - self.first**2 / self.known, 0.0)
        deviation = np.sqrt(np.maximum(spread, 0.0) / self.rows)
        flat = deviation <= 1e-12 * np.maximum(1.0, np.abs(mean))
        return mean, deviation, np.where(flat, 1.0, deviation)

    def deviations(self) -> np.ndarray:
        """Of the filled and scaled values, whose means are 0."""
        _, deviation, scale = self.mean_and_scale()
        return deviation / scale

    def covariance(self) -> np.ndarray:
        """Of the filled and scaled values, over all rows."""
        mean, _, scale = self.mean_and_scale()
        return self.moved(np.where(self.known > 0, mean, self.shift)).products / self.rows / np.outer(scale, scale)


def _filled_rows(lists: pa.Array) -> np.ndarray:
    """Rows of numbers, NaN where a number or a whole row is missing; no columns where all rows are."""
    there = np.flatnonzero(np.asarray(lists.is_valid()))
    if not len(there):
        return np.zeros((len(lists), 0))
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    width, rest = divmod(len(flat), len(there))
    if rest or (np.diff(lists.offsets.to_numpy())[there] != width).any():
        raise DataError("arrays of different sizes in one block")
    out = np.full((len(lists), width), np.nan)
    out[there] = flat.reshape(len(there), width)
    out[~np.isfinite(out)] = np.nan
    return out


def summed(rows: DataFrame, blocks: Sequence[str], fold: Column, widest: int = 0) -> DataFrame:
    """(fold, block, rows, sums) of every block in every fold, by one pass over the rows; products of projected blocks up to ``widest`` values.

    Tasks send one partial result a fold and block; they are added up by key in a stream, two at a time.
    """
    names = list(blocks)

    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], Sums] = {}
        shifts: dict[str, np.ndarray] = {}
        for batch in batches:
            numbers = batch.column("fold").to_numpy()
            for block in names:
                values = _filled_rows(batch.column(block))
                shift = shifts.get(block)
                if values.shape[1] and shift is None:
                    known = np.isfinite(values)
                    shift = shifts[block] = np.where(known, values, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
                full = block in PCA_COMPONENTS and 0 < values.shape[1] <= widest
                for number in np.unique(numbers).tolist():
                    new = Sums.of(values[numbers == number], shift if values.shape[1] else np.zeros(0), full)
                    key = number, block
                    held[key] = held[key] + new if key in held else new
        yield from (_row(key, sums) for key, sums in held.items())

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.column("fold")[at].as_py(), batch.column("block")[at].as_py()
                sums = Sums.unpacked(batch.column("rows")[at].as_py(), batch.column("sums")[at].as_py())
                if one != key and held is not None:
                    yield _row(key, held)
                    held = None
                key, held = one, sums if held is None else held + sums
        if held is not None:
            yield _row(key, held)

    parts = rows.select(fold.cast("int").alias("fold"), *names).mapInArrow(one_task, _PARTS)
    return parts.repartition("fold", "block").sortWithinPartitions("fold", "block").mapInArrow(added, _PARTS)


def fold_sums(rows: DataFrame, blocks: Sequence[str], fold: str = "fold", widest: int = WIDEST) -> dict[str, dict[int, Sums]]:
    """Sums of every block in every fold."""
    found: dict[str, dict[int, Sums]] = {b: {} for b in blocks}
    for r in summed(rows, blocks, F.col(fold), widest).collect():
        found[r["block"]][r["fold"]] = Sums.unpacked(r["rows"], bytes(r["sums"]))
    empty = [b for b, by_fold in found.items() if not any(len(s.shift) for s in by_fold.values())]
    if empty:
        raise DataError(f"no values to fit blocks {empty}")
    return found


def _row(key: tuple[int, str], sums: Sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([sums.rows]), pa.array([sums.packed()], pa.binary())],
                                      ["fold", "block", "rows", "sums"])


def without(sums: dict[int, Sums], fold: int) -> Sums:
    """The statistics of all folds but one."""
    others = [s for f, s in sorted(sums.items()) if f != fold]
    if not others:
        raise DataError("no training rows beside the fold")
    total = others[0]
    for one in others[1:]:
        total = total + one
    return total
