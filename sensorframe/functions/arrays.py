"""Vectorized work on short, fixed-length sample arrays (a few dozen values per row)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())


def _by_length(column: pd.Series):
    """Row numbers and stacked matrix for every array length that occurs."""
    lengths = column.map(lambda v: -1 if v is None else len(v))
    for length in sorted(set(lengths)):
        rows = np.flatnonzero(lengths.to_numpy() == length)
        if length > 0:
            yield rows, np.stack([np.asarray(column.iloc[r], dtype=np.float64) for r in rows])


def _centered_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = a - a.mean(axis=1, keepdims=True)
    b = b - b.mean(axis=1, keepdims=True)
    scale = np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1))
    flat = scale <= 1e-12
    return np.where(flat, 0.0, (a * b).sum(axis=1) / np.where(flat, 1.0, scale))


def dynamics(signals: np.ndarray) -> np.ndarray:
    """Nine motion and spectrum figures for each row of equally spaced samples."""
    rows, length = signals.shape
    centered = signals - signals.mean(axis=1, keepdims=True)
    spread = centered.std(axis=1)
    moving = spread > 1e-12
    unit = centered / np.where(moving, spread, 1.0)[:, None]
    out = np.zeros((rows, 9))
    for place, order in ((0, 1), (1, 2)):
        change = np.diff(signals, n=order, axis=1)
        if change.shape[1]:
            out[:, place] = np.sqrt((change**2).mean(axis=1))
    if length > 1:
        # a value that equals the mean is not below it, whichever way the mean was rounded
        negative = centered < -1e-12 * np.abs(signals).max(axis=1, keepdims=True)
        out[:, 2] = (negative[:, :-1] != negative[:, 1:]).mean(axis=1)
        out[:, 5] = np.where(moving, _centered_correlation(centered[:, :-1], centered[:, 1:]), 0.0)
    out[:, 3] = np.where(moving, (unit**3).mean(axis=1), 0.0)
    out[:, 4] = np.where(moving, (unit**4).mean(axis=1) - 3.0, 0.0)
    power = (np.abs(np.fft.rfft(centered, axis=1)) ** 2)[:, 1:]
    bins = power.shape[1]
    total = power.sum(axis=1)
    audible = total > 1e-12
    if bins:
        share = power / np.where(audible, total, 1.0)[:, None]
        entropy = -(share * np.log(share + 1e-12)).sum(axis=1) / math.log(max(2, bins))
        out[:, 6] = np.where(audible, (power.argmax(axis=1) + 1) / bins, 0.0)
        out[:, 7] = np.where(audible, entropy, 0.0)
        out[:, 8] = np.where(audible, share[:, bins // 2 :].sum(axis=1), 0.0)
    return out


@F.pandas_udf(DOUBLES)
def dynamic_figures(samples: pd.Series) -> pd.Series:
    out: list[np.ndarray | None] = [None] * len(samples)
    for rows, matrix in _by_length(samples):
        for row, figures in zip(rows.tolist(), dynamics(matrix)):
            out[row] = figures
    return pd.Series(out, dtype=object)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def pair_figures(left: Column, right: Column) -> Column:
    """Correlation, root mean square and mean absolute difference of two sample arrays of one length; NULL where one is missing."""
    n = F.size(left)
    doubles = lambda c: F.transform(c, lambda v: v.cast("double"))
    centred = lambda c: _let(_total(c) / n, lambda mean: F.transform(c, lambda v: v - mean))
    pairs = F.arrays_zip(centred(doubles(left)).alias("a"), centred(doubles(right)).alias("b"))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("ab", "aa", "bb")])
    sums = F.aggregate(pairs, start, lambda s, p: F.struct(
        (s["ab"] + p["a"] * p["b"]).alias("ab"), (s["aa"] + p["a"] * p["a"]).alias("aa"), (s["bb"] + p["b"] * p["b"]).alias("bb")))
    correlation = _let(sums, lambda s: _let(F.sqrt(s["aa"] * s["bb"]), lambda scale: F.when(scale > 1e-12, s["ab"] / scale).otherwise(0.0)))
    gaps = F.zip_with(doubles(left), doubles(right), lambda a, b: a - b)
    errors = _let(gaps, lambda g: F.array(F.sqrt(_total(F.transform(g, lambda v: v * v)) / n), _total(F.transform(g, F.abs)) / n))
    return F.when(left.isNotNull() & right.isNotNull() & (n > 0), F.concat(F.array(correlation), errors))
