"""Whole-batch word splitting for Arrow text columns.

A batch is handled as one byte buffer: separators become spaces by a translation table, word starts
are found by comparing neighbouring bytes, and the words come back as codes into a dictionary of the
distinct words. Nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 8 << 20
_SPACES = b"\t\n\v\f\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: Words are runs of bytes other than space and \x09-\x0D.
PLAIN = bytes.maketrans(_SPACES, b" " * 5)
#: The same after lower-casing A-Z.
FOLDED = bytes.maketrans(_SPACES + _UPPER, b" " * 5 + _LOWER)
#: Lower-cased words of digits, a-z and whatever is not ASCII.
LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


class Words(NamedTuple):
    codes: np.ndarray  # one per word, into vocabulary
    vocabulary: pa.StringArray
    bounds: np.ndarray  # document i has the words bounds[i] to bounds[i + 1]


def plain_strings(texts: pa.Array) -> pa.Array:
    """Text without nulls, in an array that starts at its own buffers' beginning."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    return pc.fill_null(texts, "")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets from 0 and the bytes of a text array without nulls."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = bytes(memoryview(data)[bounds[0] : bounds[-1]]) if data is not None else b""
    return bounds - bounds[0], raw


def split_words(texts: pa.Array, table: bytes) -> Words:
    bounds, raw = text_bytes(plain_strings(texts))
    data = np.frombuffer(raw.translate(table), np.uint8)
    solid = data != 32
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    first[inner] = solid[inner]
    offsets = np.append(np.flatnonzero(first[solid]), np.count_nonzero(solid)).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[solid]))
    encoded = flat.dictionary_encode()
    return Words(
        np.asarray(encoded.indices), encoded.dictionary, np.searchsorted(np.flatnonzero(first), bounds).astype(np.int64)
    )


def word_hashes(vocabulary: pa.StringArray) -> np.ndarray:
    """A 64-bit keyed hash of each word, the same in every task."""
    return pd.util.hash_array(vocabulary.to_numpy(zero_copy_only=False), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (an invertible finalizer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece holds about ``limit`` bytes of text, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
