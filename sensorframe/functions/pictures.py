"""Bytes of image files to 8-bit pixels, inside tasks.

Pillow decodes every kind where it is installed. Without it PNG files are decoded here; their row filters are undone along the image's
diagonals, since a byte depends only on its left, upper and upper left neighbours.
"""

from __future__ import annotations

import importlib.util
import io
import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of each PNG colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First row, first column and steps of the seven interlaced passes.
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def all_kinds() -> bool:
    return importlib.util.find_spec("PIL") is not None


def file_bytes(path: str) -> bytes:
    """A file's bytes, through pyarrow's file systems."""
    from pyarrow import fs

    path = path.replace("s3a://", "s3://", 1)
    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with store.open_input_stream(inside, compression=None) as stream:
        return stream.read()


def decoded(raw: bytes) -> np.ndarray | None:
    """Pixels (height, width, 1 or 3) of an image file, None if it is not a whole one."""
    try:
        if all_kinds():
            from PIL import Image

            with Image.open(io.BytesIO(raw)) as picture:
                gray = picture.mode in ("1", "L", "LA", "I;16")
                pixels = np.asarray(picture.convert("L" if gray else "RGB"))
            return pixels.reshape(*pixels.shape[:2], -1)
        return decoded_png(raw)
    except (ValueError, TypeError, KeyError, IndexError, OSError, struct.error, zlib.error):
        return None


def unfiltered(data: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters of (rows, bytes); ``step`` is the bytes of a pixel.

    Pixels of one diagonal are done together: each needs only pixels of the two diagonals before.
    """
    rows, width = data.shape[0], data.shape[1] // step
    pixels = data.reshape(rows, width, step)
    if not filters.any():
        return data
    if (filters > 4).any():
        raise ValueError("unknown row filter")
    # a border of zeros above and on the left
    out = np.zeros((rows + 1, width + 1, step), np.int16)
    for diagonal in range(rows + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(rows, diagonal + 1))
        x = diagonal - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        kind = filters[y][:, None]
        added = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[y + 1, x + 1] = (pixels[y, x] + added) & 255
    return out[1:, 1:].astype(np.uint8).reshape(rows, -1)


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Samples (rows, width, channels) of unfiltered rows; 16-bit ones by their upper byte."""
    if depth == 8:
        return lines.reshape(len(lines), width, channels)
    if depth == 16:
        return lines.reshape(len(lines), width, channels, 2)[..., 0]
    bits = np.unpackbits(lines, axis=1)[:, : width * channels * depth].reshape(len(lines), width, channels, depth)
    return (bits * (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)).sum(axis=-1, dtype=np.uint8)


def decoded_png(raw: bytes) -> np.ndarray:
    """Grey or red, green, blue pixels of a PNG file; transparency is left out."""
    if raw[:8] != _SIGNATURE:
        raise ValueError("no PNG file")
    at, parts, palette, head = 8, [], None, None
    while at < len(raw):
        length, kind = struct.unpack(">I4s", raw[at : at + 8])
        body, check = raw[at + 8 : at + 8 + length], raw[at + 8 + length : at + 12 + length]
        if len(check) < 4 or zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            raise ValueError("damaged PNG file")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + length
    if head is None:
        raise ValueError("PNG file without a header")
    width, height, depth, color, _, _, interlaced = head
    channels = _CHANNELS[color]
    data = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(data) < height * (width * channels * depth // 8):
        raise ValueError("PNG file with missing rows")
    found = np.zeros((height, width, channels), np.uint8)
    start = 0
    for y, x, down, right in _PASSES if interlaced else ((0, 0, 1, 1),):
        rows, columns = len(range(y, height, down)), len(range(x, width, right))
        if not rows or not columns:
            continue
        size = (columns * channels * depth + 7) // 8
        lines = data[start : start + rows * (size + 1)].reshape(rows, size + 1)
        start += rows * (size + 1)
        clean = unfiltered(np.ascontiguousarray(lines[:, 1:]), lines[:, 0], max(1, channels * depth // 8))
        found[y::down, x::right] = _samples(clean, columns, channels, depth)
    if color == 3:
        return palette[found[..., 0]]
    if color in (0, 4) and depth < 8:
        found = found * (255 // ((1 << depth) - 1))
    return found[..., :1] if color in (0, 4) else found[..., :3]
