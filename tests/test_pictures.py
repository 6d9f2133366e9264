import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.functions import pictures
from sensorframe.operators import frames as I
from sensorframe.schema import FeatureConfig

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _filtered(row, above, step, kind):
    """One filtered row of bytes, byte by byte."""
    out = []
    for i, v in enumerate(row):
        a = row[i - step] if i >= step else 0
        b = above[i]
        c = above[i - step] if i >= step else 0
        p = a + b - c
        near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
    return bytes([kind, *out])


def _packed(samples, depth):
    """Bytes of one row of samples."""
    if depth == 16:
        return [b for v in samples for b in (v >> 8, v & 255)]
    if depth == 8:
        return list(samples)
    bits = "".join(format(v, f"0{depth}b") for v in samples)
    return [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]


def encoded(pixels, color, depth=8, interlaced=False, filters=(0, 1, 2, 3, 4), palette=None):
    """A PNG file of samples (height, width, channels) with the given row filters in turn."""
    height, width, channels = pixels.shape
    step = max(1, channels * depth // 8)
    raw, turn = b"", 0
    for y, x, down, right in pictures._PASSES if interlaced else ((0, 0, 1, 1),):
        part = pixels[y::down, x::right]
        if not part.size:
            continue
        above = [0] * len(_packed(part[0].ravel().tolist(), depth))
        for row in part:
            now = _packed(row.ravel().tolist(), depth)
            raw += _filtered(now, above, step, filters[turn % len(filters)])
            above, turn = now, turn + 1
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, int(interlaced)))
    colors = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    squeezed = zlib.compress(raw)
    data = b"".join(chunk(b"IDAT", squeezed[i : i + 40]) for i in range(0, len(squeezed), 40))
    return b"\x89PNG\r\n\x1a\n" + head + colors + chunk(b"tEXt", b"a\0b") + data + chunk(b"IEND", b"")


@pytest.mark.parametrize("color, depth", [(0, 8), (0, 16), (0, 1), (0, 2), (0, 4), (2, 8), (2, 16), (3, 8), (3, 4), (4, 8), (6, 8)])
@pytest.mark.parametrize("interlaced", [False, True])
def test_every_kind_of_png(color, depth, interlaced):
    rng = np.random.default_rng(color * 100 + depth)
    palette = rng.integers(0, 256, (16, 3))
    most = 16 if color == 3 else 1 << depth
    pixels = rng.integers(0, most, (11, 13, CHANNELS[color]))
    found = pictures.decoded_png(encoded(pixels, color, depth, interlaced, palette=palette if color == 3 else None))
    if color == 3:
        want = palette[pixels[..., 0]]
    else:
        want = (pixels >> 8 if depth == 16 else pixels * (255 // ((1 << depth) - 1)))[..., : 1 if color in (0, 4) else 3]
    np.testing.assert_array_equal(found, want)


def test_sizes_of_one_pixel():
    for height, width in ((1, 1), (1, 9), (9, 1)):
        pixels = np.arange(height * width * 3).reshape(height, width, 3) * 7 % 256
        np.testing.assert_array_equal(pictures.decoded_png(encoded(pixels, 2, interlaced=True)), pixels)


def test_damaged_files_are_none():
    whole = encoded(np.full((6, 6, 3), 9), 2)
    assert pictures.decoded(whole) is not None
    for bad in (b"", b"image", whole[:60], whole[:-30], whole[:-20] + bytes([whole[-20] ^ 255]) + whole[-19:], whole.replace(b"IHDR", b"IHDX"), encoded(np.full((6, 6, 1), 99), 3, palette=np.zeros((2, 3)))):
        assert pictures.decoded(bad) is None


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    root = tmp_path / "HAR" / "data" / "Depth_Color"
    for user, count in (("user1", 40), ("user2", 3)):
        clip = root / "1_Act" / user / "t1"
        clip.mkdir(parents=True)
        for i in range(count):
            channels, color = ((1, 0), (3, 2), (4, 6))[i % 3]
            pixels = rng.integers(0, 256, (60, 90, channels)) if i % 2 else np.cumsum(rng.integers(0, 3, (48, 64, channels)), axis=1) % 256
            (clip / f"frame_{i:03d}.png").write_bytes(encoded(pixels, color, interlaced=i % 5 == 0))
    (root / "1_Act" / "user2" / "t1" / "frame_900.png").write_bytes(b"no image")
    return root


@pytest.mark.parametrize("color", [False, True])
def test_frames_equal_those_of_the_image_source(spark, folder, color):
    config = FeatureConfig(max_image_frames=100)
    found = {r["path"]: r for r in I.scan_frames(spark, str(folder), config, color=color).collect()}
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(str(folder))
    rows = I.decode_frames(images.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("path"), "image"), config, color).collect()
    assert len(found) == len(rows) == 43
    for r in rows:
        np.testing.assert_allclose(found[r["path"]]["image"], r["image"], atol=1e-6)
        if color:
            np.testing.assert_allclose(found[r["path"]]["color"], r["color"], atol=1e-6)


def test_only_chosen_files_are_opened(spark, folder, monkeypatch):
    opened = spark.sparkContext.accumulator(0)
    config = FeatureConfig(max_image_frames=8)
    df = I.scan_frames(spark, str(folder), config, opened=opened)
    rows = df.collect()
    # 8 of 40 files, and all four of the other clip, one of which is no image
    assert opened.value == 12 and len(rows) == 11
    plan = df._jdf.queryExecution().executedPlan().toString()
    # what is dealt out are rows of the listing; files are read after it, in the last step
    assert "MapInArrow" in plan and plan.index("MapInArrow") < plan.index("Exchange") and "data" not in plan.split("Exchange")[1].split("Scan")[0]


def test_batches_are_bounded(spark, folder, monkeypatch):
    monkeypatch.setattr(I, "BATCH_BYTES", 3 * 4 * 48 * 64)
    config = FeatureConfig(max_image_frames=100)
    files = spark.createDataFrame([(str(p), 1) for p in sorted(folder.rglob("*.png"))], "path string, place int").coalesce(1)
    sizes = I.read_frames(files, config, False).mapInPandas(lambda ps: (p.assign(place=len(p))[["path", "place"]] for p in ps), "path string, place int")
    assert sizes.count() == 43
    assert I.read_frames(files.limit(0), config, True).isEmpty()


def test_other_kinds_by_the_image_source(spark, folder):
    clip = folder / "1_Act" / "user1" / "t1"
    picture = spark._jvm.java.awt.image.BufferedImage(64, 48, 5)
    for x in range(64):
        picture.setRGB(x, 20, 0xC08040)
    spark._jvm.javax.imageio.ImageIO.write(picture, "jpg", spark._jvm.java.io.File(str(clip / "frame_500.JPG")))
    config = FeatureConfig(max_image_frames=100)
    rows = I.scan_frames(spark, str(folder), config, color=True).collect()
    assert len(rows) == 44 and [len(r["color"]) for r in rows if r["path"].endswith(".JPG")] == [48 * 64 * 3]
