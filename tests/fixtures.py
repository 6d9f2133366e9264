"""Generated sensor files: a small train and test tree."""

import json
import math
import struct
import zlib
from pathlib import Path

import numpy as np

DEVICES = {"up": ("WTLA", "WTRA", "WTC"), "down": ("WTLL", "WTRL")}
HEADER = "time,DeviceName,AccX,AccY,AccZ,AsX,AsY,AsZ,AngleX,AngleY,AngleZ,MagX,MagY,MagZ,Q0,Q1,Q2,Q3"


def png(path: Path, pixels: np.ndarray) -> None:
    """8-bit grey (h, w) or colour (h, w, 3) image."""
    color = pixels.ndim == 3
    height, width = pixels.shape[:2]
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(height))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if color else 0, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def stamp(i: int) -> str:
    return f"2024-01-01_10-00-{i:02d}.500"


def bar(i: int, color: bool, shift: int = 0) -> np.ndarray:
    image = np.full((48, 64), 20, dtype=np.uint8)
    image[:, 5 * i + 3 + shift : 5 * i + 11 + shift] = 220
    image += np.arange(48, dtype=np.uint8)[:, None] // 2
    return np.stack((image, image // 2, 255 - image), axis=-1) if color else image


def imu_rows(device: str, seed: int, rows: int = 12) -> list[str]:
    rng = np.random.default_rng(seed)
    lines = []
    for i in range(rows):
        base = ",".join(f"{v:.4f}" for v in rng.normal(size=6))
        angle = ",".join(f"{(40.0 * i + 7 * k) % 360 - 180:.3f}" for k in range(3))
        mag = ",".join(f"{v:.3f}" for v in rng.normal(size=3))
        turn = 0.2 * i
        q = f"{math.cos(turn):.5f},{math.sin(turn):.5f},{0.1 * math.sin(i):.5f},0.05"
        lines.append(f"2024-01-01 10:00:{i:02d}.{seed % 10}00,{device}(ab:{seed}),{base},{angle},{mag},{q}")
    return lines


def pose(i: int, seed: int) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(17, 3)) * 0.3
    points[0] = 0.0
    points[[11, 14], 2] += 1.0
    points += 0.02 * i * rng.normal(size=(17, 3))
    return points.round(5).tolist()


def write_clip(folders: dict[str, Path], seed: int, *, frames: int = 5, misaligned: bool = False) -> None:
    for i in range(frames):
        png(folders["Depth_Color"] / f"Depth_{stamp(i)}_{i}_Color.png", bar(i, True, seed % 7))
        png(folders["IR"] / f"IR_{stamp(i + (1 if misaligned else 0))}_{i}.png", bar(i, False, seed % 5))
        people = [{"keypoints": pose(i, seed), "keypoint_scores": [0.9] * 17}]
        if i == 2:
            people = []
        folders["Skeleton"].mkdir(parents=True, exist_ok=True)
        (folders["Skeleton"] / f"Color_{stamp(i)}_{i}.json").write_text(json.dumps(people))
    folders["IMU"].mkdir(parents=True, exist_ok=True)
    for k, (name, devices) in enumerate(DEVICES.items()):
        lines = [HEADER]
        for d, device in enumerate(devices):
            lines += imu_rows(device, seed * 10 + k * 3 + d)
        (folders["IMU"] / f"{name}.csv").write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")


def write_tree(root: Path) -> dict:
    base = root / "HAR" / "data"
    clips = []
    seed = 0
    for action in ("3_Wave_arm", "12_Sit_down"):
        for user in ("user2", "user10", "user11"):
            seed += 1
            clip = f"{action}/{user}/trial1"
            write_clip({m: base / m / clip for m in ("Depth_Color", "IR", "Skeleton", "IMU")}, seed, misaligned=seed == 2)
            clips.append(clip)
    # radar and thermal of the first clip only
    radar = base / "Radar" / clips[0]
    radar.mkdir(parents=True)
    (radar / "radar.csv").write_text("timestamp,frame,x,y,z,v,snr,noise\n1,3.0,1,2,3,0.5,9,1\n2,2,4,,x,1,8,1\n3,3,5,5,5,1,7,1\n4,bad,1,1,1,1,1,1\n")
    png(base / "Thermal" / clips[0] / "frame_000001.png", bar(0, False))
    # an incomplete clip: no skeleton, one device missing, header-only file, hidden files
    weak = "12_Sit_down/user2/trial9"
    png(base / "Depth_Color" / weak / f"Depth_{stamp(0)}_0_Color.png", bar(0, True))
    (base / "IR" / weak).mkdir(parents=True)
    (base / "IR" / weak / f"IR_{stamp(0)}_0.png").write_bytes(b"image")
    (base / "IMU" / weak).mkdir(parents=True)
    (base / "IMU" / weak / "up.csv").write_text(HEADER + "\n")
    (base / "IMU" / weak / "down.csv").write_text("\n".join([HEADER, *imu_rows("WTLL", 77, 2)]) + "\n")
    (base / "IMU" / weak / ".hidden.csv").write_text("x\n")
    # test split
    test = root / "small_model_track_test"
    for number in (1, 2):
        write_clip({m: test / f"SM_test_000{number}" / m for m in ("Depth_Color", "IR", "Skeleton", "IMU")}, 50 + number)
    png(test / "SM_test_0003" / "Depth_Color" / f"Depth_{stamp(0)}_0_Color.png", bar(0, True))
    index = root / "test.csv"
    index.write_text("path,prediction\n./x/SM_test_0002/,\n./x/SM_test_0003,\n./x/SM_test_0001/,\n")
    return {"root": root, "train": str(root / "HAR"), "test": str(test), "index": str(index), "clips": clips, "weak": weak}
