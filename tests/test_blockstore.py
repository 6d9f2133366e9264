import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures
from sensorframe.operators.clips import DataError
from sensorframe.plans import extract as X
from sensorframe.schema import FeatureConfig
from sensorframe.sources import blockstore as B

CLIPS = [("train", f"c{i}", i % 3, f"u{i % 2}", None) for i in range(6)] + [("test", f"t{i}", None, None, f"./t{i}/") for i in range(3)]


def listed(spark, rows=CLIPS):
    return spark.createDataFrame(rows, "split string, clip_id string, label int, user string, submission_path string")


def recorder(spark, calls, factor=1.0):
    """Extracts made-up values and notes what it was asked for."""
    def extract(split, clips, blocks):
        ids = sorted(r["clip_id"] for r in clips.collect())
        calls.append((split, tuple(ids), tuple(blocks)))
        value = F.regexp_extract("clip_id", r"(\d+)", 1).cast("double") * factor
        return clips.select("clip_id", *[F.array(value, value + i).alias(b) for i, b in enumerate(blocks)])

    return extract


def rows(df):
    return {(r["split"], r["clip_id"]): r for r in df.collect()}


def test_only_missing_pairs_are_extracted(spark, tmp_path):
    path, config, calls = str(tmp_path / "t"), FeatureConfig(), []
    first = B.refresh(spark, path, listed(spark, CLIPS[:4] + CLIPS[6:8]), ["imu", "skeleton"], config, recorder(spark, calls))
    assert first == {(s, b): n for s, n in (("train", 4), ("test", 2)) for b in ("imu", "skeleton")} and len(calls) == 2
    # nothing is missing
    calls.clear()
    assert B.refresh(spark, path, listed(spark, CLIPS[:4] + CLIPS[6:8]), ["skeleton"], config, recorder(spark, calls)) == {} and calls == []
    assert set(B.read(spark, path, config).columns) >= {"imu", "skeleton"}
    # a new block: one call a split for this block alone, the others stay
    assert B.refresh(spark, path, listed(spark, CLIPS[:4] + CLIPS[6:8]), ["imu_engineered"], config, recorder(spark, calls, 10.0)) == {
        ("train", "imu_engineered"): 4, ("test", "imu_engineered"): 2}
    assert sorted(calls) == [("test", ("t0", "t1"), ("imu_engineered",)), ("train", ("c0", "c1", "c2", "c3"), ("imu_engineered",))]
    # new clips: all blocks of these clips alone; a clip that is gone is not returned
    calls.clear()
    B.refresh(spark, path, listed(spark, CLIPS[1:]), ["imu"], config, recorder(spark, calls))
    assert sorted(calls) == [("test", ("t2",), ("imu", "skeleton", "imu_engineered")), ("train", ("c4", "c5"), ("imu", "skeleton", "imu_engineered"))]
    found = rows(B.read(spark, path, config))
    assert set(found) == {(s, c) for s, c, *_ in CLIPS[1:]}
    assert list(found["train", "c3"]["imu"]) == [3.0, 3.0] and list(found["train", "c3"]["imu_engineered"]) == [30.0, 30.0]
    assert list(found["train", "c5"]["imu"]) == [5.0, 5.0] and list(found["train", "c5"]["imu_engineered"]) == [5.0, 7.0]
    assert (found["train", "c4"]["label"], found["train", "c4"]["user"], found["test", "t2"]["submission_path"]) == (1, "u0", "./t2/")


def test_untouched_partitions_are_not_written(spark, tmp_path):
    path, config = tmp_path / "t", FeatureConfig()
    B.refresh(spark, str(path), listed(spark), ["imu"], config, recorder(spark, []))
    files = {p: p.stat().st_mtime_ns for p in (path / "blocks").rglob("*.parquet")}
    B.refresh(spark, str(path), listed(spark), ["skeleton"], config, recorder(spark, []))
    assert files.items() <= {p: p.stat().st_mtime_ns for p in (path / "blocks").rglob("*.parquet")}.items()
    plan = B.read(spark, str(path), config, ["skeleton"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan and "skeleton" in plan


def test_another_configuration_is_built_anew_with_all_blocks(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []
    B.refresh(spark, path, listed(spark), ["imu", "skeleton"], FeatureConfig(), recorder(spark, calls))
    other = FeatureConfig(temporal_bins=FeatureConfig().temporal_bins + 1)
    with pytest.raises(DataError):
        B.read(spark, path, other)
    calls.clear()
    B.refresh(spark, path, listed(spark), ["imu_engineered"], other, recorder(spark, calls, 2.0))
    assert {c[2] for c in calls} == {("imu", "skeleton", "imu_engineered")}
    assert list(rows(B.read(spark, path, other))["train", "c5"]["imu"]) == [10.0, 10.0]
    with pytest.raises(DataError):
        B.read(spark, path, other, ["depth"])


def test_unusable_clips_are_refused(spark, tmp_path):
    path, config = str(tmp_path / "t"), FeatureConfig()
    for bad in (CLIPS + CLIPS[:1], [("train", "c", None, "u", None)], [("test", "t", None, None, None)]):
        with pytest.raises(DataError):
            B.refresh(spark, path, listed(spark, bad), ["imu"], config, recorder(spark, []))
    with pytest.raises(ValueError):
        B.refresh(spark, path, listed(spark), ["sound"], config, recorder(spark, []))
    assert B._metadata(spark, path) is None


def test_a_file_tree_is_widened(spark, tmp_path):
    tree = fixtures.write_tree(tmp_path / "files")
    path, config = str(tmp_path / "table"), FeatureConfig()
    clips, _ = X.select_training_clips(spark, tree["train"])
    test = X.select_test_clips(spark, tree["test"], tree["index"])
    # the chosen clips are fixed before folders go
    clips, test = (spark.createDataFrame(df.orderBy("clip_id").collect(), df.schema) for df in (clips, test))
    splits = {"train": (f"{tree['train']}/data", clips.limit(4)), "test": (tree["test"], test)}
    X.refresh_feature_table(spark, path, config, splits, ["imu"])
    splits["train"] = (f"{tree['train']}/data", clips)
    # without the other folders the new block can only come from its own modality
    for folder in (tmp_path / "files" / "HAR" / "data" / "Depth_Color", tmp_path / "files" / "HAR" / "data" / "IR"):
        folder.rename(folder.with_name(f"_{folder.name}"))
    counts = X.refresh_feature_table(spark, path, config, splits, ["skeleton_engineered"])
    assert counts == {("train", "imu"): 2, ("train", "skeleton_engineered"): 6, ("test", "skeleton_engineered"): 3}
    found = rows(B.read(spark, path, config))
    direct = X.extract_split(spark, f"{tree['train']}/data", clips, config, ["imu", "skeleton_engineered"])
    assert len(found) == 9
    for r in direct.collect():
        for block in ("imu", "skeleton_engineered"):
            np.testing.assert_allclose(np.array(found["train", r["clip_id"]][block], float), np.array(r[block], float), atol=1e-5)
    assert json.loads("".join(r["value"] for r in spark.read.text(f"{path}/metadata").collect()))["blocks"] == ["imu", "skeleton_engineered"]
