import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures
import restated
from sensorframe.operators import clips as K
from sensorframe.operators import frames as I
from sensorframe.operators import signal as S
from sensorframe.plans import crossval as XV
from sensorframe.plans import extract as X
from sensorframe.schema import BASE_CHANNELS, IMU_DEVICES, FeatureConfig
from sensorframe.sources import scan, sink

SMALL = ("imu", "skeleton", "imu_engineered", "skeleton_engineered", "ir_engineered")


def test_widths():
    config = FeatureConfig()
    widths = {"depth": 7285, "ir": 7285, "depth_engineered": 456, "ir_engineered": 228, "imu": 720,
              "imu_engineered": 1224, "skeleton": 3808, "skeleton_engineered": 605}
    assert {b: config.width(b) for b in widths} == widths


def test_parse_rules(spark):
    paths = [
        "HAR/data/IR/7_Jump/user1/t1/IR_2024-01-01_10-00-00.500_4.png", "HAR/data/IR/Jump/u/t/frame_12.JPG",
        "HAR/data/Sound/7_Jump/u/t/x.wav", "HAR/data/IR/7_Jump/u/x.png", "HAR/data/IR/7_Jump/u/t/.x.png",
        "HAR/data/IR/7_Jump/u/t/Thumbs.db", "__MACOSX/HAR/data/IR/7_Jump/u/t/a.png",
    ]
    df = spark.createDataFrame([(p, 5) for p in paths], "path string, length long")
    rows = {r["member_path"]: r for r in scan.parse_members(df, "train").collect()}
    assert set(rows) == set(paths[:2])
    first, second = rows[paths[0]], rows[paths[1]]
    assert (first["clip_id"], first["action_id"], first["timestamp"], first["frame_index"]) == (
        "7_Jump/user1/t1", 7, "2024-01-01_10-00-00.500", 4)
    assert (second["action_id"], second["timestamp"], second["frame_index"]) == (None, None, 12)
    with pytest.raises(ValueError):
        scan.parse_members(df, "other")


def test_index_of_one_clip(spark, tree):
    for split, clip in (("train", tree["clips"][0]), ("test", "SM_test_0001")):
        full = X.K.member_index(scan.scan_split(spark, tree[split], split)).filter(F.col("clip_id") == clip)
        one = X.clip_index(spark, tree[split], split, clip)
        key = lambda r: r["member_path"]
        assert sorted(one.collect(), key=key) == sorted(full.select(one.columns).collect(), key=key) and not one.isEmpty()
    assert X.clip_index(spark, tree["train"], "train", "3_Wave_arm/nobody/trial1").isEmpty()


def test_manifest_of_tree(spark, tree):
    rows = [r.asDict() for r in X.index_split(spark, tree["train"], "train", deep=True).collect()]
    by = {r["clip_id"]: r for r in rows}
    assert [r["clip_id"] for r in rows][:3] == [f"3_Wave_arm/{u}/trial1" for u in ("user2", "user10", "user11")]
    first = by[tree["clips"][0]]
    assert (first["source_kind"], first["source_path"]) == ("directory", tree["train"])
    assert first["depth_color_file_count"] == 5 and first["modality_count"] == 6 and first["complete"]
    assert first["depth_ir_aligned"] and first["depth_skeleton_aligned"]
    assert first["duration_seconds"] == 4.0
    assert first["radar_data_rows"] == 4 and first["radar_empty"] is False
    assert first["skeleton_empty_frames"] == 1 and first["skeleton_bad_json"] == 0
    second = by[tree["clips"][1]]
    assert second["depth_ir_aligned"] is False and second["radar_empty"] is None
    assert second["issues"] == "missing: Thermal, Radar; Depth/IR timestamps differ"
    weak = by[tree["weak"]]
    assert weak["depth_skeleton_aligned"] is None and weak["imu_empty_files"] == 1
    assert weak["issues"].endswith("1 empty IMU file(s)")


def test_selection(spark, tree):
    clips, funnel = X.select_training_clips(spark, tree["train"])
    assert sorted(r["clip_id"] for r in clips.collect()) == sorted(tree["clips"])
    assert {r["label"] for r in clips.collect()} == {3, 12}
    assert funnel.first().asDict() == {
        "logical_clips": 7, "modality_complete": 6, "nonempty_imu_files": 6, "all_imu_devices": 6}
    test = X.select_test_clips(spark, tree["test"], tree["index"]).orderBy("place").collect()
    assert [r["clip_id"] for r in test] == ["SM_test_0002", "SM_test_0003", "SM_test_0001"]


def test_imu_rows(spark, tmp_path):
    folder = tmp_path / "HAR" / "data" / "IMU" / "1_A" / "u" / "t"
    folder.mkdir(parents=True)
    row = "{t},{d},{a},2,2,0,0,{g}" + ",9" * 10
    lines = [
        "﻿" + fixtures.HEADER,
        row.format(t="later", d="WTC(1)", a=1, g=3),
        row.format(t="2024-01-01 10:00:01", d=" WTC (1)", a=4, g=3),
        "2024-01-01 10:00:02,WTC(1),1,2",
        row.format(t="2024-01-01 10:00:03", d="OTHER(1)", a=1, g=1),
        row.format(t="2024-01-01 10:00:03", d="WTC(1)", a="nan", g=1),
        "2024-01-01 10:00:00,WTC(1),1,2,2,0,0,3,inf,5",
    ]
    (folder / "a.csv").write_text("\n".join(lines), encoding="utf-8")
    rows = scan.scan_imu(spark, str(folder)).orderBy("ts").collect()
    assert [r["ts"] for r in rows] == [0.0, 1704103200.0, 1704103201.0]
    assert [r["time_known"] for r in rows] == [False, True, True]
    assert rows[0]["acc_norm"] == 3.0 and rows[0]["gyro_norm"] == 3.0
    assert rows[1]["angle_x"] is None and rows[1]["angle_y"] == 5.0 and rows[1]["q3"] is None
    assert {r["clip_id"] for r in rows} == {"1_A/u/t"}


def test_skeleton_variants(spark, tmp_path):
    folder = tmp_path / "HAR" / "data" / "Skeleton" / "1_A" / "u" / "t"
    folder.mkdir(parents=True)
    good = {"keypoints": fixtures.pose(0, 1), "keypoint_scores": [0.5] * 17}
    odd = {"keypoints": fixtures.pose(1, 2), "keypoint_scores": [0.5] * 3}
    bare = {"keypoints": fixtures.pose(1, 3)}
    short = {"keypoints": fixtures.pose(0, 1)[:16]}
    broken = json.loads(json.dumps(good))
    broken["keypoints"][4][1] = float("nan")
    for i, people in enumerate(([], [good, odd], [bare, short], [broken])):
        (folder / f"f_{i}.json").write_text(json.dumps(people))
    (folder / "f_4.json").write_text("{bad")
    rows = {r["frame_index"]: r["people"] for r in scan.scan_skeleton(spark, str(folder)).collect()}
    assert [len(rows[i]) for i in range(5)] == [0, 2, 1, 0, 0]
    assert rows[1][0]["scores"] == [0.5] * 17 and rows[1][1]["scores"] == [1.0] * 17 and rows[2][0]["scores"] == [1.0] * 17


def test_radar(spark, tree):
    points = scan.scan_radar(spark, f"{tree['train']}/data/Radar")
    rows = scan.radar_frames(points).orderBy("frame", "point").collect()
    assert [(r["frame"], r["point"], r["x"], r["y"], r["z"]) for r in rows] == [(2, 0, 4.0, 0.0, 0.0), (3, 0, 1.0, 2.0, 3.0), (3, 1, 5.0, 5.0, 5.0)]


def test_frames_are_decoded(spark, tree):
    config = FeatureConfig()
    rows = I.scan_frames(spark, f"{tree['train']}/data/IR", config).filter(F.col("clip_id") == tree["clips"][0]).orderBy("timestamp").collect()
    assert len(rows) == 5
    want = fixtures.bar(0, False, 1).astype(float) / 255
    np.testing.assert_allclose(np.array(rows[0]["image"]).reshape(48, 64), want, atol=1e-6)
    color = I.scan_frames(spark, f"{tree['train']}/data/Depth_Color", config, color=True)
    r = color.filter(F.col("clip_id") == tree["clips"][0]).orderBy("timestamp").first()
    rgb = fixtures.bar(0, True, 1).astype(float)
    gray = rgb @ [0.299, 0.587, 0.114]
    np.testing.assert_allclose(np.array(r["image"]).reshape(48, 64) * 255, gray, atol=1.0)
    value = np.array(r["color"]).reshape(48, 64, 3)[..., 2] * 255
    np.testing.assert_allclose(value, rgb.max(axis=-1), atol=1e-3)
    # the broken picture of the incomplete clip is left out
    assert rows and color.filter(F.col("clip_id") == tree["weak"]).count() == 1
    ir = I.scan_frames(spark, f"{tree['train']}/data/IR", config)
    assert ir.filter(F.col("clip_id") == tree["weak"]).count() == 0


def test_feature_table(spark, tree, tmp_path):
    config = FeatureConfig()
    clips, _ = X.select_training_clips(spark, tree["train"])
    test = X.select_test_clips(spark, tree["test"], tree["index"])
    train_rows = X.extract_split(spark, f"{tree['train']}/data", clips, config, SMALL)
    test_rows = X.extract_split(spark, tree["test"], test, config, SMALL, split="test")
    path = str(tmp_path / "table")
    sink.write_feature_table(train_rows, test_rows, config, SMALL, path)
    table = scan.read_feature_table(spark, path, config)
    rows = {(r["split"], r["clip_id"]): r for r in table.collect()}
    assert len(rows) == 9
    for (split, clip), r in rows.items():
        for block in SMALL:
            assert len(r[block]) == config.width(block), (clip, block)
            missing = sum(v is None for v in r[block])
            assert missing == (config.width(block) if clip == "SM_test_0003" else 0), (clip, block)
    # first device and channel of one clip against the plain form
    clip = tree["clips"][0]
    lines = fixtures.imu_rows(IMU_DEVICES[0], 10)
    values = [float(line.split(",")[2]) for line in lines]
    np.testing.assert_allclose(rows[("train", clip)]["imu"][:18], restated.signal(values), atol=1e-5)
    # the last device of the fixed order sits at the end
    lines = fixtures.imu_rows("WTRL", 14)
    values = [float(line.split(",")[3]) for line in lines]
    start = 4 * 8 * 18 + 18
    np.testing.assert_allclose(rows[("train", clip)]["imu"][start : start + 18], restated.signal(values), atol=1e-5)
    # reading fewer blocks prunes columns
    narrow = scan.read_feature_table(spark, path, config, ["imu"])
    assert narrow.columns[-1] == "imu" and "skeleton" not in narrow.columns
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "skeleton_engineered" not in plan
    with pytest.raises(K.DataError):
        scan.read_feature_table(spark, path, FeatureConfig(skeleton_frames=16))
    with pytest.raises(K.DataError):
        scan.read_feature_table(spark, path, config, ["depth"])
    ids = lambda rows_: rows_.select("clip_id")
    assert X.feature_table_current(table, ids(clips), ids(test), ["imu", "skeleton"])
    assert not X.feature_table_current(table, ids(clips).limit(3), ids(test), ["imu"])
    assert not X.feature_table_current(table, ids(clips), ids(test), ["depth"])
    health = {r["block"]: r.asDict() for r in K.feature_health(table.filter("split = 'test'"), ["imu"]).collect()}
    assert health["imu"] == {"block": "imu", "complete_rows": 2, "partial_rows": 0, "all_missing_rows": 1}
    K.require_finite(table.filter("split = 'train'"), SMALL)
    with pytest.raises(K.DataError):
        K.require_finite(table.filter("split = 'test'"), SMALL)


def test_train_writes_submission(spark, tree, tmp_path):
    from sensorframe.plans import models as M

    config, blocks = FeatureConfig(), ("imu", "skeleton_engineered")
    clips, _ = X.select_training_clips(spark, tree["train"])
    test = X.select_test_clips(spark, tree["test"], tree["index"])
    path = str(tmp_path / "table")
    sink.write_feature_table(
        X.extract_split(spark, f"{tree['train']}/data", clips, config, blocks),
        X.extract_split(spark, tree["test"], test, config, blocks, split="test"), config, blocks, path)
    table = scan.read_feature_table(spark, path, config)
    model, report, found = X.train(table, blocks, "logistic_regression", [{"C": 0.1}], folds=2, config=config)
    assert report["training_clips"] == 6 and report["test_clips"] == 3 and report["classes"] == [3, 12]
    assert report["test_feature_health"]["imu"]["all_missing_rows"] == 1
    assert found.count() == 6
    sink.write_report(spark, report, str(tmp_path / "runs" / "a" / "validation.json"))
    sink.write_oof(XV.selected_out_of_fold(found, report), str(tmp_path / "oof"))
    stored = spark.read.parquet(str(tmp_path / "oof")).collect()
    assert len(stored) == 6 and all(len(r["repeats"]) == 1 and r["classes"] == [3, 12] and abs(sum(r["probability"]) - 1) < 1e-6 for r in stored)
    assert {r["clip_id"]: r["prediction"] for r in stored} == {r["clip_id"]: r["prediction"] for r in found.collect()}
    assert report["raw_feature_dimensions"] == {b: config.width(b) for b in blocks}
    assert all(f["training_clips"] + f["validation_clips"] == 6 for f in report["folds"]) and report["metrics_basis"]
    model.save(spark, str(tmp_path / "model"))
    again = M.ClipModel.load(spark, str(tmp_path / "model"))
    features = table.filter("split = 'test'")
    one = {r["clip_id"]: r["prediction"] for r in model.predict(features).collect()}
    two = {r["clip_id"]: r["prediction"] for r in again.predict(features).collect()}
    assert one == two and len(one) == 3
    mapping = spark.createDataFrame([(3, "wave"), (12, "sit")], "action_id int, action_name string")
    named = M.predict_clips(again, features, mapping)
    rows = named.join(test.select("clip_id", "place"), "clip_id").select(
        F.col("submission_path").alias("path"), F.col("action_id").alias("prediction"), "place")
    sink.write_submission(rows, str(tmp_path / "submission"))
    back = scan.read_test_index(spark, str(tmp_path / "submission")).orderBy("place").collect()
    assert [r["clip_id"] for r in back] == ["SM_test_0002", "SM_test_0003", "SM_test_0001"]
    sink.write_predictions(named, str(tmp_path / "predictions"), "clip_id")
    good, counters = scan.read_predictions(spark, str(tmp_path / "predictions"), mapping)
    assert good.count() == 3 and counters.first()["blank_predictions"] == 0
    with pytest.raises(K.DataError):
        sink.write_predictions(named, str(tmp_path / "p2"), "name")
    with pytest.raises(K.DataError):
        model.predict(features.drop("imu"))


def test_reports(spark, tmp_path):
    from sensorframe.plans import evaluate as E

    def report(name, body):
        folder = tmp_path / "runs" / name
        folder.mkdir(parents=True)
        (folder / "validation.json").write_text(body)

    metrics = {"accuracy": 0.5, "macro_f1": 0.4, "balanced_accuracy": 0.3}
    better = {"accuracy": 0.6, "macro_f1": 0.7, "balanced_accuracy": 0.5}
    fold = {"fold": 1, "validation_clips": 4, "candidates": [{"parameters": {"C": 0.1}, "metrics": metrics}, {"parameters": {"C": 1.0}, "metrics": better}]}
    report("a", json.dumps({
        "algorithm": "logistic_regression", "selected_parameters": {"C": 1.0}, "training_clips": 9, "folds": [fold],
        "aggregate_metrics": [{"parameters": {"C": 0.1}, "metrics": metrics}, {"parameters": {"C": 1.0}, "metrics": better}],
        "feature_blocks": ["imu", "skeleton"]}))
    report("b", json.dumps({"algorithm": "logistic_regression", "selected_parameters": {"C": 1.0}, "validation_skipped": True,
                            "raw_feature_dimensions": {"skeleton": 3, "depth": 2}}))
    report("c", "{broken")
    report("d", json.dumps({"selected_parameters": {"weighting": "stacked", "C": 0.03}}))
    read = scan.read_reports(spark, str(tmp_path / "runs"))
    assert read.filter("error IS NOT NULL").count() == 1
    parsed = E.parsed_reports(read)
    rows = {r["artifact_name"]: r for r in E.comparison_rows(parsed).collect()}
    assert rows["a"]["macro_f1"] == 0.7 and rows["a"]["parameters"] == '{"C": 1.0}' and rows["a"]["feature_blocks"] == "imu, skeleton"
    assert rows["b"]["macro_f1"] is None and rows["b"]["feature_blocks"] == "depth, skeleton" and rows["b"]["validation_skipped"]
    assert rows["d"]["algorithm"] == "d" and rows["d"]["parameters"] == '{"C": 0.03, "weighting": "stacked"}' and rows["d"]["feature_blocks"] == "—"
    placed = E.comparison_rows(parsed).withColumn("place", F.ascii("artifact_name"))
    labeled = E.unique_run_labels(placed, "place")
    assert {r["label"] for r in labeled.collect()} == {"logistic_regression (a)", "logistic_regression (b)", "d"}
    sink.write_comparison(labeled, str(tmp_path / "comparison"))
    first = spark.read.option("header", True).csv(str(tmp_path / "comparison"))
    assert first.columns[0] == "label" and first.first()["label"] == "logistic_regression (a)"
    series = E.fold_series(parsed, "macro_f1").collect()
    assert [(r["fold"], r["macro_f1"]) for r in series] == [(1, 0.7)]
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "validation.json").write_text("{}")
    assert scan.read_reports(spark, str(flat)).count() == 1


def test_manifest_formats(spark, tree, tmp_path):
    manifest = X.index_split(spark, tree["test"], "test")
    for suffix in ("parquet", "csv", "json"):
        path = str(tmp_path / f"m.{suffix}")
        sink.write_manifest(manifest, path)
        back = scan.read_manifest(spark, path)
        assert back.schema["complete"].dataType.simpleString() == "boolean"
        assert back.count() == 3
        if suffix == "csv":
            assert back.columns == sorted(back.columns)
    with pytest.raises(K.DataError):
        sink.write_manifest(manifest, str(tmp_path / "m.txt"))


def test_trace(spark, tree):
    rows = scan.scan_imu(spark, f"{tree['train']}/data/IMU/{tree['clips'][0]}")
    trace = S.imu_trace(rows)
    assert trace.count() == 60 and set(trace.columns) == {"clip_id", "device", "ts", "acceleration", "gyroscope"}
    assert len(BASE_CHANNELS) == 8
