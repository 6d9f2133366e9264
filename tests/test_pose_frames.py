import numpy as np
import pytest
from pyspark.sql import functions as F

import restated
from sensorframe.operators import frames as I
from sensorframe.operators import pose as P
from sensorframe.schema import EDGES, JOINT, FeatureConfig
from sensorframe.skew import OrderedGroups

PEOPLE = "k int, i int, people array<struct<points:array<array<double>>,scores:array<double>>>"


def crowd(clips=3, frames=25):
    rng = np.random.default_rng(9)
    data = {}
    for k in range(clips):
        rows = []
        for i in range(frames):
            count = 0 if (i + k) % 6 == 0 else 1 + (i + k) % 3
            rows.append([(rng.normal(size=(17, 3)).tolist(), rng.uniform(size=17).tolist()) for _ in range(count)])
        data[k] = rows
    return data


@pytest.mark.parametrize("chunk", [256, 3])
@pytest.mark.parametrize("cut", [False, True])
def test_person_track(spark, cut, chunk, request, monkeypatch):
    if cut:
        request.getfixturevalue("small_groups")
    monkeypatch.setattr(P, "CHUNK", chunk)
    data = crowd()
    data[7] = [[] for _ in range(5)]
    df = spark.createDataFrame([(k, i, p) for k, f in data.items() for i, p in enumerate(f)], PEOPLE)
    found = {}
    tracked = P.person_track(OrderedGroups(df, ["k"], ["i"], F.col("i")))
    for r in tracked.orderBy("k", "i").collect():
        found.setdefault(r["k"], []).append(r["person"])
    for k, frames in data.items():
        assert found[k] == restated.person_choice(frames)
    assert "Python" not in tracked._jdf.queryExecution().executedPlan().toString() and "Pandas" not in tracked._jdf.queryExecution().executedPlan().toString()


def test_a_long_clip_is_tracked(spark):
    data = {k: f * 40 for k, f in crowd().items()}
    df = spark.createDataFrame([(k, i, p) for k, f in data.items() for i, p in enumerate(f)], PEOPLE)
    tracked = P.person_track(OrderedGroups(df, ["k"], ["i"], F.col("i")))
    found = {}
    for r in tracked.orderBy("k", "i").collect():
        found.setdefault(r["k"], []).append(r["person"])
    assert max(map(len, found.values())) > P.CHUNK and found == {k: restated.person_choice(f) for k, f in data.items()}


def poses(frames=7, seed=2):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(frames, 17, 3))


def pose_groups(spark, points, scores=None, missing=()):
    rows = [
        (1, i, None if i in missing else p.ravel().tolist(), None if i in missing else [0.25 + 0.1 * i] * 17)
        for i, p in enumerate(points)
    ]
    return OrderedGroups(spark.createDataFrame(rows, "k int, i int, pose array<double>, scores array<double>"), ["k"], ["i"], F.col("i"))


@pytest.mark.parametrize("cut", [False, True])
def test_pose_normalize(spark, cut, request):
    if cut:
        request.getfixturevalue("small_groups")
    points = poses(9)
    found = P.pose_normalize(pose_groups(spark, points, missing=(0, 3, 4, 8))).df.orderBy("i").collect()
    flat = np.array([None if i in (0, 3, 4, 8) else p for i, p in enumerate(points)], dtype=object)
    held = np.stack([
        restated.filled([None if f is None else f[j, a] for f in flat]) for j in range(17) for a in range(3)
    ]).T.reshape(-1, 17, 3)
    torso = np.linalg.norm((held[:, JOINT["l_shoulder"]] + held[:, JOINT["r_shoulder"]]) / 2 - held[:, 0], axis=1)
    want = (held - held[:, :1]) / np.median(torso)
    np.testing.assert_allclose([r["pose"] for r in found], want.reshape(9, 51), atol=1e-9)


def test_skeleton_blocks(spark):
    config = FeatureConfig()
    groups = P.pose_normalize(pose_groups(spark, poses(), missing=(2,)))
    samples = P.pose_samples(groups, config.skeleton_frames).cache()
    base = P.skeleton_base(samples, "k").first()["skeleton"]
    wide = P.skeleton_engineered(samples, "k", config).first()["skeleton_engineered"]
    assert len(base) == config.width("skeleton") == 3808
    assert len(wide) == config.width("skeleton_engineered") == 605
    assert all(v is not None and np.isfinite(v) for v in base + wide)
    held = np.array([r["pose"] for r in groups.df.orderBy("i").collect()])
    want = np.stack([restated.resampled(held[:, c], 32) for c in range(51)]).T
    np.testing.assert_allclose(np.array(base[: 32 * 51]).reshape(32, 51), want, atol=1e-5)
    velocity = np.diff(want, axis=0, prepend=want[:1])
    np.testing.assert_allclose(np.array(base[32 * 51 : 64 * 51]).reshape(32, 51), velocity, atol=1e-5)
    angle = []
    p = want.reshape(32, 17, 3)
    for t in p:
        a, b = t[11] - t[12], t[13] - t[12]
        angle.append(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-8))
    np.testing.assert_allclose(wide[:18], restated.signal(angle), atol=1e-4)
    speed = np.linalg.norm(np.diff(p, axis=0, prepend=p[:1]), axis=2)
    np.testing.assert_allclose(wide[24 * 18 : 24 * 18 + 4], [speed[:, 0].mean(), speed[:, 0].std(), speed[:, 0].max(), speed[:, 0].sum()], atol=1e-4)


def test_stabilized_pose_has_median_bones(spark):
    points = poses(5)
    df = pose_groups(spark, points).df
    bones = P.bone_lengths(df, ["k"])
    want = [np.median([np.linalg.norm(p[a] - p[b]) for p in points]) for a, b in EDGES]
    np.testing.assert_allclose(bones.first()["bones"], want, atol=1e-9)
    for r in P.stabilize_pose(df, ["k"], bones).collect():
        p = np.array(r["pose"]).reshape(17, 3)
        np.testing.assert_allclose([np.linalg.norm(p[a] - p[b]) for a, b in EDGES], want, atol=1e-9)


def test_bones_missing_edge(spark):
    points = poses(3)
    points[:, 16] = points[:, 15]
    df = pose_groups(spark, points).df
    assert P.bone_lengths(df, ["k"]).first()["bones"] is None


def test_hog_matches_slow_form():
    rng = np.random.default_rng(0)
    image = rng.uniform(size=(24, 32))
    np.testing.assert_allclose(I.hog(image[None], 9, 8, 2)[0], restated.hog_slow(image, 9, 8, 2), atol=1e-9)


def test_image_blocks_widths_and_values(spark):
    config = FeatureConfig()
    rng = np.random.default_rng(4)
    images = rng.uniform(size=(6, 48, 64)).astype(np.float32)
    colors = rng.uniform(size=(6, 48, 64, 3)).astype(np.float32)
    rows = [(1, i, images[i].ravel().tolist(), colors[i].ravel().tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "k int, i int, image array<float>, color array<float>")
    r = I.image_blocks(OrderedGroups(df, ["k"], ["i"], F.col("i")), config, name="depth", color=True).first()
    assert len(r["depth"]) == config.width("depth") == 7285
    assert len(r["depth_engineered"]) == config.width("depth_engineered") == 456
    first = np.array(r["depth"][:1260])
    np.testing.assert_allclose(first, restated.hog_slow(images[0].astype(float), 9, 8, 2), atol=1e-5)
    np.testing.assert_allclose(r["depth"][1260], images[0][:4, :4].mean(), atol=1e-5)
    np.testing.assert_allclose(r["depth_engineered"][0], images[:2, :12, :16].mean(), atol=1e-5)


def test_frames_are_thinned(spark):
    config = FeatureConfig(image_width=8, image_height=8, hog_cell=4, coarse_rows=4, coarse_columns=4, max_image_frames=3)
    rows = [(1, i, [float(i)] * 64) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, i int, image array<float>")
    r = I.image_blocks(OrderedGroups(df, ["k"], ["i"], F.col("i")), config, name="ir").first()
    hog = config.hog_size()
    # frames 0, 4 (half to even of 4.5) and 9 remain
    coarse = [r["ir"][s * (hog + 21) + hog] for s in range(5)]
    np.testing.assert_allclose(coarse, [0, 9, 13 / 3, np.std([0, 4, 9]), 4.5], atol=1e-5)


def test_resize_keeps_size_and_means():
    rng = np.random.default_rng(8)
    image = rng.integers(0, 255, size=(96, 128, 1)).astype(float)
    small = I._resize(image, 48, 64)
    assert small.shape == (48, 64, 1)
    assert abs(small.mean() - image.mean()) < 1
    same = I._resize(image[:48, :64], 48, 64)
    np.testing.assert_array_equal(same, image[:48, :64])


def test_filled_poses_read_no_frame_again_for_every_row(spark):
    """The skeleton blocks start from poses filled between neighbours; each frame ends at its own row."""
    rows = [(0, i, None if i % 4 == 1 else [float(i)] * 51, None if i % 4 == 1 else [0.5] * 17) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, i int, pose array<double>, scores array<double>")
    found = P.fill_pose_gaps(OrderedGroups(df, ["k"], ["i"], F.col("i"))).df
    assert "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["pose"][7] for r in found.orderBy("i").collect()] == [*map(float, range(9)), 8.0]


def test_filled_poses_of_a_cut_clip_read_no_slice_again(spark, small_groups):
    rows = [(0, i, [float(i)] * 51 if i in (2, 17) else None, [0.5] * 17 if i in (2, 17) else None) for i in range(23)]
    df = spark.createDataFrame(rows, "k int, i int, pose array<double>, scores array<double>")
    groups = OrderedGroups(df, ["k"], ["i"], F.col("i"))
    assert groups.is_cut
    found = P.fill_pose_gaps(groups).df
    assert "unboundedfollowing$()" not in found._jdf.queryExecution().executedPlan().toString()
    want = np.clip(np.arange(23.0), 2, 17)
    np.testing.assert_allclose([r["pose"][7] for r in found.orderBy("i").collect()], want)


def test_poses_of_uncut_clips_are_normalized_in_one_pass(spark):
    """No frame is filled ahead, only to count the torsos of clips that are known to be small."""
    groups = pose_groups(spark, poses(9), missing=(3, 8))
    assert not groups.is_cut
    spark.sparkContext.setJobGroup("normalized", "")
    P.pose_normalize(groups)
    started = list(spark.sparkContext.statusTracker().getJobIdsForGroup("normalized"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert started == []


@pytest.mark.parametrize("cut", [False, True])
def test_torsos_alone_are_those_of_filled_poses(spark, cut, request):
    if cut:
        request.getfixturevalue("small_groups")
    points = poses(19)
    rows = [(1, i, p.ravel().tolist(), [0.5] * 17) for i, p in enumerate(points)]
    rows[0] = rows[7] = rows[8] = rows[18] = None
    rows = [(1, i, None, None) if r is None else r for i, r in enumerate(rows)]
    rows[4], rows[12] = (1, 4, rows[4][2], None), (1, 12, rows[12][2][:30], [0.5] * 17)
    df = spark.createDataFrame(rows, "k int, i int, pose array<double>, scores array<double>")
    groups = OrderedGroups(df, ["k"], ["i"], F.col("i"))
    assert groups.is_cut == cut
    alone = P._filled_torsos(groups, "pose", "scores")
    filled = P.fill_pose_gaps(groups).df.select("k", P.torso_length(F.col("pose")).alias("_t"))
    found, want = ([r["_t"] for r in d.orderBy("_t").collect()] for d in (alone, filled))
    assert found == want and len(want) == 19 and any(v is None for v in want)
