import numpy as np
import pytest
from pyspark.sql import functions as F

import restated
from sensorframe import skew
from sensorframe.functions.arrays import dynamics
from sensorframe.operators import signal as S
from sensorframe.skew import OrderedGroups

SIZES = (1, 2, 3, 4, 5, 9, 23)


def series(gaps=False, constant=False):
    rng = np.random.default_rng(3)
    out = {}
    for n in SIZES:
        v = np.full(n, 2.5) if constant else rng.normal(size=n).round(4) * 50
        out[n] = [None if gaps and n > 2 and i % 3 == 0 else float(x) for i, x in enumerate(v)]
    return out


def groups(spark, data):
    rows = [(k, i, v) for k, values in data.items() for i, v in enumerate(values)]
    return OrderedGroups(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], ["i"], F.col("i"))


def check_signal(spark, data):
    found = {r["k"]: r for r in S.signal_features(groups(spark, data), ["v"]).collect()}
    for k, values in data.items():
        np.testing.assert_allclose([found[k][c] for c in S.signal_columns()], restated.signal(values), atol=1e-9)


def test_signal_features(spark):
    check_signal(spark, series())
    check_signal(spark, series(constant=True))


def test_signal_features_cut(spark, small_groups):
    assert groups(spark, series()).is_cut
    check_signal(spark, series())


@pytest.mark.parametrize("cut", [False, True])
def test_fill_and_resample(spark, cut, request):
    if cut:
        request.getfixturevalue("small_groups")
    data = series(gaps=True)
    done = S.fill_gaps(groups(spark, data), ["v"])
    rows = {}
    for r in done.df.orderBy("k", "i").collect():
        rows.setdefault(r["k"], []).append(r["v"])
    for k, values in data.items():
        np.testing.assert_allclose(rows[k], restated.filled(values), atol=1e-9)
    for r in S.resample(done, ["v"], 16).collect():
        np.testing.assert_allclose(r["samples"], restated.resampled(rows[r["k"]], 16), atol=1e-9)


def test_all_missing_channel_has_no_features(spark):
    data = {1: [None, None], 2: [1.0, None]}
    done = S.fill_gaps(groups(spark, data), ["v"])
    assert [r["k"] for r in S.resample(done, ["v"], 4).collect()] == [2]
    assert [r["k"] for r in S.circular_features(groups(spark, data), ["v"]).collect()] == [2]


@pytest.mark.parametrize("cut", [False, True])
def test_circular(spark, cut, request):
    if cut:
        request.getfixturevalue("small_groups")
    data = series(gaps=True)
    found = {r["k"]: r for r in S.circular_features(groups(spark, data), ["v"]).collect()}
    for k, values in data.items():
        np.testing.assert_allclose([found[k][c] for c in S.circular_columns()], restated.circular(values), atol=1e-9)


@pytest.mark.parametrize("cut", [False, True])
def test_rotation_restarts_at_zero(spark, cut, request):
    if cut:
        request.getfixturevalue("small_groups")
    rng = np.random.default_rng(1)
    q = rng.normal(size=(20, 4)).round(3)
    q[7] = (1, 0, 0, 0)
    q[8] = (0, 1, 0, 0)
    rows = [(1, i, *map(float, v)) for i, v in enumerate(q)]
    df = spark.createDataFrame(rows, "k int, i int, a double, b double, c double, d double")
    turned = S.relative_rotation(OrderedGroups(df, ["k"], ["i"], F.col("i")), ["a", "b", "c", "d"])
    got = turned.df.orderBy("i").collect()
    relative, step = restated.rotation(q)
    np.testing.assert_allclose([[r[c] for c in S.ROTATION[:4]] for r in got], relative, atol=1e-9)
    np.testing.assert_allclose([r["step"] for r in got], step, atol=1e-6)


def test_quaternion_without_length_is_left_out(spark):
    df = spark.createDataFrame([(1, i, 0.0, 0.0, 0.0, 0.0) for i in range(3)], "k int, i int, a double, b double, c double, d double")
    assert S.quaternion_features(OrderedGroups(df, ["k"], ["i"], F.col("i")), ["a", "b", "c", "d"]).count() == 0


def test_dynamics_of_constant_and_wave():
    flat = dynamics(np.full((1, 64), 3.0))
    np.testing.assert_allclose(flat, 0, atol=1e-12)
    wave = dynamics(np.sin(2 * np.pi * 5 * np.arange(64) / 64)[None, :])[0]
    assert wave[6] == pytest.approx(5 / 32)
    assert wave[8] == pytest.approx(0, abs=1e-9)


def test_vector_shape_small_groups(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(12, 3))
    rows = [(1, *map(float, p)) for p in points] + [(2, 1.0, 2.0, 3.0)]
    found = {r["k"]: r for r in S.vector_shape(spark.createDataFrame(rows, "k int, x double, y double, z double"), ["k"], "x", "y", "z").collect()}
    np.testing.assert_allclose([found[1][f"eig{i}"] for i in range(3)], np.linalg.eigvalsh(np.cov(points.T)), atol=1e-9)
    assert all(found[2][c] == 0 for c in S.SHAPE_COLUMNS)


@pytest.mark.parametrize("cut", [False, True])
def test_quantiles(spark, cut, request):
    if cut:
        request.getfixturevalue("small_groups")
    rng = np.random.default_rng(5)
    data = {1: rng.integers(0, 4, 50).tolist(), 2: rng.normal(size=31).tolist(), 3: [7.0]}
    rows = [(k, float(v)) for k, values in data.items() for v in values]
    found = skew.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", (0.0, 0.1, 0.5, 0.93, 1.0), "q")
    for r in found.collect():
        np.testing.assert_allclose(r["q"], np.quantile(data[r["k"]], (0.0, 0.1, 0.5, 0.93, 1.0)), atol=1e-9)


def test_one_group_with_most_rows_is_spread(spark, small_groups):
    rows = [(1 if i % 3 else i, i, float(i % 5)) for i in range(600)]
    groups_ = OrderedGroups(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], ["i"], F.col("i"))
    sizes = groups_.df.groupBy("k", skew.SLICE).count().agg(F.max("count")).first()[0]
    assert groups_.is_cut and sizes < 40
    got = groups_.scan(p=skew.position(), s=skew.running_sum(F.col("v"))).df.filter("k = 1").orderBy("i").collect()
    want = [v for k, _, v in rows if k == 1]
    assert [r["p"] for r in got] == list(range(len(want)))
    np.testing.assert_allclose([r["s"] for r in got], np.cumsum(want))


def test_no_frame_is_read_again_for_every_row(spark):
    """A frame from the current row to the last costs the square of a group."""
    rows = spark.createDataFrame([(0, i, None if i % 3 else float(i)) for i in range(9)], "k int, i int, v double")
    groups = OrderedGroups(rows, ["k"], ["i"], F.col("i")).scan(near=skew.next_valid(F.col("v")))
    plan = groups.df._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    assert [r["near"] for r in groups.df.orderBy("i").collect()] == [0, 3, 3, 3, 6, 6, 6, None, None]


def test_no_slice_is_read_again_for_every_slice(spark, small_groups):
    """The same for the slices that a large group is cut into."""
    rows = spark.createDataFrame([(0, i, float(i) if i in (0, 17) else None) for i in range(23)], "k int, i int, v double")
    groups = OrderedGroups(rows, ["k"], ["i"], F.col("i"))
    assert groups.is_cut
    groups = groups.scan(near=skew.next_valid(F.col("v")))
    assert "unboundedfollowing$()" not in groups.df._jdf.queryExecution().executedPlan().toString()
    assert [r["near"] for r in groups.df.orderBy("i").collect()] == [0] + [17] * 17 + [None] * 5


def test_a_value_at_the_mean_is_not_below_it():
    rows = np.array([[0.8, 0.1, 0.8, -0.6, -0.6], [0.5, 0.3, 0.5, 0.1, 0.1], [1.1, 0.4, 1.1, -0.3, -0.3], [0.8, 0.5, 0.8, 0.2, 0.2]])
    np.testing.assert_allclose(dynamics(rows)[:, 2], 0.25)


@pytest.mark.parametrize("way", [1, -1])
def test_half_turns_stay_as_they_are(spark, way):
    data = {k: [k * 0.37 + way * 180.0 * i if i in (0, 7) else None for i in range(8)] for k in range(40)}
    found = S.circular_features(groups(spark, data), ["v"]).collect()
    np.testing.assert_allclose([r["unwrapped_range"] for r in found], 3.5)


def test_rotation_reads_no_frame_again_for_every_row(spark):
    """Gaps of four channels are filled before turns are told; each frame ends at its own row."""
    rows = spark.createDataFrame([(0, i, *[None if (i + c) % 3 == 0 else float(i + c) for c in range(4)]) for i in range(9)], "k int, i int, a double, b double, c double, d double")
    found = S.relative_rotation(OrderedGroups(rows, ["k"], ["i"], F.col("i")), ["a", "b", "c", "d"]).df
    assert "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.filter("rel_w is null").count() == 0
