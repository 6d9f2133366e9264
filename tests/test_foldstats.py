import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sensorframe.operators.clips import DataError
from sensorframe.plans import foldstats as P
from sensorframe.plans import prep as Q
from sensorframe.plans import sums as S

BLOCKS = ("imu", "skeleton", "imu_engineered")


def clips(spark, seed=0, gaps=True, rows=60, offset=1e6):
    """Blocks with missing numbers, a missing row, a constant and an unknown column, and a large common offset."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        imu = (rng.normal(size=7) * [1, 2, 3, 4, 5, 0, 7] + offset).tolist()
        skeleton = (rng.normal(size=5) + np.arange(5)).tolist()
        engineered = rng.normal(size=3).tolist()
        if gaps:
            imu = [None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else v for v in imu]
            engineered[1] = None
        out.append((i, i % 4 + 1, imu, skeleton, None if gaps and i % 13 == 0 else engineered))
    schema = "clip_id int, fold int, imu array<double>, skeleton array<double>, imu_engineered array<double>"
    return spark.createDataFrame(out, schema).repartition(5)


@pytest.mark.parametrize("gaps", [True, False])
def test_every_fold_as_if_fitted_apart(spark, gaps):
    rows = clips(spark, gaps=gaps).cache()
    sums = S.fold_sums(rows, BLOCKS)
    for fold in range(1, 5):
        train = rows.filter(F.col("fold") != fold)
        apart, joint = Q.Preprocessor.fit(train, BLOCKS), P.fold_preprocessor(sums, fold, train)
        assert joint.groups == apart.groups
        for block in BLOCKS:
            one, two = apart.reducers[block], joint.reducers[block]
            np.testing.assert_allclose(two.scaler.mean, one.scaler.mean, rtol=1e-9, atol=1e-9)
            np.testing.assert_allclose(two.scaler.scale, one.scaler.scale, rtol=1e-9, atol=1e-9)
            if one.pca is not None:
                np.testing.assert_allclose(two.pca.explainedVariance.toArray(), one.pca.explainedVariance.toArray(), atol=1e-9)
        # whole rows, up to the signs of projected directions
        given = lambda model: np.array([r[0] for r in model.transform(rows).orderBy("clip_id").select(vector_to_array("features")).collect()])
        a, b = given(apart), given(joint)
        strong = np.abs(a).max(axis=0) < 50
        np.testing.assert_allclose(np.abs(b[:, strong]), np.abs(a[:, strong]), atol=1e-6)
        assert strong.sum() >= 13


def test_sums_of_any_shift_add_up():
    rng = np.random.default_rng(4)
    values = rng.normal(size=(90, 6)) + 50
    values[rng.random(values.shape) < 0.15] = np.nan
    values[:, 5] = np.arange(90)
    whole = S.Sums.of(values, np.zeros(6), True)
    parts = [S.Sums.of(values[a : a + 30], rng.normal(size=6) * 40, True) for a in (0, 30, 60)]
    total = S.Sums.unpacked(60, (parts[0] + parts[1]).packed()) + parts[2]
    assert total.rows == 90
    np.testing.assert_allclose(total.covariance(), whole.covariance(), atol=1e-9)
    mean = np.nanmean(values, axis=0)
    z = (np.where(np.isnan(values), mean, values) - mean)
    z /= z.std(axis=0)
    np.testing.assert_allclose(total.covariance(), z.T @ z / 90, atol=1e-9)
    np.testing.assert_allclose(total.deviations(), z.std(axis=0), atol=1e-9)
    # parts without gaps carry fewer numbers and still add to parts with gaps
    assert S.Sums.of(values[:, 5:], np.zeros(1), True).mixed is None
    both = S.Sums.of(np.ones((4, 1)), np.zeros(1), True) + S.Sums.of(np.array([[np.nan], [3.0]]), np.ones(1), True)
    assert (both.rows, both.known[0], both.first[0], both.products[0, 0], both.pairs[0, 0]) == (6, 5, 7, 13, 5)


def test_wide_blocks_are_projected_by_their_own_fit(spark, monkeypatch):
    rows = clips(spark, gaps=False, offset=3).cache()
    sums = S.fold_sums(rows, BLOCKS, widest=6)
    assert sums["imu"][1].products is None and sums["skeleton"][1].products is not None
    train = rows.filter("fold <> 2")
    apart, joint = Q.Preprocessor.fit(train, BLOCKS), P.fold_preprocessor(sums, 2, train)
    np.testing.assert_allclose(joint.combined.scale, apart.combined.scale, atol=1e-6)


def test_one_pass(spark):
    before = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            before.add(batch.num_rows)
            yield batch

    rows = clips(spark)
    seen = rows.mapInArrow(counted, rows.schema)
    S.fold_sums(seen.select("*"), BLOCKS)
    assert before.value == 60


def test_rows_without_arrays(spark):
    """A clip whose block is missing counts as one of missing values."""
    df = spark.createDataFrame([([1.0, None],), (None,), ([3.0, None],), (None,)], "x array<double>").repartition(4)
    rows = Q.feature_stats(df, "x").orderBy("position").collect()
    assert [(r["rows"], r["known"], r["mean"]) for r in rows] == [(4, 2, 2.0), (4, 0, 0.0)]
    assert rows[0]["std"] == pytest.approx(0.5**0.5) and rows[1]["scale"] == 1.0
    with pytest.raises(Exception, match="sizes|numbers"):
        Q.feature_stats(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>"), "x").collect()


def test_nothing_to_fit(spark):
    with pytest.raises(DataError):
        S.fold_sums(clips(spark).withColumn("imu", F.lit(None).cast("array<double>")), BLOCKS)
    sums = S.fold_sums(clips(spark).filter("fold = 1"), BLOCKS)
    with pytest.raises(DataError):
        S.without(sums["imu"], 1)
