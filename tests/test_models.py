import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sensorframe.operators.clips import DataError
from sensorframe.plans import crossval as X
from sensorframe.plans import models as M
from sensorframe.plans import prep as Q


def bundle(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(16):
        label = i % 2
        wide = lambda n: (rng.normal(size=n) + label).tolist()
        rows.append((f"c{i}", label * 5 + 1, f"user{i % 4 if i < 8 else (i + 1) % 4}", wide(8), wide(8), wide(4)))
    return spark.createDataFrame(
        rows, "clip_id string, label int, user string, imu array<double>, skeleton array<double>, imu_engineered array<double>")


def test_imputer_and_scaler(spark):
    df = spark.createDataFrame([([1.0, None, 5.0, float("nan")],), ([3.0, None, 5.0, 2.0],)], "x array<double>")
    s = Q.Scaler.fit(df, "x")
    assert s.mean == [2.0, 0.0, 5.0, 2.0] and s.scale == [1.0, 1.0, 1.0, 1.0]
    assert [r[0] for r in df.select(s.apply("x")).collect()] == [[-1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    missing = spark.createDataFrame([(None,)], "x array<double>")
    assert missing.select(s.apply("x")).first()[0] == [0.0] * 4


def test_pca_is_capped_and_centred(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(rng.normal(size=20).tolist(),) for _ in range(4)], "imu array<double>")
    reducer = Q.Reducer.fit(df, "imu", 4)
    assert reducer.width == 4
    got = np.array([r[0] for r in reducer.apply(df, "imu").collect()])
    x = np.array([r[0] for r in df.collect()])
    z = (x - x.mean(0)) / x.std(0)
    np.testing.assert_allclose(got @ got.T, z @ z.T, atol=1e-6)
    assert Q.Reducer.fit(df.withColumnRenamed("imu", "imu_engineered"), "imu_engineered", 4).pca is None


def test_groups():
    assert Q.feature_groups({"depth": 2, "imu": 1, "depth_engineered": 2}) == {"depth": [0, 1, 3, 4], "imu": [2]}


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [((rng.normal(size=4) + (i % 2)).tolist(), i % 2 + 3) for i in range(8)]
    df = spark.createDataFrame(rows, "x array<double>, label int")
    return df.withColumn("features", array_to_vector("x")), rows


def test_logistic_reaches_the_optimum(spark):
    df, _ = vectors(spark)
    rng = np.random.default_rng(5)
    rows = [(rng.normal(size=4).tolist(), int(i % 3 if i < 24 else 0)) for i in range(36)]
    df = spark.createDataFrame(rows, "x array<double>, label int").withColumn("features", array_to_vector("x"))
    fitted = M.get_algorithm("logistic_regression").fit(df, {"C": 0.5})
    model = fitted.models["combined"]
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    counts = np.bincount(y)
    weight = len(y) / (3 * counts[y])
    scores = x @ w.T + b
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gap = (p - np.eye(3)[y]) * weight[:, None]
    np.testing.assert_allclose(0.5 * gap.T @ x + w, 0, atol=1e-4)


def test_late_fusion(spark):
    df, rows = vectors(spark)
    algorithm = M.get_algorithm("late_fusion")
    fitted = algorithm.fit(df, {"weighting": "stacked"}, {"depth": [0, 1], "imu": [2, 3], "skeleton": []})
    assert set(fitted.models) == {"depth", "imu", "combined"}
    out = fitted.probabilities(df).collect()
    for r in out:
        assert sum(r["probability"]) == pytest.approx(1.0)
        assert r["prediction"] == [3, 4][int(np.argmax(r["probability"]))]
    plain = algorithm.fit(df, {"weighting": "motion"}, {"depth": [0, 1], "imu": [2, 3]})
    assert set(plain.models) == {"depth", "imu"}
    for bad in ({"weighting": "none"}, {"depth": 1}):
        with pytest.raises(ValueError):
            algorithm.fit(df, bad, {"depth": [0, 1]})
    with pytest.raises(ValueError):
        algorithm.fit(df, {}, None)
    with pytest.raises(ValueError):
        algorithm.fit(df, {}, {"sound": [0]})


def test_registry():
    assert M.available_algorithms() == ["late_fusion", "logistic_regression"]
    assert [c["C"] for c in M.get_algorithm("logistic_regression").candidates()] == [0.01, 0.1, 1.0, 10.0]
    assert len(list(M.get_algorithm("late_fusion").candidates())) == 4
    with pytest.raises(ValueError):
        M.register(M.LogisticAlgorithm())
    with pytest.raises(ValueError):
        M.register(M.Algorithm())
    with pytest.raises(ValueError):
        M.get_algorithm("forest")
    with pytest.raises(ValueError):
        M.get_algorithm("logistic_regression").resolved({"D": 1})


@pytest.mark.parametrize("cut", [False, True])
def test_folds_keep_groups_whole(spark, cut, request):
    if cut:
        request.getfixturevalue("small_groups")
    rng = np.random.default_rng(7)
    rows = [(f"u{i % 23}", int(rng.integers(0, 4))) for i in range(800)]
    df = spark.createDataFrame(rows, "user string, label int")
    folds = X.group_folds(df, 5, 42)
    assert folds.count() == 23 and folds.select("user").distinct().count() == 23
    sizes = {r["fold"]: r["count"] for r in df.join(folds, "user").groupBy("fold").count().collect()}
    assert set(sizes) == {1, 2, 3, 4, 5} and max(sizes.values()) < 2.2 * min(sizes.values())
    again = {r["user"]: r["fold"] for r in X.group_folds(df, 5, 42).collect()}
    assert again == {r["user"]: r["fold"] for r in folds.collect()}
    with pytest.raises(DataError):
        X.group_folds(df, 24, 42)


def shares(folds, vectors):
    """Sum of squared class shares of the folds; the best deal has the least."""
    total = sum(np.array(v) for v in vectors.values())
    sums = {}
    for g, f in folds.items():
        sums[f] = sums.get(f, 0) + np.array(vectors[g]) / total
    return sum(float((s**2).sum()) for s in sums.values()), sums


def mixed_participants(seed, groups, classes):
    """Participants with most clips in a few classes and a share of others."""
    rng = np.random.default_rng(seed)
    return {f"u{g:04d}": np.maximum(rng.multinomial(rng.integers(5, 60), rng.dirichlet(np.full(classes, 0.5))), 0) for g in range(groups)}


def clips_of(spark, vectors):
    rows = [(g, c) for g, v in vectors.items() for c, n in enumerate(v) for _ in range(int(n))]
    return spark.createDataFrame(rows, "user string, label int").repartition(3)


def plain_folds(vectors, folds, seed):
    """The rule, one group after the other."""
    import hashlib

    order = sorted(vectors, key=lambda g: (-int(sum(vectors[g])), hashlib.md5(f"{g}:{seed}".encode()).hexdigest(), g))
    sizes = sum(np.array(v) for v in vectors.values())
    present = [c for c in range(len(sizes)) if sizes[c]]
    weights = [(1000 * int(sizes.sum()) // int(sizes[c])) ** 2 for c in present]
    totals, found = [[0] * len(present) for _ in range(folds)], {}
    for g in order:
        v = [int(vectors[g][c]) for c in present]
        costs = [(sum(a * b * w for a, b, w in zip(t, v, weights)), sum(t), f) for f, t in enumerate(totals)]
        f = min(costs)[2]
        totals[f] = [a + b for a, b in zip(totals[f], v)]
        found[g] = f + 1
    return found


@pytest.mark.parametrize("seed, groups, classes, folds", [(1, 25, 6, 5), (2, 60, 12, 4), (3, 200, 40, 5)])
def test_folds_keep_class_shares(spark, seed, groups, classes, folds):
    """No fold is further from its share of a class than the two largest contributions to that class."""
    vectors = mixed_participants(seed, groups, classes)
    found = {r["user"]: r["fold"] for r in X.group_folds(clips_of(spark, vectors), folds, seed).collect()}
    assert found == plain_folds(vectors, folds, seed)
    table = np.array(list(vectors.values()))
    largest = np.sort(table, axis=0)[-2:].sum(axis=0)
    for f in range(1, folds + 1):
        own = table[[found[g] == f for g in vectors]].sum(axis=0)
        assert (np.abs(own - table.sum(axis=0) / folds) <= largest).all()
    rng = np.random.default_rng(seed)
    random = [shares({g: int(rng.integers(folds)) for g in vectors}, vectors)[0] for _ in range(200)]
    assert shares(found, vectors)[0] < min(random)


@pytest.mark.parametrize("seed", range(3))
def test_folds_are_near_the_best_of_all(spark, seed):
    import itertools

    vectors = mixed_participants(seed + 20, 11, 4)
    found = {r["user"]: r["fold"] for r in X.group_folds(clips_of(spark, vectors), 2, 0).collect()}
    best = min(shares(dict(zip(vectors, deal)), vectors)[0] for deal in itertools.product((1, 2), repeat=11) if len(set(deal)) == 2)
    # the least conceivable is a half for each of four classes
    assert shares(found, vectors)[0] <= best + 0.12


def test_slices_of_groups_are_matched(spark, monkeypatch):
    vectors = mixed_participants(9, 120, 5)
    monkeypatch.setattr(X, "SLICE_GROUPS", 25)
    found = {r["user"]: r["fold"] for r in X.group_folds(clips_of(spark, vectors), 4, 3).collect()}
    assert set(found) == set(vectors) and set(found.values()) == {1, 2, 3, 4}
    _, sums = shares(found, vectors)
    assert all((np.abs(s - 0.25) < 0.08).all() for s in sums.values())


def test_cross_validation(spark, tmp_path):
    rows = bundle(spark).cache()
    algorithm = M.get_algorithm("logistic_regression")
    blocks, candidates = ("imu", "skeleton", "imu_engineered"), [{"C": 0.1}, {"C": 1.0}]
    found = X.cross_validate(rows, blocks, algorithm, candidates, folds=2, repeats=2)
    assert found.count() == 16 * 2 * 2
    assert found.groupBy("candidate", "repeat", "clip_id").count().filter("count > 1").isEmpty()
    assert found.groupBy("candidate", "repeat", "user").agg(F.count_distinct("fold").alias("f")).filter("f > 1").isEmpty()
    sums = found.select(F.aggregate("probability", F.lit(0.0), lambda a, v: a + v).alias("s"))
    assert sums.filter("abs(s - 1) > 1e-6").isEmpty()
    report = X.validation_report(found, algorithm, candidates)
    assert report["classes"] == [1, 6] and report["cv_repeats"] == 2 and len(report["folds"]) == 4
    assert sum(map(sum, report["confusion_matrix"])) == 16
    best = max(report["aggregate_metrics"], key=lambda a: a["metrics"]["macro_f1"])
    assert report["selected_parameters"] == best["parameters"]
    assert len(best["repeat_metrics"]) == 2 and sum(g["clips"] for g in report["per_group_metrics"]) == 16
    assert sorted(u for f in report["folds"] if f["repeat"] == 1 for u in f["validation_users"]) == [f"user{i}" for i in range(4)]
    path = str(tmp_path / "groups")
    named = X.validation_report(found, algorithm, candidates, groups_path=path)
    kept = spark.read.parquet(named["per_group_metrics"]).collect()
    assert {r["user"]: r["clips"] for r in kept} == {g["group"]: g["clips"] for g in report["per_group_metrics"]}
    for given, told in zip(named["folds"], report["folds"]):
        assert sorted(r["user"] for r in spark.read.parquet(given["validation_users"]).collect()) == told["validation_users"]
    for bad in ({"folds": 1}, {"repeats": 0}, {"selection_metric": "loss"}):
        with pytest.raises(ValueError):
            X.cross_validate(rows, blocks, algorithm, candidates, **bad)
    with pytest.raises(ValueError):
        X.cross_validate(rows, blocks, algorithm, [])


def test_class_missing_from_a_fold(spark):
    rows = [(i, f"u{i % 3}", 9 if i % 3 == 0 and i < 6 else i % 2, [float(i), float(i % 2)]) for i in range(24)]
    df = spark.createDataFrame(rows, "clip_id int, user string, label int, imu_engineered array<double>")
    found = X.cross_validate(df, ["imu_engineered"], M.get_algorithm("logistic_regression"), [{"C": 1.0}], folds=3)
    assert found.count() == 24 and found.filter("size(probability) <> 3").isEmpty()


def test_model_of_other_layout_is_refused(spark, tmp_path):
    from sensorframe.sources.sink import write_text

    rows = bundle(spark)
    model = M.ClipModel.fit(rows, ("imu",), "logistic_regression")
    path = str(tmp_path / "m")
    model.config.pop("skeleton_layout")
    model.save(spark, path)
    with pytest.raises(DataError):
        M.ClipModel.load(spark, path)
    assert write_text is not None


def test_pca_query_has_every_vector(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    found = entry.queries()["fit_pca"](spark, folder)
    assert found.count() == spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert "embeddings" in entry.oracle_sql()["fit_pca"]
