import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer

from sensorframe.operators.clips import DataError
from sensorframe.plans import estimators as E
from sensorframe.plans import models as M

BLOCKS = ("imu", "skeleton", "imu_engineered")


def bundle(spark):
    rng = np.random.default_rng(11)
    wide = lambda n, label: (rng.normal(size=n) + label).tolist()
    rows = [(f"c{i}", i % 2 * 5 + 1, f"user{i % 4}", wide(8, i % 2), wide(8, i % 2), wide(4, i % 2)) for i in range(24)]
    return spark.createDataFrame(rows, "clip_id string, label int, user string, imu array<double>, skeleton array<double>, imu_engineered array<double>")


def predicted(model, rows):
    return {r["clip_id"]: (r["prediction"], [round(p, 9) for p in r["probability"]]) for r in model.transform(rows).collect()}


@pytest.mark.parametrize("algorithm, parameters", [("logistic_regression", {"C": 0.5}), ("late_fusion", {"weighting": "stacked", "C": 0.1})])
def test_a_pipeline_is_fitted_saved_loaded_and_used(spark, tmp_path, algorithm, parameters):
    rows = bundle(spark)
    model = E.clip_pipeline(BLOCKS, algorithm, parameters).fit(rows)
    assert isinstance(model, PipelineModel)
    plain = M.ClipModel.fit(rows, BLOCKS, algorithm, parameters)
    want = {r["clip_id"]: (r["prediction"], [round(p, 9) for p in r["probability"]]) for r in plain.predict(rows).collect()}
    assert predicted(model, rows) == want
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert predicted(again, rows) == want
    assert [type(s) for s in again.stages] == [E.BlockPreprocessorModel, E.ClipClassifierModel]
    assert [s.uid for s in again.stages] == [s.uid for s in model.stages]
    assert again.stages[1].getParameters() == parameters and again.stages[0].getBlocks() == list(BLOCKS) and again.stages[1].classes == [1, 6]


def test_an_unfitted_pipeline_is_saved_and_loaded(spark, tmp_path):
    path = str(tmp_path / "pipeline")
    E.clip_pipeline(BLOCKS, "late_fusion", {"C": 0.2}).save(path)
    again = Pipeline.load(path)
    assert again.getStages()[1].getAlgorithm() == "late_fusion" and again.getStages()[1].getParameters() == {"C": 0.2}
    rows = bundle(spark)
    assert predicted(again.fit(rows), rows) == predicted(E.clip_pipeline(BLOCKS, "late_fusion", {"C": 0.2}).fit(rows), rows)


def test_stages_stand_beside_those_of_spark(spark):
    rows = bundle(spark)
    only = SQLTransformer(statement="SELECT * FROM __THIS__ WHERE user <> 'user3'")
    model = Pipeline(stages=[only, *E.clip_pipeline(("imu",)).getStages()]).fit(rows)
    out = model.transform(rows).selectExpr("cast(prediction as double) as prediction", "cast(label as double) as label")
    assert out.count() == 18 and MulticlassClassificationEvaluator().evaluate(out) > 0.6


def test_unknown_settings_are_refused(spark):
    for bad in ({"algorithm": "forest"}, {"parameters": {"D": 1}}, {"algorithm": "late_fusion", "parameters": {"weighting": "none"}}):
        with pytest.raises(ValueError):
            E.ClipClassifier(**bad)
    with pytest.raises(TypeError):
        E.ClipClassifier(depth=3)
    with pytest.raises(DataError):
        E.clip_pipeline(("depth",)).fit(bundle(spark))
    with pytest.raises(ValueError):
        E.clip_pipeline(("sound",)).fit(bundle(spark))
    # without the first stage the second does not know the modalities
    prepared = E.BlockPreprocessor(blocks=["imu"]).fit(bundle(spark)).transform(bundle(spark)).withMetadata("features", {})
    with pytest.raises(ValueError):
        E.ClipClassifier(algorithm="late_fusion").fit(prepared)


def test_another_joint_order_is_refused(spark):
    model = E.BlockPreprocessor(blocks=["imu"], config='{"skeleton_layout": ""}').fit(bundle(spark))
    with pytest.raises(DataError):
        model.transform(bundle(spark))
