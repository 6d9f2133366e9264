"""Preprocessing and classifiers as stages of ``pyspark.ml`` pipelines.

``clip_pipeline(blocks, algorithm).fit(rows)`` gives a ``PipelineModel`` that is saved, loaded and copied like any other, and its stages can stand
beside Spark's own. Which positions of ``features`` belong to which modality travels from stage to stage in the column's metadata.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from sensorframe.functions.columns import normalize_blocks
from sensorframe.operators.clips import DataError
from sensorframe.plans import models as M
from sensorframe.plans.prep import Preprocessor
from sensorframe.schema import FeatureConfig

GROUPS = "feature_groups"


class _Writer(MLWriter):
    """Params as Spark writes them, and the fitted part beside them."""

    def __init__(self, stage: "_FittedStage") -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.stage, path, spark)
        self.stage._save(spark, f"{path}/fitted")


class _Reader(MLReader):
    def __init__(self, kind: type) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> "_FittedStage":
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.kind(self.kind._load(spark, f"{path}/fitted"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class _FittedStage(Model, MLWritable, MLReadable):
    """A model that keeps its fitted part in ``fitted``."""

    def __init__(self, fitted: Any = None) -> None:
        super().__init__()
        self.fitted = fitted

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _BlockParams(Params):
    blocks = Param(Params._dummy(), "blocks", "array columns to prepare, in order", TypeConverters.toListString)
    config = Param(Params._dummy(), "config", "settings of the feature blocks, as JSON", TypeConverters.toString)

    def getBlocks(self) -> list[str]:
        return self.getOrDefault(self.blocks)

    def getConfig(self) -> str:
        return self.getOrDefault(self.config)


class BlockPreprocessor(Estimator, _BlockParams, DefaultParamsReadable, DefaultParamsWritable):
    """Imputes, scales and projects feature blocks and joins them in the vector column ``features``."""

    @keyword_only
    def __init__(self, *, blocks: Sequence[str] | None = None, config: str | None = None) -> None:
        super().__init__()
        self._setDefault(config=FeatureConfig().to_json())
        self._set(**{k: list(v) if k == "blocks" else v for k, v in self._input_kwargs.items() if v is not None})

    def setBlocks(self, value: Sequence[str]) -> "BlockPreprocessor":
        return self._set(blocks=list(value))

    def _fit(self, dataset: DataFrame) -> "BlockPreprocessorModel":
        blocks = normalize_blocks(self.getBlocks() if self.isDefined(self.blocks) else None)
        absent = [b for b in blocks if b not in dataset.columns]
        if absent:
            raise DataError(f"features lack blocks: {absent}")
        return self._copyValues(BlockPreprocessorModel(Preprocessor.fit(dataset, blocks)))


class BlockPreprocessorModel(_FittedStage, _BlockParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not json.loads(self.getConfig()).get("skeleton_layout"):
            raise DataError("the model was built from another joint order; fit it again")
        rows = self.fitted.transform(dataset)
        return rows.withMetadata("features", {GROUPS: json.dumps(self.fitted.groups)})

    def _save(self, spark: SparkSession, path: str) -> None:
        self.fitted.save(spark, path)

    @staticmethod
    def _load(spark: SparkSession, path: str) -> Preprocessor:
        return Preprocessor.load(spark, path)


class _ClassifierParams(Params):
    algorithm = Param(Params._dummy(), "algorithm", "name of a registered algorithm", TypeConverters.toString)
    parameters = Param(Params._dummy(), "parameters", "settings of the algorithm that differ from its defaults, as JSON", TypeConverters.toString)

    def getAlgorithm(self) -> str:
        return self.getOrDefault(self.algorithm)

    def getParameters(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.parameters))


class ClipClassifier(Estimator, _ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """A registered algorithm over ``features`` and ``label``; unknown algorithms and settings are refused when they are set."""

    @keyword_only
    def __init__(self, *, algorithm: str = "logistic_regression", parameters: Mapping[str, Any] | None = None) -> None:
        super().__init__()
        self._setDefault(algorithm="logistic_regression", parameters="{}")
        given = self._input_kwargs
        self.setAlgorithm(given.get("algorithm", "logistic_regression"), given.get("parameters"))

    def setAlgorithm(self, name: str, parameters: Mapping[str, Any] | None = None) -> "ClipClassifier":
        settings = dict(parameters or {})
        M.get_algorithm(name).resolved(settings)
        return self._set(algorithm=name, parameters=json.dumps(settings))

    def _fit(self, dataset: DataFrame) -> "ClipClassifierModel":
        algorithm = M.get_algorithm(self.getAlgorithm())
        groups = dataset.schema["features"].metadata.get(GROUPS)
        rows = dataset.select("features", "label").persist()
        try:
            fitted = algorithm.fit(rows, algorithm.resolved(self.getParameters()), json.loads(groups) if groups else None)
        finally:
            rows.unpersist()
        return self._copyValues(ClipClassifierModel(fitted))


class ClipClassifierModel(_FittedStage, _ClassifierParams):
    """Adds ``probability``, in the order of ``classes``, and ``prediction``."""

    @property
    def classes(self) -> list[int]:
        return self.fitted.classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.probabilities(dataset)

    def _save(self, spark: SparkSession, path: str) -> None:
        self.fitted.save(spark, path)

    @staticmethod
    def _load(spark: SparkSession, path: str) -> M.Fitted:
        return M.Fitted.load(spark, path)


def clip_pipeline(blocks: Sequence[str], algorithm: str = "logistic_regression", parameters: Mapping[str, Any] | None = None,
                  config: FeatureConfig = FeatureConfig()) -> Pipeline:
    """From feature blocks to predictions in two stages."""
    return Pipeline(stages=[BlockPreprocessor(blocks=list(blocks), config=config.to_json()), ClipClassifier(algorithm=algorithm, parameters=parameters)])
