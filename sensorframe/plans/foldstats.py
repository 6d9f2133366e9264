"""Preprocessing of every fold from sums over all folds, without looking at a clip again."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCAModel
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame

from sensorframe.plans.prep import Preprocessor, Reducer, Scaler, feature_groups
from sensorframe.plans.sums import Sums, without
from sensorframe.schema import PCA_COMPONENTS


def projection(spark, sums: Sums, count: int) -> tuple[PCAModel, np.ndarray]:
    """The leading directions of filled and scaled values, and the deviations of what they give.

    The sign of a direction makes its largest number positive; a direction without variance has the deviation 0.
    """
    values, vectors = np.linalg.eigh(sums.covariance())
    chosen = np.argsort(-values, kind="stable")[:count]
    values = np.where(values > 1e-12 * max(values.max(), 1e-300), values, 0.0)
    directions, strengths = vectors[:, chosen], values[chosen]
    largest = directions[np.abs(directions).argmax(axis=0), np.arange(len(chosen))]
    directions = directions * np.where(largest < 0, -1.0, 1.0)
    sc = spark.sparkContext
    matrix = _py2java(sc, DenseMatrix(len(directions), len(chosen), directions.ravel(order="F")))
    shares = _py2java(sc, DenseVector(strengths / max(values.sum(), 1e-300)))
    found = PCAModel(spark._jvm.org.apache.spark.ml.feature.PCAModel(f"pca_{uuid.uuid4().hex}", matrix, shares))
    found._set(k=len(chosen), inputCol="v", outputCol="o")
    return found, np.sqrt(strengths)


def fold_preprocessor(sums: dict[str, dict[int, Sums]], fold: int, train: DataFrame) -> Preprocessor:
    """What ``Preprocessor.fit`` makes of the rows outside a fold, from the sums; only a projected block without products looks at ``train``."""
    reducers, scales = {}, []
    for block, by_fold in sums.items():
        own = without(by_fold, fold)
        scaler, wanted = Scaler.of(own), PCA_COMPONENTS.get(block)
        if wanted is None:
            reducers[block] = Reducer(scaler)
            scales.append(own.deviations())
        elif own.products is None:
            reducers[block] = Reducer.fit(train, block, own.rows, scaler)
            shares = np.array(reducers[block].pca.explainedVariance.toArray())
            scales.append(np.sqrt(np.where(shares > 1e-12, shares, 0.0) * (own.deviations() ** 2).sum()))
        else:
            pca, deviations = projection(train.sparkSession, own, min(wanted, own.rows, len(scaler.mean)))
            reducers[block] = Reducer(scaler, pca)
            scales.append(deviations)
    spread = np.concatenate(scales)
    combined = Scaler([0.0] * len(spread), np.where(spread <= 1e-12, 1.0, spread).tolist())
    return Preprocessor(reducers, combined, feature_groups({b: r.width for b, r in reducers.items()}))
