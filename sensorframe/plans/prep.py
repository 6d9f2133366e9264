"""Preprocessing of feature blocks: mean imputation, scaling, projection and assembly."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.columns import finite
from sensorframe.operators.clips import DataError
from sensorframe.plans.sums import Sums, fold_sums, summed
from sensorframe.schema import PCA_COMPONENTS


PARALLEL_FITS = 4


def block_stats(rows: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """Mean of the known values, scale and filled deviation of every position of the array columns.

    Every task adds up whole arrays and sends one row a block. A missing value is filled with the mean, which keeps the mean and
    shrinks the deviation; a missing array is one of missing values.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sums = Sums.unpacked(row["rows"], row["sums"])
                mean, deviation, scale = sums.mean_and_scale()
                width = len(mean)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["block"]] * width, pa.string()), pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, sums.rows)),
                    pa.array(sums.known.astype(np.int64)), pa.array(mean), pa.array(deviation), pa.array(scale),
                ], ["block", "position", "rows", "known", "mean", "std", "scale"])

    return summed(rows, blocks, F.lit(0)).mapInArrow(spread, "block string, position int, rows long, known long, mean double, std double, scale double")


def feature_stats(rows: DataFrame, block: str) -> DataFrame:
    return block_stats(rows, [block]).drop("block")


def constant_array(values: Sequence[float]) -> Column:
    """Numbers as one constant, however many there are; Spark folds the text when it plans."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


@dataclass
class Scaler:
    """Fitted means and scales of one block; as wide as the block."""

    mean: list[float]
    scale: list[float]

    @classmethod
    def of(cls, sums: Sums) -> "Scaler":
        mean, _, scale = sums.mean_and_scale()
        return cls(mean.tolist(), scale.tolist())

    @classmethod
    def fit_all(cls, rows: DataFrame, blocks: Sequence[str]) -> dict[str, "Scaler"]:
        """Scalers of several blocks in one job; what is collected is as wide as the blocks."""
        return {b: cls.of(by_fold[0]) for b, by_fold in fold_sums(rows.withColumn("_all", F.lit(0)), blocks, "_all", 0).items()}

    @classmethod
    def fit(cls, rows: DataFrame, block: str) -> "Scaler":
        return cls.fit_all(rows, [block])[block]

    def apply(self, block: str) -> Column:
        mean, scale = constant_array(self.mean), constant_array(self.scale)
        whole = F.coalesce(F.col(block), F.array_repeat(F.lit(None).cast("float"), len(self.mean)))
        centred = F.zip_with(whole, mean, lambda v, m: F.coalesce(finite(v.cast("double")), m) - m)
        return F.zip_with(centred, scale, lambda v, s: v / s)


@dataclass
class Reducer:
    """Imputation and scaling of one block, then projection for base blocks."""

    scaler: Scaler
    pca: PCAModel | None = None

    @classmethod
    def fit(cls, rows: DataFrame, block: str, limit: int, scaler: Scaler | None = None) -> "Reducer":
        scaler = scaler or Scaler.fit(rows, block)
        wanted = PCA_COMPONENTS.get(block)
        if wanted is None:
            return cls(scaler)
        count = min(wanted, limit, len(scaler.mean))
        vectors = rows.select(array_to_vector(scaler.apply(block)).alias("v"))
        return cls(scaler, PCA(k=count, inputCol="v", outputCol="o").fit(vectors))

    @property
    def width(self) -> int:
        return self.pca.getK() if self.pca is not None else len(self.scaler.mean)

    def apply(self, rows: DataFrame, block: str) -> DataFrame:
        """Replace the block by its reduced array."""
        if self.pca is None:
            return rows.withColumn(block, self.scaler.apply(block))
        vectors = rows.withColumn("v", array_to_vector(self.scaler.apply(block)))
        return self.pca.transform(vectors).withColumn(block, vector_to_array("o")).drop("v", "o")


@dataclass
class Preprocessor:
    """Reducers of all blocks in order and the scaler of their concatenation."""

    reducers: dict[str, Reducer]
    combined: Scaler
    groups: dict[str, list[int]] = field(default_factory=dict)

    @classmethod
    def fit(cls, rows: DataFrame, blocks: Sequence[str]) -> "Preprocessor":
        count = rows.count()
        scalers = Scaler.fit_all(rows, blocks)
        # independent Spark jobs, run side by side
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            fit = inheritable_thread_target(rows.sparkSession)(lambda b: Reducer.fit(rows, b, count, scalers[b]))
            reducers = dict(zip(blocks, pool.map(fit, blocks)))
        model = cls(reducers, Scaler([], []), feature_groups({b: r.width for b, r in reducers.items()}))
        model.combined = Scaler.fit(model._joined(rows), "features")
        return model

    def _joined(self, rows: DataFrame) -> DataFrame:
        missing = [b for b in self.reducers if b not in rows.columns]
        if missing:
            raise DataError(f"features lack model blocks: {missing}")
        for block, reducer in self.reducers.items():
            rows = reducer.apply(rows, block)
        return rows.withColumn("features", F.concat(*self.reducers))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with the vector column ``features`` in place of the blocks."""
        joined = self._joined(rows)
        vectors = joined.withColumn("features", array_to_vector(self.combined.apply("features")))
        return vectors.drop(*self.reducers)

    def save(self, spark, path: str) -> None:
        from sensorframe.sources.sink import write_text

        state = {"blocks": list(self.reducers), "combined": vars(self.combined), "groups": self.groups, "scalers": {}, "pca": []}
        for block, reducer in self.reducers.items():
            state["scalers"][block] = vars(reducer.scaler)
            if reducer.pca is not None:
                reducer.pca.write().overwrite().save(f"{path}/pca_{block}")
                state["pca"].append(block)
        write_text(spark, json.dumps(state), f"{path}/preprocessor")

    @classmethod
    def load(cls, spark, path: str) -> "Preprocessor":
        state = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/preprocessor").collect()))
        reducers = {
            b: Reducer(Scaler(**state["scalers"][b]), PCAModel.load(f"{path}/pca_{b}") if b in state["pca"] else None)
            for b in state["blocks"]
        }
        return cls(reducers, Scaler(**state["combined"]), state["groups"])


def feature_groups(widths: dict[str, int]) -> dict[str, list[int]]:
    """Positions of each modality in the concatenated features."""
    groups: dict[str, list[int]] = {}
    start = 0
    for block, width in widths.items():
        groups.setdefault(block.split("_", 1)[0], []).extend(range(start, start + width))
        start += width
    return groups
