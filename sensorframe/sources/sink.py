"""Writers of manifests, feature tables, predictions, labels, reports and models."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.clips import DataError, require_none
from sensorframe.schema import COMPARISON_FIELDS, FeatureConfig
from sensorframe.sources.scan import FEATURE_VERSION, check_labels


def write_manifest(rows: DataFrame, path: str) -> None:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        rows.write.mode("overwrite").parquet(path)
    elif suffix == "csv":
        rows.select(*sorted(rows.columns)).write.mode("overwrite").option("header", True).csv(path)
    elif suffix == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise DataError(f"manifest must be parquet, csv or json: {path}")


def write_text(spark, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_feature_table(train: DataFrame, test: DataFrame, config: FeatureConfig, blocks: Sequence[str], path: str) -> None:
    """Both splits in one table partitioned by split, with its settings beside it."""
    for block in blocks:
        if (block in train.columns) != (block in test.columns):
            raise DataError(f"block {block} is present in one split only")
    require_none(train.filter("label IS NULL OR user IS NULL").select("clip_id"), "training clip without label or user")
    require_none(test.filter("submission_path IS NULL").select("clip_id"), "test clip without submission path")
    columns = ["clip_id", "label", "user", "submission_path", *blocks]

    def shaped(rows: DataFrame, split: str) -> DataFrame:
        for name, kind in (("label", "int"), ("user", "string"), ("submission_path", "string")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        return rows.select(F.lit(split).alias("split"), *columns)

    both = shaped(train, "train").unionByName(shaped(test, "test"))
    both.write.mode("overwrite").partitionBy("split").parquet(f"{path}/features")
    meta = {"version": FEATURE_VERSION, "config": json.loads(config.to_json()), "blocks": list(blocks)}
    write_text(train.sparkSession, json.dumps(meta, sort_keys=True), f"{path}/metadata")


def write_submission(rows: DataFrame, path: str, place: str = "place") -> None:
    """Path and prediction in test-index order; part files keep the order of the range sort."""
    ordered = rows.orderBy(place).select("path", F.col("prediction").cast("int").alias("prediction"))
    ordered.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(rows: DataFrame, path: str, identifier: str) -> None:
    """Predictions keyed by submission path or by clip."""
    if identifier not in ("path", "clip_id"):
        raise DataError(f"identifier must be path or clip_id: {identifier}")
    source = "submission_path" if identifier == "path" else "clip_id"
    rows.select(F.col(source).alias(identifier), F.col("action_id").alias("prediction")).write.mode(
        "overwrite"
    ).option("header", True).csv(path)


def write_oof(rows: DataFrame, path: str) -> None:
    """Out-of-fold table of the selected candidate, one row per clip (``crossval.out_of_fold``)."""
    rows.write.mode("overwrite").parquet(path)


def write_report(spark, report: dict, path: str) -> None:
    write_text(spark, json.dumps(report, sort_keys=True), path)


def write_comparison(rows: DataFrame, path: str) -> None:
    """Run comparison with its nine columns, best macro F1 first."""
    rows.orderBy(F.desc_nulls_last("macro_f1")).select(*COMPARISON_FIELDS).write.mode("overwrite").option(
        "header", True
    ).csv(path)


def write_label_table(rows: DataFrame, path: str, allowed: DataFrame | None = None, place: str = "place") -> None:
    """Label table the reader accepts, in its own order."""
    if not {"path", "prediction"} <= set(rows.columns):
        raise DataError("label table needs path and prediction")
    check_labels(rows, allowed)
    columns = [c for c in rows.columns if c != place]
    rows.orderBy(place).select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
