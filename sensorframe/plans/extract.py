"""From sensor rows to the feature table: chosen blocks only, one read per modality."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe import skew
from sensorframe.functions.columns import normalize_blocks
from sensorframe.operators import clips as K
from sensorframe.operators import frames as I
from sensorframe.operators import pose as P
from sensorframe.operators import signal as S
from sensorframe.operators.sampling import manifest_order
from sensorframe.plans import crossval as X
from sensorframe.plans import models as M
from sensorframe.schema import FeatureConfig
from sensorframe.skew import OrderedGroups
from sensorframe.sources import blockstore, scan


def null_block(config: FeatureConfig, block: str):
    return F.array_repeat(F.lit(None).cast("float"), config.width(block))


def extract_blocks(
    clips: DataFrame,
    config: FeatureConfig,
    blocks: Sequence[str] | None = None,
    *,
    depth: OrderedGroups | None = None,
    infrared: OrderedGroups | None = None,
    imu: OrderedGroups | None = None,
    skeleton: DataFrame | None = None,
) -> DataFrame:
    """Clips with one array column per requested block.

    ``depth`` and ``infrared`` are image series, ``imu`` sensor series, ``skeleton`` resampled poses.
    Only modalities with a requested block are touched. A clip without usable files gets NULL values.
    """
    wanted = normalize_blocks(blocks)
    tables: dict[str, DataFrame] = {}
    for name, groups, color in (("depth", depth, True), ("ir", infrared, False)):
        base, engineered = name in wanted, f"{name}_engineered" in wanted
        if (base or engineered) and groups is not None:
            found = I.image_blocks(groups, config, name=name, base=base, color=color)
            tables[name] = found if engineered else found.drop(f"{name}_engineered")
    if imu is not None and ("imu" in wanted or "imu_engineered" in wanted):
        numbered = S.numbered(imu)
        if "imu" in wanted:
            tables["imu"] = S.imu_features(numbered, bins=config.temporal_bins)
        if "imu_engineered" in wanted:
            tables["imu_engineered"] = S.imu_engineered(numbered, config)
    if skeleton is not None:
        if "skeleton" in wanted:
            tables["skeleton"] = P.skeleton_base(skeleton, "clip_id")
        if "skeleton_engineered" in wanted:
            tables["skeleton_engineered"] = P.skeleton_engineered(skeleton, "clip_id", config)
    rows = clips
    for found in tables.values():
        rows = rows.join(found, "clip_id", "left")
    have = set(rows.columns)
    filled = [
        (F.coalesce(F.col(b), null_block(config, b)) if b in have else null_block(config, b)).alias(b) for b in wanted
    ]
    return rows.select(*clips.columns, *filled)


def extract_split(spark, root: str, clips: DataFrame, config: FeatureConfig, blocks: Sequence[str] | None = None, *,
                  split: str = "train") -> DataFrame:
    """Feature blocks of one extracted split; ``root`` is the folder above the modality folders.

    Rows of other clips are left out where they are read, and no image of theirs is opened.
    """
    wanted = normalize_blocks(blocks)
    only = clips.select("clip_id").distinct()
    folder = (lambda m: f"{root}/{m}") if split == "train" else (lambda m: f"{root}/*/{m}")
    need = lambda *names: any(n in wanted for n in names)
    parts: dict[str, Any] = {}
    if need("depth", "depth_engineered"):
        parts["depth"] = I.frame_groups(I.scan_frames(spark, folder("Depth_Color"), config, split=split, color=True, only=only))
    if need("ir", "ir_engineered"):
        parts["infrared"] = I.frame_groups(I.scan_frames(spark, folder("IR"), config, split=split, only=only))
    if need("imu", "imu_engineered"):
        parts["imu"] = S.imu_groups(scan.scan_imu(spark, folder("IMU"), split).join(only, "clip_id", "left_semi"))
    if need("skeleton", "skeleton_engineered"):
        frames = scan.scan_skeleton(spark, folder("Skeleton"), split).join(only, "clip_id", "left_semi")
        # both skeleton blocks read these few rows per clip
        parts["skeleton"] = skew.checkpointed(P.skeleton_samples(frames, config))
    return extract_blocks(clips, config, wanted, **parts)


def refresh_feature_table(spark, path: str, config: FeatureConfig, splits: dict[str, tuple[str, DataFrame]], blocks: Sequence[str] | None = None) -> dict:
    """Bring a stored table to the clips of {split: (root, clips)} and at least these blocks; returns the clips extracted per (split, block).

    Only missing (clip, block) pairs are extracted, so adding a block reads its modality alone, and adding clips only theirs.
    """
    def extracted(split: str, clips: DataFrame, due: Sequence[str]) -> DataFrame:
        return extract_split(spark, splits[split][0], clips, config, due, split=split)

    together = None
    for split, (_, clips) in splits.items():
        for name, kind in blockstore.CLIP_COLUMNS.items():
            if name not in clips.columns:
                clips = clips.withColumn(name, F.lit(None).cast(kind))
        one = clips.select(F.lit(split).alias("split"), *blockstore.CLIP_COLUMNS)
        together = one if together is None else together.unionByName(one)
    return blockstore.refresh(spark, path, together, blocks, config, extracted)


def index_split(spark, root: str, split: str, *, deep: bool = False) -> DataFrame:
    """Manifest of one extracted split, ordered for display."""
    manifest = K.build_manifest(scan.scan_split(spark, root, split)).withColumns(
        {"source_kind": F.lit("directory"), "source_path": F.lit(root)})
    if deep:
        manifest = manifest.join(K.content_quality(scan.scan_content(spark, root, split)), ["split", "clip_id"], "left")
    keys = {f"_key{i}": key for i, key in enumerate(manifest_order())}
    return K.with_issues(manifest).withColumns(keys).orderBy(*keys).drop(*keys)


def clip_index(spark, root: str, split: str, clip_id: str) -> DataFrame:
    """Ordered members of one clip, from its own folders alone."""
    return K.member_index(scan.scan_clip(spark, root, split, clip_id))


def select_training_clips(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """Complete training clips with label and participant, and the counts of every selection step."""
    flags = K.discovery_flags(scan.scan_split(spark, root, "train"), scan.scan_imu_files(spark, f"{root}/data/IMU"))
    return K.complete_case(flags), K.discovery_funnel(flags)


def select_test_clips(spark, root: str, index: str) -> DataFrame:
    """Test clips in submission order; a listed clip without files is an error, a missing modality is not."""
    known = scan.scan_split(spark, root, "test").select("clip_id").distinct()
    found, missing = K.attach_test_index(scan.read_test_index(spark, index), known)
    K.require_none(missing, "test clip not found")
    return found.select("clip_id", F.col("path").alias("submission_path"), "place")


def feature_table_current(stored: DataFrame, train_ids: DataFrame, test_ids: DataFrame, blocks: Sequence[str]) -> bool:
    """Whether a stored table covers exactly these clips and at least these blocks."""
    if not set(blocks) <= set(stored.columns):
        return False
    for split, ids in (("train", train_ids), ("test", test_ids)):
        if not K.id_differences(stored.filter(F.col("split") == split), ids).isEmpty():
            return False
    return True


def train(features: DataFrame, blocks: Sequence[str], algorithm: str, candidates=None, *, folds: int = 5, repeats: int = 1,
          seed: int = 42, selection_metric: str = "macro_f1", config: FeatureConfig = FeatureConfig()):
    """Validate, choose parameters, fit on all training clips; returns model, report and out-of-fold rows."""
    chosen = M.get_algorithm(algorithm)
    settings = list(candidates) if candidates is not None else list(chosen.candidates())
    rows = features.filter("split = 'train'")
    K.require_blocks(rows, blocks)
    K.require_finite(rows, blocks)
    rows = rows.persist()
    try:
        found = X.cross_validate(rows, blocks, chosen, settings, folds=folds, repeats=repeats, seed=seed, selection_metric=selection_metric)
        report = X.validation_report(found, chosen, settings, selection_metric=selection_metric, seed=seed)
        model = M.ClipModel.fit(rows, blocks, algorithm, report["selected_parameters"], config)
        report["training_clips"] = rows.count()
        report["feature_blocks"] = list(blocks)
        report["raw_feature_dimensions"] = {b: config.width(b) for b in blocks}
        for entry in report["folds"]:
            entry["training_clips"] = report["training_clips"] - entry["validation_clips"]
        report["class_counts"] = {str(r["label"]): r["clips"] for r in K.class_counts(rows).orderBy("label").collect()}
    finally:
        rows.unpersist()
    test = features.filter("split = 'test'")
    report["test_feature_health"] = {
        r["block"]: {k: r[k] for k in ("complete_rows", "partial_rows", "all_missing_rows")}
        for r in K.feature_health(test, blocks).collect()
    }
    report["test_clips"] = test.count()
    return model, report, found

