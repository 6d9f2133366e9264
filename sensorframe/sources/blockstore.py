"""Feature tables that grow: every block of every split is a partition of its own.

Asked for more blocks or clips, a table is widened in place: the missing (clip, block) pairs are found by comparing ids alone, only they are extracted,
and only the partitions they belong to are written again. Blocks that are not asked for stay.

Layout: ``clips/split=…`` has a row for each clip, ``blocks/split=…/block=…`` a row (clip_id, values) for each clip, ``metadata`` the settings.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe import skew
from sensorframe.functions.columns import normalize_blocks
from sensorframe.operators.clips import DataError, require_none
from sensorframe.schema import BLOCKS, FeatureConfig
from sensorframe.sources.sink import FEATURE_VERSION, write_text

CLIP_COLUMNS = {"clip_id": "string", "label": "int", "user": "string", "submission_path": "string"}
_VALUES = "clip_id string, values array<float>, split string, block string"

#: Gives blocks of the clips of a split: (split, clips, blocks) to clips with an array column per block.
Extract = Callable[[str, DataFrame, Sequence[str]], DataFrame]


def _metadata(spark: SparkSession, path: str) -> dict | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/metadata").collect()))


def _values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_VALUES).parquet(f"{path}/blocks")


def compatible(meta: dict | None, config: FeatureConfig) -> bool:
    """Whether a table has this version, layout and configuration."""
    return bool(meta) and meta.get("layout") == "blocks" and meta["version"] == FEATURE_VERSION and meta["config"] == json.loads(config.to_json())


def missing_pairs(spark: SparkSession, path: str, clips: DataFrame, blocks: Sequence[str], config: FeatureConfig) -> DataFrame:
    """(split, clip_id, block) that the table does not have; all of them without a compatible table. Feature values are not read."""
    asked = clips.select("split", "clip_id", F.explode(F.array(*map(F.lit, blocks))).alias("block"))
    meta = _metadata(spark, path)
    if not compatible(meta, config) or not meta["blocks"]:
        return asked
    return asked.join(_values(spark, path).select("split", "clip_id", "block"), ["split", "clip_id", "block"], "left_anti")


def _alike(missing: DataFrame) -> list[tuple[str, list[str]]]:
    """(split, blocks) whose missing clips are the same; at most splits times blocks."""
    sums = missing.groupBy("split", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("clip_id").cast("decimal(38,0)")).alias("s"),
                                                 F.bit_xor(F.xxhash64(F.lit(1), "clip_id")).alias("x")).collect()
    groups: dict[tuple, list[str]] = {}
    for r in sums:
        groups.setdefault((r["split"], r["n"], r["s"], r["x"]), []).append(r["block"])
    return [(key[0], sorted(found, key=BLOCKS.index)) for key, found in sorted(groups.items(), key=lambda g: (g[0][0], g[1]))]


def _shaped(clips: DataFrame) -> DataFrame:
    for name, kind in CLIP_COLUMNS.items():
        if name not in clips.columns:
            clips = clips.withColumn(name, F.lit(None).cast(kind))
    return clips.select("split", *[F.col(n).cast(k).alias(n) for n, k in CLIP_COLUMNS.items()])


def refresh(spark: SparkSession, path: str, clips: DataFrame, blocks: Sequence[str] | None, config: FeatureConfig, extract: Extract) -> dict[tuple[str, str], int]:
    """Bring a table to exactly these clips (split, clip_id, label, user, submission_path) and at least these blocks.

    Returns how many clips were extracted for every (split, block). A table of another configuration or version is built anew, with the blocks
    it had as well. Everything is extracted before the first partition is replaced, and the settings are written last.
    """
    wanted = normalize_blocks(blocks)
    meta = _metadata(spark, path)
    had = [b for b in (meta or {}).get("blocks", []) if b in BLOCKS]
    usable = compatible(meta, config)
    all_blocks = normalize_blocks(sorted({*wanted, *had}))
    clips = skew.checkpointed(_shaped(clips))
    require_none(clips.groupBy("split", "clip_id").count().filter("count > 1").select("clip_id"), "clip listed twice")
    require_none(clips.filter("split = 'train' AND (label IS NULL OR user IS NULL)").select("clip_id"), "training clip without label or user")
    require_none(clips.filter("split = 'test' AND submission_path IS NULL").select("clip_id"), "test clip without submission path")
    missing = skew.checkpointed(missing_pairs(spark, path, clips, all_blocks, config))
    written = None
    for split, group in _alike(missing):
        due = missing.filter((F.col("split") == split) & (F.col("block") == group[0])).select("split", "clip_id")
        found = extract(split, clips.join(due, ["split", "clip_id"], "left_semi").drop("split"), group)
        each = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).cast("array<float>").alias("values")) for b in group])).alias("p")
        part = skew.checkpointed(found.select("clip_id", each).select("clip_id", "p.values", F.lit(split).alias("split"), "p.block"))
        written = part if written is None else written.unionByName(part)
    counts = {(r["split"], r["block"]): r["count"] for r in missing.groupBy("split", "block").count().collect()}
    if written is not None:
        # the rest of a partition that is written again: its clips that are still asked for
        if usable and had:
            old = _values(spark, path).join(F.broadcast(missing.select("split", "block").distinct()), ["split", "block"], "left_semi")
            written = written.unionByName(old.join(clips.select("split", "clip_id"), ["split", "clip_id"], "left_semi").select(written.columns))
        mode = "dynamic" if usable else "static"
        written.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("split", "block").parquet(f"{path}/blocks")
    clips.write.mode("overwrite").partitionBy("split").parquet(f"{path}/clips")
    state = {"version": FEATURE_VERSION, "layout": "blocks", "config": json.loads(config.to_json()), "blocks": list(all_blocks)}
    write_text(spark, json.dumps(state, sort_keys=True), f"{path}/metadata")
    return counts


def read(spark: SparkSession, path: str, config: FeatureConfig, blocks: Sequence[str] | None = None) -> DataFrame:
    """(split, clip_id, label, user, submission_path, blocks): only the partitions of the blocks asked for are read, in one shuffle."""
    meta = _metadata(spark, path)
    if not compatible(meta, config):
        raise DataError(f"no feature table of this version and configuration: {path}")
    wanted = normalize_blocks(meta["blocks"] if blocks is None else blocks)
    lacking = [b for b in wanted if b not in meta["blocks"]]
    if lacking:
        raise DataError(f"feature table lacks blocks: {lacking}")
    clips = spark.read.schema(", ".join(f"{n} {k}" for n, k in CLIP_COLUMNS.items()) + ", split string").parquet(f"{path}/clips")
    rows = _values(spark, path).filter(F.col("block").isin(*wanted)).groupBy("split", "clip_id").agg(
        *[F.first(F.when(F.col("block") == b, F.col("values")), ignorenulls=True).alias(b) for b in wanted])
    return clips.join(rows, ["split", "clip_id"], "left").select("split", *CLIP_COLUMNS, *wanted)
