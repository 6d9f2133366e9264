"""Readers: file listings, sensor files, mappings, predictions, labels, reports, feature tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe import skew
from sensorframe.functions.columns import (
    ACTION_PATTERN,
    FRAME_PATTERN,
    IGNORED_NAMES,
    TIMESTAMP_PATTERN,
    known_time,
    normalize_blocks,
    parse_time,
    path_tail,
    safe_float,
    text_flag,
)
from sensorframe.operators.clips import DataError, require_none
from sensorframe.schema import BLOCKS, IMU_CHANNELS, IMU_DEVICES, MODALITIES, PEOPLE, FeatureConfig
from sensorframe.skew import OrderedGroups

# ---------------------------------------------------------------- listings


def scan_members(spark: SparkSession, root: str | Sequence[str]) -> DataFrame:
    """Path and size of every file below root (or several); file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length")


def relative_path(path: Column, anchor: str) -> Column:
    """Path from its last folder named ``anchor`` on."""
    return F.regexp_extract(path, rf"(?:^|/)({anchor}/.*)$", 1)


def kept(path: Column) -> Column:
    """Whether no part of the path is hidden or belongs to the operating system."""
    names = "|".join(n.replace(".", r"\.") for n in IGNORED_NAMES)
    return ~path.rlike(rf"(^|/)(\.|__MACOSX(/|$)|({names})$)")


def drop_ignored(members: DataFrame, path: str = "path") -> DataFrame:
    return members.filter(kept(F.col(path)))


def parse_members(members: DataFrame, split: str, path: str = "path", size: str = "length") -> DataFrame:
    """Clip, modality and file attributes of every path of the given split's layout."""
    parts = F.split(F.col(path), "/")
    rows = drop_ignored(members, path)
    kinds = "|".join(MODALITIES)
    # Folder layout of the two splits.
    if split == "train":
        rows = rows.filter(F.col(path).rlike(rf"^HAR/data/({kinds})/[^/]+/[^/]+/[^/]+/[^/]"))
        modality, action, user, trial = parts[2], parts[3], parts[4], parts[5]
        clip = F.concat_ws("/", action, user, trial)
        action_id = F.regexp_extract(action, ACTION_PATTERN, 1).try_cast("int")
    elif split == "test":
        rows = rows.filter(F.col(path).rlike(rf"^small_model_track_test/SM_test_[^/]*/({kinds})/[^/]"))
        modality, clip = parts[2], parts[1]
        action = user = trial = F.lit(None).cast("string")
        action_id = F.lit(None).cast("int")
    else:
        raise ValueError(f"unknown split: {split}")
    name = F.element_at(parts, -1)
    stamp = F.regexp_extract(name, TIMESTAMP_PATTERN, 1)
    frame = F.regexp_extract(name, FRAME_PATTERN, 1)
    return rows.select(
        F.lit(split).alias("split"),
        clip.alias("clip_id"),
        modality.alias("modality"),
        F.col(path).alias("member_path"),
        F.col(size).cast("long").alias("size"),
        action_id.alias("action_id"),
        action.alias("action_name"),
        user.alias("user"),
        trial.alias("trial"),
        F.when(stamp != "", stamp).alias("timestamp"),
        F.when(frame != "", frame.try_cast("long")).alias("frame_index"),
    )


def scan_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Parsed members of one extracted split."""
    anchor = "HAR" if split == "train" else "small_model_track_test"
    listed = scan_members(spark, root).withColumn("path", relative_path(F.col("path"), anchor))
    return parse_members(listed, split)


def scan_clip(spark: SparkSession, root: str, split: str, clip_id: str) -> DataFrame:
    """Parsed members of one clip; only the clip's own folders are listed."""
    folder = (lambda m: f"{root}/data/{m}/{clip_id}") if split == "train" else (lambda m: f"{root}/{clip_id}/{m}")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    settings = spark._jsc.hadoopConfiguration()
    there = [f for f in map(folder, MODALITIES) if path_of(f).getFileSystem(settings).exists(path_of(f))]
    anchor = "HAR" if split == "train" else "small_model_track_test"
    if not there:
        none = spark.createDataFrame([], "path string, length long")
        return parse_members(none, split)
    listed = scan_members(spark, there).withColumn("path", relative_path(F.col("path"), anchor))
    return parse_members(listed, split).filter(F.col("clip_id") == clip_id)


def clip_of(path: Column, split: str) -> Column:
    """Clip id of a sensor file's full path."""
    anchor = "HAR" if split == "train" else "small_model_track_test"
    parts = F.split(relative_path(path, anchor), "/")
    return F.concat_ws("/", parts[3], parts[4], parts[5]) if split == "train" else parts[1]


# ---------------------------------------------------------------- sensor files

_IMU_TEXT = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(18)])


def read_csv_text(spark: SparkSession, path, fields: int) -> DataFrame:
    """CSV rows below a header as text, with file, block and line order."""
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(fields)])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(path)
    )
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def scan_imu(spark: SparkSession, path, split: str = "train", devices: Sequence[str] = IMU_DEVICES) -> DataFrame:
    """Inertial rows with 18 channels; rows without a known device or six finite base values are dropped.

    A time that cannot be read becomes the running number of the clip's kept rows.
    """
    raw = read_csv_text(spark, path, 18)
    device = F.trim(F.split("f1", r"\(", 2)[0])
    numbers = [safe_float(F.col(f"f{i}")) for i in range(2, 18)]
    base, optional = numbers[:6], numbers[6:]
    norm = lambda parts: F.sqrt(sum(p * p for p in parts))
    values = [*base, norm(base[:3]), norm(base[3:]), *optional]
    rows = raw.select(
        clip_of(F.col("path"), split).alias("clip_id"),
        device.alias("device"),
        F.col("f0").alias("time_text"),
        "path", "block", "line",
        *[v.alias(name) for v, name in zip(values, IMU_CHANNELS)],
    ).filter(F.col("device").isin(*devices))
    rows = rows.dropna(subset=list(IMU_CHANNELS[:6]))
    order = [path_tail(F.col("path")), F.col("path"), F.col("block"), F.col("line")]
    groups = OrderedGroups(rows, ["clip_id"], order, None)
    rows = groups.scan(_seq=skew.position()).rows()
    known = known_time(F.col("time_text")).isNotNull()
    return rows.select(
        "clip_id", "device",
        parse_time(F.col("time_text"), F.col("_seq")).alias("ts"),
        F.coalesce(known, F.lit(False)).alias("time_known"),
        "path", F.struct("block", "line").alias("line"), *IMU_CHANNELS,
    )


def scan_imu_files(spark: SparkSession, path, split: str = "train") -> DataFrame:
    """Data rows of at least two fields per (clip, file, device)."""
    raw = read_csv_text(spark, path, 2).filter(F.col("f1").isNotNull())
    return raw.groupBy(
        F.lit(split).alias("split"), clip_of(F.col("path"), split).alias("clip_id"), "path",
        F.trim(F.split("f1", r"\(", 2)[0]).alias("device"),
    ).agg(F.count(F.lit(1)).alias("data_rows"))


def _whole_files(spark: SparkSession, path, pattern: str) -> DataFrame:
    text = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path)
    )
    return text.select("value", F.col("_metadata.file_path").alias("path"))


def scan_skeleton(spark: SparkSession, path, split: str = "train") -> DataFrame:
    """One row per frame file with the people whose 17 keypoints are all finite."""
    files = _whole_files(spark, path, "*.json")
    parsed = F.from_json("value", PEOPLE, {"allowNonNumericNumbers": "true"})
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(
        F.lit(split).alias("split"), clip_of(F.col("path"), split).alias("clip_id"), "path",
        F.nullif(F.regexp_extract(name, TIMESTAMP_PATTERN, 1), F.lit("")).alias("timestamp"),
        F.nullif(F.regexp_extract(name, FRAME_PATTERN, 1), F.lit("")).try_cast("long").alias("frame_index"),
        F.coalesce(F.get_json_object("value", "$[0]").isNotNull() | (F.regexp_replace("value", r"\s", "") == "[]"),
                   F.lit(False)).alias("is_list"),
        F.col("value"), parsed.alias("people"),
    )
    return rows.withColumn("people", valid_people(F.col("people")))


def valid_people(people: Column) -> Column:
    """People with 17 finite 3-D points; missing or odd-sized scores count as 1."""
    whole = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = F.filter(
        people,
        lambda p: (F.size(p["keypoints"]) == 17)
        & F.forall(p["keypoints"], lambda k: (F.size(k) == 3) & F.forall(k, whole)),
    )
    ones = F.array_repeat(F.lit(1.0), 17)
    return F.coalesce(
        F.transform(
            good,
            lambda p: F.struct(
                p["keypoints"].alias("points"),
                F.when(F.size(p["keypoint_scores"]) == 17, p["keypoint_scores"]).otherwise(ones).alias("scores"),
            ),
        ),
        F.array().cast("array<struct<points:array<array<double>>,scores:array<double>>>"),
    )


def scan_radar(spark: SparkSession, path) -> DataFrame:
    """Detections with frame number; bad numbers become 0, rows without a frame are dropped."""
    raw = (
        spark.read.option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .schema("timestamp string, frame string, x string, y string, z string, v string, snr string, noise string")
        .csv(path)
    )
    frame = safe_float(F.col("frame")).try_cast("int")
    zeroed = lambda c: F.coalesce(F.trim(F.col(c)).try_cast("double"), F.lit(0.0))
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"),
        frame.alias("frame"), zeroed("x").alias("x"), zeroed("y").alias("y"), zeroed("z").alias("z"),
        zeroed("v").alias("velocity"), zeroed("snr").alias("snr"),
    ).filter(F.col("frame").isNotNull())


def radar_frames(points: DataFrame, keys: Sequence[str] = ("path",), order: str = "line") -> DataFrame:
    """Detections grouped by frame: one row each, numbered within its frame in file order."""
    groups = OrderedGroups(points, [*keys, "frame"], [order], F.col(order))
    rows = groups.scan(point=skew.position()).rows()
    return rows.select(*keys, "frame", "point", "x", "y", "z", "velocity", "snr")


def scan_content(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    """Data rows of every inertial and radar file and people of every skeleton file."""
    anchor = "HAR" if split == "train" else "small_model_track_test"
    base = f"{root}/data" if split == "train" else f"{root}/*"
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
        .text([f"{base}/IMU", f"{base}/Radar"])
        .select(F.col("_metadata.file_path").alias("path"), F.lit(1).alias("one"))
    )
    listed = scan_members(spark, root).filter(F.lower("path").endswith(".csv")).select("path")
    counted = lines.groupBy("path").agg(F.count("one").alias("lines"))
    scheme = r"^file:/+"
    tidy = lambda df: df.withColumn("path", F.regexp_replace("path", scheme, "/"))
    csv = tidy(listed).join(tidy(counted), "path", "left").select(
        "path",
        F.greatest(F.lit(0), F.coalesce("lines", F.lit(0)) - 1).cast("long").alias("data_rows"),
        F.lit(None).cast("long").alias("people"), F.lit(False).alias("bad_json"),
    )
    poses = _whole_files(spark, [f"{base}/Skeleton"], "*.json")
    parsed = F.from_json("value", "array<string>")
    pose = tidy(poses).select(
        "path", F.lit(None).cast("long").alias("data_rows"),
        F.size(parsed).cast("long").alias("people"), (parsed.isNull()).alias("bad_json"),
    )
    rows = csv.unionByName(pose)
    parts = F.split(relative_path(F.col("path"), anchor), "/")
    return rows.select(
        F.lit(split).alias("split"), clip_of(F.col("path"), split).alias("clip_id"),
        parts[2].alias("modality"), "data_rows", "people", "bad_json",
    )


# ---------------------------------------------------------------- small tables


def check_mapping(mapping: DataFrame) -> DataFrame:
    """Class mapping with integer unique ids and nonempty names, else an error."""
    if not {"action_id", "action_name"} <= set(mapping.columns):
        raise DataError("class mapping needs action_id and action_name")
    number = F.trim(F.col("action_id").cast("string"))
    rows = mapping.select(
        F.when(number.rlike(r"^[+-]?\d+$"), number.try_cast("int")).alias("action_id"),
        F.trim(F.col("action_name").cast("string")).alias("action_name"),
    )
    state = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("action_id").isNull()).alias("bad ids"),
        F.count_if(F.coalesce("action_name", F.lit("")) == "").alias("missing names"),
        (F.count("action_id") - F.count_distinct("action_id")).alias("duplicate ids"),
    ).first().asDict()
    if not state.pop("rows"):
        raise DataError("class mapping is empty")
    broken = {k: v for k, v in state.items() if v}
    if broken:
        raise DataError(f"class mapping: {broken}")
    return rows


def read_class_mapping(spark: SparkSession, path: str) -> DataFrame:
    return check_mapping(spark.read.option("header", True).csv(path))


def prediction_rows(raw: DataFrame) -> DataFrame:
    """Clip id, class id and state of every prediction row of a path- or clip-keyed table."""
    columns = set(raw.columns)
    if "prediction" not in columns or not ({"clip_id", "path"} & columns):
        raise DataError("predictions need prediction and clip_id or path")
    given = F.trim(F.coalesce(F.col("prediction").cast("string"), F.lit("")))
    if "clip_id" in columns:
        tidy = F.regexp_replace(F.translate(F.trim("clip_id"), "\\", "/"), r"^/+|/+$", "")
        clip = F.when(tidy != "", tidy)
        path = F.coalesce(F.nullif(F.trim("path"), F.lit("")), clip) if "path" in columns else clip
    else:
        clip, path = path_tail(F.col("path")), F.trim("path")
    number = F.when(given.rlike(r"^[+-]?\d+$"), given.try_cast("int"))
    return raw.select(
        clip.alias("clip_id"), path.alias("submission_path"), number.alias("action_id"), given.alias("_given"),
    )


def check_predictions(raw: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good predictions, row counters, and every broken rule."""
    rows = prediction_rows(raw)
    counters = rows.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("_given") == "").alias("blank_predictions")
    )
    filled = rows.filter(F.col("_given") != "").join(mapping, "action_id", "left")
    repeats = filled.groupBy("clip_id").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1 AND clip_id IS NOT NULL")
    reason = (
        F.when(F.col("clip_id").isNull(), "empty identifier")
        .when(F.col("action_id").isNull(), "not an integer")
        .when(F.col("action_name").isNull(), "unknown action")
    )
    broken = filled.select("clip_id", reason.alias("violation")).filter("violation IS NOT NULL")
    broken = broken.unionByName(repeats.select("clip_id", F.lit("duplicate clip").alias("violation")))
    good = filled.filter(reason.isNull()).select("clip_id", "action_id", "action_name", "submission_path")
    return good, counters, broken


def read_predictions(spark: SparkSession, path: str, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated predictions and row counters of a CSV file."""
    raw = spark.read.option("header", True).csv(path)
    good, counters, broken = check_predictions(raw, mapping)
    require_none(broken, "prediction table")
    return good, counters


def check_labels(rows: DataFrame, allowed: DataFrame | None = None) -> None:
    """Label tables need unique nonempty paths and blank or known integer predictions."""
    path = F.trim(F.coalesce("path", F.lit("")))
    given = F.trim(F.coalesce(F.col("prediction").cast("string"), F.lit("")))
    require_none(rows.filter(path == "").select("prediction"), "label table has an empty path")
    require_none(
        rows.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1"),
        "label table has duplicate paths",
    )
    filled = rows.select(path.alias("path"), given.alias("given")).filter("given <> ''")
    require_none(filled.filter(~F.col("given").rlike(r"^[+-]?\d+$")), "label must be an integer")
    if allowed is not None:
        ids = filled.withColumn("action_id", F.col("given").try_cast("int"))
        require_none(ids.join(allowed, "action_id", "left_anti"), "unknown action")


def in_file_order(rows: DataFrame) -> DataFrame:
    """Number rows 0, 1, ... in file order; needs path, block and line."""
    groups = OrderedGroups(rows, [], ["path", "block", "line"], None)
    return groups.scan(place=skew.position()).rows().drop("path", "block", "line")


def _with_file_order(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_label_table(spark: SparkSession, path: str, allowed: DataFrame | None = None) -> DataFrame:
    """Label rows with their place in the file; ragged rows are refused."""
    lines = in_file_order(_with_file_order(spark.read.text(path)).filter("value <> ''"))
    lines = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    header = lines.filter("place = 0").first()
    names = header["value"].split(",") if header else []
    if not {"path", "prediction"} <= set(names):
        raise DataError("label table needs path and prediction")
    body = lines.filter("place > 0").withColumn("place", F.col("place") - 1)
    # separators outside quotes tell an empty field from an absent one
    fields = F.regexp_count("value", F.lit(r',(?=(?:[^"]*"[^"]*")*[^"]*$)')) + 1
    require_none(body.filter(fields != len(names)).select("value"), "label row does not match the header")
    shape = ", ".join(f"f{i} string" for i in range(len(names)))
    parsed = body.withColumn("_r", F.from_csv("value", shape))
    rows = parsed.select(
        "place", *[F.coalesce(F.col("_r")[f"f{i}"], F.lit("")).alias(n) for i, n in enumerate(names)]
    )
    check_labels(rows, allowed)
    return rows


def read_test_index(spark: SparkSession, path: str) -> DataFrame:
    """Submission rows in order with the clip each path ends in."""
    raw = spark.read.option("header", True).csv(path)
    if "path" not in raw.columns or raw.isEmpty():
        raise DataError("test index needs a path column and rows")
    named = _with_file_order(raw.withColumnRenamed("path", "_given"))
    return test_index(in_file_order(named).withColumnRenamed("_given", "path"))


def test_index(rows: DataFrame) -> DataFrame:
    return rows.withColumn("clip_id", path_tail(F.col("path")))


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """One row per validation report with its folder name; unreadable files carry an error."""
    from pyspark.errors import AnalysisException

    def load(pattern: str) -> DataFrame:
        return spark.read.option("wholetext", True).text(pattern)

    try:
        files = load(f"{root}/*/validation.json")
    except AnalysisException:
        files = load(f"{root}/validation.json")
    files = files.select("value", F.col("_metadata.file_path").alias("report"))
    good = F.try_parse_json("value")
    return files.select(
        "report",
        F.element_at(F.split("report", "/"), -2).alias("artifact_name"),
        "value",
        F.when(good.isNull(), F.lit("not valid JSON")).alias("error"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest by file suffix; true/false text columns become nullable booleans."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        rows = spark.read.parquet(path)
    elif suffix == "csv":
        rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    elif suffix == "json":
        rows = spark.read.json(path)
    else:
        raise DataError(f"manifest must be parquet, csv or json: {path}")
    return normalize_flags(rows)


def normalize_flags(rows: DataFrame) -> DataFrame:
    """Text columns holding only true/false become booleans."""
    texts = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return rows
    only = rows.agg(*[
        (F.bool_and(F.lower(F.trim(c)).isin("true", "false")) & (F.count(c) > 0)).alias(c) for c in texts
    ]).first()
    return rows.withColumns({c: text_flag(F.col(c)) for c in texts if only[c]}) if any(only) else rows


FEATURE_VERSION = 1


def read_feature_table(spark: SparkSession, path: str, config: FeatureConfig, blocks=None) -> DataFrame:
    """Requested blocks of a stored feature table; another version or config is refused."""
    lines = [row["value"] for row in spark.read.text(f"{path}/metadata").collect()]
    meta = json.loads("".join(lines))
    if meta["version"] != FEATURE_VERSION:
        raise DataError(f"feature table version {meta['version']} is not {FEATURE_VERSION}")
    if meta["config"] != json.loads(config.to_json()):
        raise DataError("feature table was built with another configuration")
    stored = tuple(meta["blocks"])
    if not stored or len(set(stored)) != len(stored) or set(stored) - set(BLOCKS):
        raise DataError(f"feature table has unusable blocks: {stored}")
    wanted = stored if blocks is None else normalize_blocks(blocks)
    missing = [b for b in wanted if b not in stored]
    if missing:
        raise DataError(f"feature table lacks blocks: {missing}")
    return spark.read.parquet(f"{path}/features").select("split", "clip_id", "label", "user", "submission_path", *wanted)
