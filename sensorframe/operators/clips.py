"""Clip manifests: one quality-checked row per clip, their joins, filters and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe import skew
from sensorframe.functions.columns import correct_flag
from sensorframe.operators.sampling import member_order
from sensorframe.schema import IMU_DEVICES, MODALITIES, REQUIRED_MODALITIES
from sensorframe.skew import OrderedGroups


class DataError(ValueError):
    """Input that breaks a stated rule."""


def require_none(violations: DataFrame, message: str) -> None:
    """Raise when any violating row exists, naming one of them."""
    row = violations.limit(1).collect()
    if row:
        raise DataError(f"{message}: {row[0].asDict()}")


def slug(modality: str) -> str:
    return modality.lower()


# ---------------------------------------------------------------- manifest

def _alignment(left: str, right: str) -> Column:
    """Equal timestamp sets of two modalities; NULL when either has none."""
    has_left, has_right = F.max(f"_t_{left}"), F.max(f"_t_{right}")
    same = F.bool_and(F.col(f"_t_{left}") == F.col(f"_t_{right}"))
    return F.when(has_left & has_right, same)


def build_manifest(
    members: DataFrame,
    keys: Sequence[str] = ("split", "clip_id"),
    attributes: Sequence[str] = ("action_id", "action_name", "user", "trial"),
    modalities: Sequence[str] = MODALITIES,
    timestamp: str = "timestamp",
    span: Column | None = None,
    aligned: Sequence[tuple[str, str, str]] = (
        ("Depth_Color", "IR", "depth_ir_aligned"),
        ("Depth_Color", "Skeleton", "depth_skeleton_aligned"),
    ),
    clock: Sequence[str] = ("Depth_Color", "IR"),
) -> DataFrame:
    """One row per clip from one row per file.

    Files are first reduced per (clip, timestamp), which also yields the timestamp sets, so a clip
    with very many files is already small when it is brought together.
    """
    modality, stamp = F.col("modality"), F.col(timestamp)
    # the attributes belong to the clip; as keys they keep the large step a hash aggregation
    per_time = members.groupBy(*keys, *attributes, timestamp).agg(
        *[F.count_if(modality == m).alias(f"_n_{m}") for m in modalities],
        *[F.sum(F.when(modality == m, F.coalesce("size", F.lit(0)))).alias(f"_b_{m}") for m in modalities],
    )
    seen = {f"_t_{m}": stamp.isNotNull() & (F.col(f"_n_{m}") > 0) for m in modalities}
    per_time = per_time.withColumns(seen)
    ends = []
    for m in clock:
        ends += [
            F.min(F.when(F.col(f"_t_{m}"), stamp)).alias(f"_from_{m}"),
            F.max(F.when(F.col(f"_t_{m}"), stamp)).alias(f"_to_{m}"),
        ]
    clips = per_time.groupBy(*keys, *attributes).agg(
        *[F.sum(f"_n_{m}").alias(f"{slug(m)}_file_count") for m in modalities],
        *[F.coalesce(F.sum(f"_b_{m}"), F.lit(0)).alias(f"{slug(m)}_bytes") for m in modalities],
        *ends,
        *[_alignment(a, b).alias(name) for a, b, name in aligned],
    )
    present = {f"{slug(m)}_present": F.col(f"{slug(m)}_file_count") > 0 for m in modalities}
    clips = clips.withColumns(present)
    start = F.coalesce(*[F.col(f"_from_{m}") for m in clock])
    end = F.coalesce(*[F.col(f"_to_{m}") for m in clock])
    clips = clips.withColumns({"start_timestamp": start, "end_timestamp": end})
    if span is None:
        form = F.lit("yyyy-MM-dd_HH-mm-ss.SSS")
        span = (
            F.unix_millis(F.try_to_timestamp("end_timestamp", form))
            - F.unix_millis(F.try_to_timestamp("start_timestamp", form))
        ) / F.lit(1000.0)
    shown = {m: F.col(f"{slug(m)}_present") for m in modalities}
    count = sum(F.when(p, 1).otherwise(0) for p in shown.values())
    clips = clips.withColumns(
        {
            "duration_seconds": span,
            "modality_count": count.cast("int"),
            "complete": count == len(modalities),
            "missing_modalities": F.concat_ws(", ", *[F.when(~p, F.lit(m)) for m, p in shown.items()]),
            "total_file_count": sum(F.col(f"{slug(m)}_file_count") for m in modalities),
        }
    )
    return clips.drop(*[f"_{side}_{m}" for m in clock for side in ("from", "to")])


def content_quality(files: DataFrame, keys: Sequence[str] = ("split", "clip_id")) -> DataFrame:
    """Per-clip content flags from one row per file (modality, data_rows, people, bad_json)."""
    modality, rows, people = F.col("modality"), F.col("data_rows"), F.col("people")
    radar = F.count_if(modality == "Radar") > 0
    radar_rows = F.sum(F.when(modality == "Radar", rows))
    skeleton = modality == "Skeleton"
    return files.groupBy(*keys).agg(
        F.count_if((modality == "IMU") & (rows == 0)).alias("imu_empty_files"),
        F.when(radar, radar_rows).alias("radar_data_rows"),
        F.when(radar, radar_rows == 0).alias("radar_empty"),
        F.count_if(skeleton & ~F.col("bad_json") & (people == 0)).alias("skeleton_empty_frames"),
        F.count_if(skeleton & ~F.col("bad_json") & (people > 1)).alias("skeleton_multi_person_frames"),
        F.count_if(skeleton & F.col("bad_json")).alias("skeleton_bad_json"),
    )


def with_issues(
    manifest: DataFrame,
    checks: Sequence[tuple[str, str]] = (
        ("depth_ir_aligned", "Depth/IR timestamps differ"),
        ("depth_skeleton_aligned", "Depth/Skeleton timestamps differ"),
    ),
) -> DataFrame:
    """Add the ordered issue messages; columns that were not measured add none."""
    have = set(manifest.columns)
    messages = [
        F.when(F.col("missing_modalities") != "", F.concat(F.lit("missing: "), F.col("missing_modalities")))
    ]
    if "radar_empty" in have:
        messages.append(F.when(F.col("radar_empty"), F.lit("radar has no detections")))
    for column, text in (
        ("imu_empty_files", "empty IMU file(s)"),
        ("skeleton_bad_json", "invalid skeleton JSON file(s)"),
    ):
        if column in have:
            count = F.col(column)
            messages.append(F.when(count > 0, F.concat_ws(" ", count.cast("string"), F.lit(text))))
    messages += [F.when(~F.col(flag), F.lit(text)) for flag, text in checks if flag in have]
    return manifest.withColumn("issues", F.concat_ws("; ", *messages))


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test, allowMissingColumns=True)


def member_index(members: DataFrame, keys: Sequence[str] = ("split", "clip_id", "modality")) -> DataFrame:
    """Every member with its place in the ordered list of its clip and modality.

    One row per member rather than one list per clip, so a very long list stays distributed.
    """
    groups = OrderedGroups(members, keys, member_order(), None)
    return groups.scan(position=skew.position(), members=skew.total()).rows()


# ---------------------------------------------------------------- selection

def modality_keys(members: DataFrame, key: str, required: Sequence[str], part: str = "modality") -> DataFrame:
    """Every logical clip, flagged when it occurs in each required modality."""
    flags = [F.bool_or(F.col(part) == m) for m in required]
    complete = flags[0]
    for flag in flags[1:]:
        complete = complete & flag
    return members.groupBy(key).agg(complete.alias("in_all"))


def discovery_flags(
    members: DataFrame,
    imu_files: DataFrame,
    keys: Sequence[str] = ("split", "clip_id"),
    required: Sequence[str] = REQUIRED_MODALITIES,
    devices: Sequence[str] = IMU_DEVICES,
) -> DataFrame:
    """Flags of every step of the strict selection, one row per clip.

    ``imu_files`` has one row per (clip, file, device) with the number of data rows.
    """
    modality = F.col("modality")
    name = F.element_at(F.split("member_path", "/"), -1)
    usable = (F.col("size") > 0) & ~name.startswith(".")
    image = usable & F.lower(name).rlike(r"\.(jpg|jpeg|png)$")
    posed = usable & F.lower(name).endswith(".json")
    in_all = F.lit(True)
    for m in required:
        in_all = in_all & F.bool_or(modality == m)
    clips = members.groupBy(*keys).agg(
        in_all.alias("modality_complete"),
        F.max("action_name").alias("action_name"),
        F.max("user").alias("user"),
        (
            F.bool_or((modality == "Depth_Color") & image)
            & F.bool_or((modality == "IR") & image)
            & F.bool_or((modality == "Skeleton") & posed)
        ).alias("files_usable"),
    )
    per_file = imu_files.groupBy(*keys, "path").agg(
        F.sum("data_rows").alias("_rows"), *[F.bool_or(F.col("device") == d).alias(f"_has_{d}") for d in devices]
    )
    all_devices = F.lit(True)
    for d in devices:
        all_devices = all_devices & F.bool_or(f"_has_{d}")
    imu = per_file.groupBy(*keys).agg(
        F.count_if(F.col("_rows") > 0).alias("nonempty_imu_files"), all_devices.alias("devices_present")
    )
    joined = clips.join(imu, list(keys), "left")
    usable = F.col("modality_complete") & F.col("files_usable")
    nonempty = usable & F.coalesce(F.col("nonempty_imu_files") >= 2, F.lit(False))
    return joined.withColumns(
        {
            "imu_nonempty": nonempty,
            "selected": nonempty & F.coalesce(F.col("devices_present"), F.lit(False)),
        }
    )


def complete_case(flags: DataFrame) -> DataFrame:
    """Selected clips with label and participant."""
    from sensorframe.functions.columns import label_from_action

    return flags.filter("selected").select(
        "split", "clip_id", label_from_action(F.col("action_name")).alias("label"), "user"
    )


def discovery_funnel(flags: DataFrame) -> DataFrame:
    return flags.agg(
        F.count(F.lit(1)).alias("logical_clips"),
        F.count_if("modality_complete").alias("modality_complete"),
        F.count_if("imu_nonempty").alias("nonempty_imu_files"),
        F.count_if("selected").alias("all_imu_devices"),
    )


def inspect_devices(rows: DataFrame, keys: Sequence[str], file: str, device: str) -> DataFrame:
    """Distinct devices, data rows and nonempty files per clip."""
    per_file = rows.groupBy(*keys, file, device).agg(F.count(F.lit(1)).alias("_rows"))
    per_device = per_file.groupBy(*keys, device).agg(F.sum("_rows").alias("_rows"))
    devices = per_device.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("devices"), F.sum("_rows").alias("row_count")
    )
    files = per_file.groupBy(*keys, file).agg(F.lit(1)).groupBy(*keys).agg(F.count(F.lit(1)).alias("nonempty_files"))
    return devices.join(files, list(keys))


def has_all(rows: DataFrame, keys: Sequence[str], part: str, expected: Sequence[str]) -> DataFrame:
    """Groups in which every expected part occurs."""
    flags = rows.groupBy(*keys).agg(*[F.bool_or(F.col(part) == e).alias(f"_h{i}") for i, e in enumerate(expected)])
    kept = F.lit(True)
    for i in range(len(expected)):
        kept = kept & F.col(f"_h{i}")
    return flags.filter(kept).select(*keys)


def filter_clips(
    clips: DataFrame,
    *,
    split: str | None = None,
    action_id: int | None = None,
    user: str | None = None,
    predicted: int | None = None,
    correctness: str = "all",
) -> DataFrame:
    """Clips matching every given choice; unknown correctness matches neither choice."""
    if split is not None:
        clips = clips.filter(F.col("split") == split)
    if action_id is not None:
        clips = clips.filter(F.coalesce("action_id", F.lit(-1)) == action_id)
    if user is not None:
        clips = clips.filter(F.col("user") == user)
    if predicted is not None:
        clips = clips.filter(F.coalesce("prediction_action_id", F.lit(-1)) == predicted)
    if correctness == "correct":
        clips = clips.filter("prediction_correct")
    elif correctness == "incorrect":
        clips = clips.filter("NOT prediction_correct")
    elif correctness != "all":
        raise ValueError(f"unknown correctness choice: {correctness}")
    return clips.filter(F.col("clip_id").isNotNull())


# ---------------------------------------------------------------- joins

def attach_test_index(index: DataFrame, clips: DataFrame, key: str = "clip_id") -> tuple[DataFrame, DataFrame]:
    """Index rows with their clip, and the index rows whose clip is missing."""
    marked = index.join(clips.withColumn("_found", F.lit(True)), key, "left")
    return marked.filter("_found").drop("_found"), marked.filter("_found IS NULL").select(index.columns)


def add_predictions(clips: DataFrame, predictions: DataFrame, key: str = "clip_id") -> DataFrame:
    named = predictions.select(
        key,
        F.col("action_id").alias("prediction_action_id"),
        F.col("action_name").alias("prediction_action_name"),
    )
    return clips.join(named, key, "left").withColumn(
        "prediction_correct",
        correct_flag(F.col("prediction_action_id"), F.col("action_id"), F.col("split")),
    )


def map_actions(predictions: DataFrame, mapping: DataFrame, key: str = "clip_id") -> tuple[DataFrame, DataFrame]:
    """Predictions with their class name, and those with an unknown id or a repeated clip."""
    joined = predictions.join(mapping, "action_id", "left")
    repeats = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    good = joined.filter(F.col("action_name").isNotNull())
    unknown = joined.filter(F.col("action_name").isNull()).select(
        F.col(key), F.lit("unknown action").alias("violation")
    )
    return good, unknown.unionByName(repeats.select(key, F.lit("duplicate clip").alias("violation")))


def combine_predictions(first: DataFrame, second: DataFrame, key: str = "clip_id") -> tuple[DataFrame, DataFrame]:
    """Union of two prediction tables, and the clips that occur more than once."""
    both = first.unionByName(second)
    repeats = both.groupBy(key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    return both, repeats


def active_subset(table: DataFrame, active: DataFrame, path: str, place: str) -> tuple[DataFrame, DataFrame]:
    """Canonical position of every active row, and the active rows the table does not hold."""
    known = table.select(path, F.col(place).alias("canonical"))
    joined = active.join(known, path, "left")
    return joined.filter("canonical IS NOT NULL"), joined.filter("canonical IS NULL")


def resume_labels(source: DataFrame, existing: DataFrame | None, path: str, place: str) -> tuple[DataFrame, DataFrame]:
    """Source rows with the labels given so far, and the places where the paths differ."""
    if existing is None:
        fresh = source.withColumn("prediction", F.lit(""))
        return fresh, source.limit(0)
    other = existing.select(place, F.col(path).alias("_path"), F.col("prediction").alias("_given"))
    joined = source.drop("prediction").join(other, place, "full")
    moved = joined.filter(~F.col(path).eqNullSafe(F.col("_path")))
    rows = joined.withColumn("prediction", F.coalesce("_given", F.lit(""))).drop("_path", "_given")
    return rows, moved.drop("_given")


def prediction_coverage(clips: DataFrame, predictions: DataFrame, key: str = "clip_id") -> DataFrame:
    return clips.join(predictions, key, "left_semi").groupBy("split").agg(
        F.count_distinct(key).alias("matched")
    )


def unused_predictions(clips: DataFrame, predictions: DataFrame, key: str = "clip_id") -> DataFrame:
    """Predictions whose clip is not known."""
    return predictions.join(clips.select(key), key, "left_anti")


def id_differences(stored: DataFrame, current: DataFrame, key: str = "clip_id") -> DataFrame:
    """Ids only one side has, with the side; repeats count."""
    gone = stored.select(key).exceptAll(current.select(key)).withColumn("side", F.lit("stored only"))
    fresh = current.select(key).exceptAll(stored.select(key)).withColumn("side", F.lit("current only"))
    return gone.unionByName(fresh)


def assemble_blocks(tables: dict[str, DataFrame], key: str = "clip_id") -> DataFrame:
    """One row per clip with every block; a clip lacking one keeps NULL there.

    All tables are keyed by the clip, so the joins share one partitioning.
    """
    names = list(tables)
    rows = tables[names[0]]
    for name in names[1:]:
        rows = rows.join(tables[name], key, "full")
    return rows


def require_blocks(rows: DataFrame, blocks: Sequence[str], key: str = "clip_id") -> DataFrame:
    missing = F.lit(False)
    for block in blocks:
        missing = missing | F.col(block).isNull()
    require_none(rows.filter(missing).select(key), "a selected block is missing for a clip")
    return rows


def align_timeline(groups: OrderedGroups, leading: Sequence[str], fallback: str, part: str = "modality") -> DataFrame:
    """Every timeline frame of a clip with the member each modality shows.

    The timeline is as long as the longest leading modality, else the fallback, at least one frame.
    Instead of joining frames to members, each member writes the frames that round to it.
    """
    rows = groups.scan(_pos=skew.position(), _n=skew.total()).rows()
    clip = [k for k in groups.keys if k != part]
    counts = rows.groupBy(*clip).agg(
        F.max(F.when(F.col(part).isin(list(leading)), F.col("_n"))).alias("_lead"),
        F.max(F.when(F.col(part) == fallback, F.col("_n"))).alias("_fall"),
    )
    counts = counts.select(*clip, F.coalesce("_lead", "_fall", F.lit(1)).alias("frames"))
    rows = rows.join(counts, clip)
    frames, n, pos = F.col("frames"), F.col("_n"), F.col("_pos")
    ratio = F.when((n > 1) & (frames > 1), (frames - 1) / (n - 1))
    low = F.when(ratio.isNotNull(), F.greatest(F.lit(0), F.floor((pos - 1) * ratio)))
    high = F.when(ratio.isNotNull(), F.least(frames - 1, F.ceil((pos + 1) * ratio)))
    # a single member serves every frame, and a single frame shows the first member
    low = F.coalesce(low, F.lit(0)).cast("long")
    high = F.coalesce(high, frames - 1).cast("long")
    spread = rows.withColumn("frame", F.explode(F.sequence(low, high)))
    target = F.when(frames > 1, F.rint((n - 1) * F.col("frame") / (frames - 1))).otherwise(F.lit(0.0))
    return spread.filter(target == pos).drop("_pos", "_n", "frames")


# ---------------------------------------------------------------- summaries

def class_counts(clips: DataFrame, label: str = "label") -> DataFrame:
    return clips.groupBy(label).agg(F.count(F.lit(1)).alias("clips"))


def overview_kpis(clips: DataFrame) -> DataFrame:
    return clips.agg(
        F.count_if(F.col("split") == "train").alias("train_clips"),
        F.count_if(F.col("split") == "test").alias("test_clips"),
        F.count_distinct("action_name").alias("actions"),
        F.count_distinct("user").alias("users"),
        (F.avg(F.col("complete").cast("int")) * 100).alias("complete_share"),
    )


def modality_coverage(manifest: DataFrame, modalities: Sequence[str] = MODALITIES) -> DataFrame:
    totals = manifest.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.coalesce(f"{slug(m)}_present", F.lit(False))).alias(f"_p{i}") for i, m in enumerate(modalities)],
    )
    rows = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"_p{i}").alias("clips")) for i, m in enumerate(modalities)])
    return totals.select("_all", F.inline(rows)).select(
        "modality", "clips", (F.col("clips") * 100.0 / F.col("_all")).alias("coverage")
    )


def crosstab(rows: DataFrame, row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """Counts of two attributes, zero filled."""
    counted = rows.groupBy(row).pivot(column, list(columns)).agg(F.count(F.lit(1)))
    return counted.na.fill(0, subset=list(columns))


def file_count_box(manifest: DataFrame, modalities: Sequence[str] = MODALITIES, split: str = "split") -> DataFrame:
    """Quartiles of the positive file counts per modality and split."""
    parts = F.array(*[
        F.struct(F.lit(m).alias("modality"), F.col(f"{slug(m)}_file_count").alias("files")) for m in modalities
    ])
    rows = manifest.select(split, F.inline(parts)).filter("files > 0")
    keys = ["modality", split]
    boxes = skew.quantiles(rows, keys, "files", (0.0, 0.25, 0.5, 0.75, 1.0), "_q")
    names = ("low", "q1", "median", "q3", "high")
    return boxes.select(*keys, *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])


def modality_combinations(manifest: DataFrame, modalities: Sequence[str] = MODALITIES) -> DataFrame:
    names = F.concat_ws(" + ", *[F.when(F.col(f"{slug(m)}_present"), F.lit(m)) for m in modalities])
    pattern = F.when(names == "", F.lit("None")).otherwise(names)
    return manifest.groupBy(pattern.alias("combination")).agg(F.count(F.lit(1)).alias("clips"))


def quality_kpis(manifest: DataFrame, modalities: Sequence[str] = MODALITIES) -> DataFrame:
    """Counts of quality problems; NULL where nothing was measured."""
    have = set(manifest.columns)

    def measured(column: str, value: Column, name: str) -> Column:
        if column not in have:
            return F.lit(None).cast("long").alias(name)
        return F.when(F.count(column) > 0, value).alias(name)

    bad = [c for c in ("depth_ir_aligned", "depth_skeleton_aligned") if c in have]
    apart = F.lit(False)
    for c in bad:
        apart = apart | F.coalesce(~F.col(c), F.lit(False))
    known = sum((F.count(c) for c in bad), F.lit(0))
    return manifest.agg(
        F.count_if(~F.col("complete")).alias("incomplete_clips"),
        measured("radar_empty", F.count_if("radar_empty") if "radar_empty" in have else None, "empty_radar"),
        measured("imu_empty_files", F.sum("imu_empty_files") if "imu_empty_files" in have else None, "empty_imu_files"),
        F.when(known > 0, F.count_if(apart)).alias("misaligned_clips"),
        *[F.count_if(~F.col(f"{slug(m)}_present")).alias(f"{slug(m)}_missing") for m in modalities],
    )


def issue_counts(rows: DataFrame, text: str = "issues", separator: str = "; ") -> DataFrame:
    pieces = rows.select(F.explode(F.split(text, separator)).alias("issue")).filter("issue <> ''")
    return pieces.groupBy("issue").agg(F.count(F.lit(1)).alias("clips"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins of the present values; the highest value belongs to the last bin."""
    present = rows.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    ends = present.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    width = (high - low) / bins
    index = F.when(width > 0, F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return present.groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("clips"))


def flagged_clips(manifest: DataFrame, columns: Sequence[str]) -> DataFrame:
    return manifest.filter(F.col("issues") != "").select(*columns)


def feature_health(features: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """Complete, partial and all-missing rows per block."""
    totals = []
    for block in blocks:
        known = F.size(F.filter(F.col(block), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
        known = F.when(F.col(block).isNull(), 0).otherwise(known)
        width = F.when(F.col(block).isNull(), 1).otherwise(F.size(block))
        totals += [
            F.count_if(known == width).alias(f"_c_{block}"),
            F.count_if((known > 0) & (known < width)).alias(f"_p_{block}"),
            F.count_if(known == 0).alias(f"_m_{block}"),
        ]
    rows = F.array(*[
        F.struct(
            F.lit(b).alias("block"),
            F.col(f"_c_{b}").alias("complete_rows"),
            F.col(f"_p_{b}").alias("partial_rows"),
            F.col(f"_m_{b}").alias("all_missing_rows"),
        )
        for b in blocks
    ])
    return features.agg(*totals).select(F.inline(rows))


def require_finite(features: DataFrame, blocks: Sequence[str]) -> None:
    """Training rows must be complete."""
    for row in feature_health(features, blocks).collect():
        bad = row["partial_rows"] + row["all_missing_rows"]
        if bad:
            raise DataError(f"{bad} training rows have missing {row['block']} values")
