"""A first manifest of a large file tree: folders are listed level by level, and only as far as a quota of clips asks for.

Folders to list are rows, so executors list them side by side; what a level yields is numbered, cut to what the quota can reach, and
becomes the next level's rows. Nothing below a folder that the quota does not reach is ever listed. The driver sees no names.

Executors list through pyarrow's file systems: plain paths on storage that all of them share, or ``hdfs://``, ``s3://`` and ``gs://`` addresses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe import skew
from sensorframe.functions.columns import natural_key
from sensorframe.operators import clips as K
from sensorframe.operators import sampling
from sensorframe.schema import MODALITIES
from sensorframe.skew import OrderedGroups
from sensorframe.sources import scan

#: Rows of one batch that a task gives back.
BATCH = 10_000
TEST_CLIP = "SM_test_"


def _entries(folder: str, deep: bool, count) -> Iterator[tuple[str, str, bool, int]]:
    """(name, path, is a folder, bytes) of what a folder holds; of files at any depth if deep. A missing folder holds nothing."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    open_ = [path]
    while open_:
        count(1)
        for info in store.get_file_info(fs.FileSelector(open_.pop(), allow_not_found=True)):
            inside = info.type == fs.FileType.Directory
            if deep and inside:
                open_.append(info.path)
            else:
                yield info.base_name, info.path, inside, info.size or 0


def listed(folders: DataFrame, *, deep: bool = False, counter: Accumulator | None = None) -> DataFrame:
    """Each row of folders once for every entry of its ``folder``: name, path, is_folder, length added.

    Folders that are hidden or belong to the operating system are passed over. ``counter`` counts the folders listed, repeated tasks included.
    """
    added = [T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), T.StructField("is_folder", T.BooleanType()),
             T.StructField("length", T.LongType())]
    names = [f.name for f in added]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter.add if counter is not None else (lambda n: None)
        for pdf in batches:
            for at in range(len(pdf)):
                rows = []
                for entry in _entries(pdf["folder"].iloc[at], deep, count):
                    rows.append(entry)
                    if len(rows) == BATCH:
                        yield _with(pdf, at, rows, names)
                        rows = []
                if rows:
                    yield _with(pdf, at, rows, names)

    found = folders.repartition(2 * folders.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, T.StructType([*folders.schema, *added]))
    return found.filter(scan.kept(F.col("name")))


def _with(pdf: pd.DataFrame, at: int, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    repeated = pdf.iloc[[at] * len(rows)].reset_index(drop=True)
    return pd.concat([repeated, pd.DataFrame(rows, columns=names)], axis=1)


def _one(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(1).select(F.lit(folder).alias("folder"))


def _subfolders(folders: DataFrame, name: str, keys: Sequence[str], counter: Accumulator | None) -> DataFrame:
    """Stored (keys, name, folder) of the folders below."""
    below = listed(folders, counter=counter).filter("is_folder").drop("folder", "is_folder", "length")
    return skew.checkpointed(below.withColumnsRenamed({"name": name, "path": "folder"}).select(*keys, name, "folder"))


def _placed(rows: DataFrame, name: str, keys: Sequence[str], before: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 0 within keys, in natural order of a name."""
    groups = Window.partitionBy(*(keys or [F.lit(0)]))
    return rows.withColumn(f"{name}_place", F.row_number().over(groups.orderBy(*before, natural_key(F.col(name)), name)).cast("long") - 1)


def _round_robin(spark: SparkSession, root: str, limit: int, counter: Accumulator | None) -> DataFrame:
    """(place, clip_id) of the first clip of every action, then of the second of every action, up to ``limit``.

    Clips found so far, and for every action that may hold more the place of its next clip, are put in that order. The actions
    whose next clips are among the first ``limit`` entries list their next participants, twice as many each time; when none is
    among them, the entries are the answer.
    """
    known = _placed(_subfolders(_one(spark, root), "action", [], counter), "action", [])
    state = skew.checkpointed(known.withColumns({"users": F.lit(None).cast("long"), "next": F.lit(0).cast("long"), "found": F.lit(0).cast("long")}))
    users = clips = None
    batch = 1
    while True:
        entries = state.filter("users is null or next < users").select("action_place", F.col("found").alias("offset"), F.lit(None).cast("string").alias("clip_id"), "action")
        if clips is not None:
            entries = entries.unionByName(clips.select("action_place", "offset", "clip_id", F.lit(None).cast("string").alias("action")))
        head = skew.checkpointed(entries.orderBy("offset", "action_place").limit(limit))
        # at most ``limit`` actions
        due = state.join(head.filter("clip_id is null").select("action"), "action")
        if due.isEmpty():
            return head.select((F.row_number().over(Window.orderBy("offset", "action_place")).cast("long") - 1).alias("place"), "clip_id")
        opened = _placed(_subfolders(due.filter("users is null").select("action", "folder"), "user", ["action"], counter), "user", ["action"])
        users = skew.checkpointed(opened if users is None else users.unionByName(opened))
        turn = due.select("action", "action_place", "next", "found").join(users, "action").filter(F.col("user_place").between(F.col("next"), F.col("next") + batch - 1))
        trials = _subfolders(turn.drop("next"), "trial", ["action", "action_place", "found", "user", "user_place"], counter)
        new = _placed(trials, "trial", ["action"], ["user_place"]).select(
            "action", "action_place", (F.col("found") + F.col("trial_place")).alias("offset"), F.concat_ws("/", "action", "user", "trial").alias("clip_id"))
        clips = skew.checkpointed(new if clips is None else clips.unionByName(new))
        counts = users.groupBy("action").agg(F.count(F.lit(1)).alias("_users"))
        more = new.groupBy("action").agg(F.count(F.lit(1)).alias("_more"))
        turned = due.select("action", F.lit(True).alias("_due"))
        known = F.coalesce("_due", F.lit(False))
        state = skew.checkpointed(state.join(turned, "action", "left").join(counts, "action", "left").join(more, "action", "left").select(
            "action", "action_place", "folder", F.when(known | F.col("users").isNotNull(), F.coalesce("_users", F.lit(0))).alias("users"),
            (F.col("next") + F.when(known, batch).otherwise(0)).alias("next"), (F.col("found") + F.coalesce("_more", F.lit(0))).alias("found")))
        batch *= 2


def initial_clips(spark: SparkSession, root: str, split: str, limit: int, counter: Accumulator | None = None) -> DataFrame:
    """(place, clip_id) of up to ``limit`` clips that stand for a split, from folder names alone.

    Training clips are taken in turn from every action, by the first modality that has any; test clips evenly from all names.
    """
    none = spark.createDataFrame([], "place long, clip_id string")
    if limit <= 0:
        return none
    if split == "train":
        for modality in MODALITIES:
            found = _round_robin(spark, f"{root}/data/{modality}", limit, counter)
            if not found.isEmpty():
                return found
        return none
    names = _subfolders(_one(spark, root), "clip_id", [], counter).filter(F.col("clip_id").startswith(TEST_CLIP))
    groups = OrderedGroups(names, [], [natural_key(F.col("clip_id")), F.col("clip_id")], None)
    chosen = sampling.evenly_sample(groups, limit)
    order = [natural_key(F.col("clip_id")), F.col("clip_id")]
    # at most ``limit`` rows
    return chosen.select((F.row_number().over(Window.orderBy(*order)).cast("long") - 1).alias("place"), "clip_id")


def initial_selection(spark: SparkSession, roots: dict[str, str], limit: int, counter: Accumulator | None = None) -> DataFrame:
    """Stored (split, place, clip_id): the quota divided over the splits, what one cannot use given to the other."""
    splits = [s for s in ("train", "test") if s in roots]
    base, rest = divmod(max(limit, 0), max(len(splits), 1))
    chosen = {s: skew.checkpointed(initial_clips(spark, roots[s], s, base + (i < rest), counter)) for i, s in enumerate(splits)}
    counts = {s: df.count() for s, df in chosen.items()}
    for split in splits:
        spare = limit - sum(counts.values())
        if spare > 0:
            have = chosen[split]
            wider = initial_clips(spark, roots[split], split, counts[split] + spare, counter).join(have.select("clip_id"), "clip_id", "left_anti")
            extra = wider.orderBy("place").limit(spare).withColumn("place", F.col("place") + counts[split])
            chosen[split] = skew.checkpointed(have.unionByName(extra.select(have.columns)))
            counts[split] = chosen[split].count()
    rows = [df.select(F.lit(s).alias("split"), "place", "clip_id") for s, df in chosen.items()]
    found = spark.createDataFrame([], "split string, place long, clip_id string")
    for one in rows:
        found = found.unionByName(one)
    return found


def initial_manifest(spark: SparkSession, roots: dict[str, str], limit: int = 200, counter: Accumulator | None = None) -> DataFrame:
    """Manifest of a representative part of the splits under ``roots`` (the folder of each that ``scan_split`` takes), at most ``limit`` clips.

    Only the folders of chosen clips are listed to their files.
    """
    chosen = initial_selection(spark, roots, limit, counter)
    manifest = None
    for split, root in roots.items():
        mine = chosen.filter(F.col("split") == split).select("clip_id", F.explode(F.array(*map(F.lit, MODALITIES))).alias("modality"))
        folder = F.concat_ws("/", F.lit(root), F.lit("data"), "modality", "clip_id") if split == "train" else F.concat_ws("/", F.lit(root), "clip_id", "modality")
        files = listed(mine.withColumn("folder", folder).select("folder"), deep=True, counter=counter)
        anchor = "HAR" if split == "train" else "small_model_track_test"
        members = scan.parse_members(files.select(scan.relative_path(F.col("path"), anchor).alias("path"), "length"), split)
        one = K.build_manifest(members).withColumns({"source_kind": F.lit("directory"), "source_path": F.lit(root)})
        manifest = one if manifest is None else K.union_splits(manifest, one)
    if manifest is None:
        raise K.DataError("no split to index")
    keys = {f"_key{i}": key for i, key in enumerate(sampling.manifest_order())}
    return K.with_issues(manifest).withColumns(keys).orderBy(*keys).drop(*keys)
