"""Person tracking, pose normalization and skeleton features.

A pose is a flat array of 51 numbers (17 joints by 3 axes) beside 17 scores.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe import skew
from sensorframe.operators import signal as S
from sensorframe.schema import ANGLES, DISTANCES, EDGES, JOINT, JOINTS, FeatureConfig
from sensorframe.skew import SLICE, OrderedGroups

JOINT_COUNT = len(JOINTS)
GEOMETRY = (
    [f"angle{i}" for i in range(8)] + [f"distance{i}" for i in range(7)]
    + ["torso_x", "torso_y", "torso_z", "extent_x", "extent_y", "extent_z", "root_x", "root_y", "root_z"]
)
ACCELERATED = ("head", "l_wrist", "r_wrist", "l_ankle", "r_ankle")


def at(pose: Column, joint: str | int, axis: int) -> Column:
    index = JOINT[joint] if isinstance(joint, str) else joint
    return F.get(pose, F.lit(3 * index + axis))


def vector(pose: Column, start: str | int, end: str | int) -> list[Column]:
    return [at(pose, end, a) - at(pose, start, a) for a in range(3)]


def length(parts: Sequence[Column]) -> Column:
    return F.sqrt(sum(p * p for p in parts))


def flat(points: Column) -> Column:
    return F.flatten(points)


# ---------------------------------------------------------------- tracking


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _center(points: Column) -> Column:
    return F.struct(
        _mean(F.transform(points, lambda k: k[0])).alias("x"),
        _mean(F.transform(points, lambda k: k[1])).alias("y"),
        _mean(F.transform(points, lambda k: k[2])).alias("z"),
    )


def _extent(points: Column) -> Column:
    def spread(axis: Column) -> Column:
        return F.array_max(axis) - F.array_min(axis)

    return length([
        spread(F.transform(points, lambda k: k[0])),
        spread(F.transform(points, lambda k: k[1])),
        spread(F.transform(points, lambda k: k[2])),
    ])


#: Frames whose choices are chained before they are chained with others.
CHUNK = 256
_PERSONS = "array<int>"


def _chained(tables: Column) -> Column:
    """One table for a list of tables from person to person: for every person entered with, the person left with."""
    empty = F.lit(None).cast(_PERSONS)
    return F.aggregate(tables, empty, lambda so_far, t: F.when(t.isNull(), so_far).when(so_far.isNull(), t).otherwise(F.transform(so_far, lambda i: F.get(t, i))))


def _walked(tables: Column, entry: Column, given: Callable[[Column, Column], Column]) -> Column:
    """What ``given`` says of each table of a list and the person it is entered with, the first with ``entry``."""
    start = F.struct(entry.cast("int").alias("at"), F.array().cast(_PERSONS).alias("out"))
    leave = lambda at, t: F.when(t.isNull(), at).otherwise(F.get(t, at))
    return F.aggregate(tables, start, lambda w, t: F.struct(leave(w["at"], t).alias("at"), F.concat(w["out"], F.array(given(w["at"], t))).alias("out")), lambda w: w["out"])


def _chunks(tables: Column) -> Column:
    # an empty list has no chunk, and a sequence would count down to it
    last = F.floor((F.size(tables) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(tables, k * CHUNK + 1, CHUNK))


def _chosen(tables: Column, entry: Column) -> Column:
    """The person of every table of a list, null where the table is; chunks are chained first, so a long list costs little more than a short one."""
    chunks = _chunks(tables)
    entries = _walked(F.transform(chunks, _chained), entry, lambda at, t: at)
    return F.flatten(F.zip_with(chunks, entries, lambda c, e: _walked(c, e, lambda at, t: F.get(t, at))))


def person_track(groups: OrderedGroups, people: str = "people") -> DataFrame:
    """One person per frame: best score and extent first, then the one nearest the last choice.

    The choice in a frame depends only on which person of the last nonempty frame was chosen, so a
    frame is a small table from person to person. Tables of consecutive frames chain into one, which
    lets slices of a long clip be worked on apart.
    """
    order = groups.order
    persons = F.col(people)
    centers = F.when(F.size(persons) > 0, F.transform(persons, lambda p: _center(p["points"])))
    groups = groups.with_column("_centers", centers)
    groups = groups.scan(_seen=skew.last_valid(F.col("_centers")))
    groups = groups.scan(_before=skew.previous(F.col("_seen")))
    ranks = F.transform(persons, lambda p: F.struct(_mean(p["scores"]), _extent(p["points"])))
    start = F.array((F.array_position(ranks, F.array_max(ranks)) - 1).cast("int"))

    def nearest(center: Column) -> Column:
        gaps = F.transform(
            F.col("_centers"),
            lambda c: length([c["x"] - center["x"], c["y"] - center["y"], c["z"] - center["z"]]),
        )
        return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")

    step = F.when(
        F.col("_centers").isNotNull(),
        F.when(F.col("_before").isNull(), start).otherwise(F.transform("_before", nearest)),
    )
    parts = groups.keys + ([SLICE] if groups.is_cut else [])
    linked = groups.df.select(*parts, *order, step.alias("_step"))
    listed = linked.groupBy(*parts).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), "_step"))).alias("_frames"))
    steps = F.transform("_frames", lambda f: f["_step"])
    if groups.is_cut:
        # slices are chained apart, and then each is entered with the person that the one before it was left with
        listed = skew.checkpointed(listed)
        exits = listed.select(*parts, _chained(F.transform(_chunks(steps), _chained)).alias("_exit"))
        slices = exits.groupBy(*groups.keys).agg(F.array_sort(F.collect_list(F.struct(SLICE, "_exit"))).alias("_slices"))
        entries = _walked(F.transform("_slices", lambda p: p["_exit"]), F.lit(0), lambda at, t: at)
        entered = slices.select(*groups.keys, F.explode(F.arrays_zip(F.transform("_slices", lambda p: p[SLICE]).alias("slice"), entries.alias("entry"))).alias("e"))
        listed = skew._join_on(listed, entered.select(*groups.keys, F.col("e.slice").alias(SLICE), F.col("e.entry").alias("_entry")), parts)
    else:
        listed = listed.withColumn("_entry", F.lit(0))
    pairs = F.arrays_zip(F.transform("_frames", lambda f: f["at"]).alias("at"), _chosen(steps, F.col("_entry")).alias("person"))
    chosen = listed.select(*groups.keys, F.explode(pairs).alias("p")).select(*groups.keys, *[F.col(f"p.at.{o}").alias(o) for o in order], F.col("p.person").alias("person"))
    joined = skew._join_on(groups.df, chosen, [*groups.keys, *order])
    picked = F.get(people, F.col("person"))
    found = joined.withColumns({"points": picked["points"], "scores": picked["scores"]})
    return groups.on(found.drop("_centers", "_seen", "_before")).rows()


# ---------------------------------------------------------------- normalization


def _filled(groups: OrderedGroups, known: Column, values: Column, name: str) -> OrderedGroups:
    """The array ``values`` of the known rows, for the others interpolated between their neighbours, ends held."""
    groups = S.numbered(groups)
    groups = groups.with_column("_known", F.when(known, F.struct(F.col(S.POS).alias("p"), values.alias("v"))))
    groups = groups.scan(_before=skew.last_valid(F.col("_known")), _after=skew.next_valid(F.col("_known")))
    a, b = F.col("_before"), F.col("_after")
    share = (F.col(S.POS) - a["p"]) / F.when(b["p"] > a["p"], b["p"] - a["p"]).otherwise(1)
    mixed = F.zip_with(a["v"], b["v"], lambda x, y: x + (y - x) * share)
    rows = groups.df.withColumn(name, F.coalesce(mixed, a["v"], b["v"]))
    return groups.on(rows.drop("_known", "_before", "_after"))


def fill_pose_gaps(groups: OrderedGroups, pose: str = "pose", scores: str = "scores") -> OrderedGroups:
    """Frames without a person are interpolated between their neighbours, ends held."""
    groups = _filled(groups, F.col(pose).isNotNull(), F.concat(pose, scores), "_values")
    rows = groups.df.withColumns(
        {pose: F.slice("_values", 1, 3 * JOINT_COUNT), scores: F.slice("_values", 3 * JOINT_COUNT + 1, JOINT_COUNT)}
    )
    return groups.on(rows.drop("_values"))


#: Joints that span the torso.
TORSO = ("l_shoulder", "r_shoulder", "pelvis")


def _torso(left: Sequence[Column], right: Sequence[Column], pelvis: Sequence[Column]) -> Column:
    return length([(left[a] + right[a]) / 2 - pelvis[a] for a in range(3)])


def torso_length(pose: Column) -> Column:
    return _torso(*[[at(pose, j, a) for a in range(3)] for j in TORSO])


def _filled_torsos(groups: OrderedGroups, pose: str, scores: str) -> DataFrame:
    """Torso lengths ``_t`` of the frames that ``fill_pose_gaps`` gives.

    Poses are filled number by number, so the other joints need not go through the sorts.
    """
    carried = [*groups.keys, *groups.order, *[c for c in (SLICE, S.POS, S.N) if c in groups.df.columns]]
    rows = groups.df.select(*dict.fromkeys(carried), F.col(pose).isNotNull().alias("_seen"), F.concat(pose, scores).alias("_all"))
    joints = F.array(*[at(F.col("_all"), j, a) for j in TORSO for a in range(3)])
    rows = rows.withColumn("_joints", F.when(F.col("_all").isNotNull(), joints)).drop("_all")
    filled = _filled(groups.on(rows), F.col("_seen"), F.col("_joints"), "_joints").df
    torso = _torso(*[[F.get("_joints", F.lit(3 * i + a)) for a in range(3)] for i in range(len(TORSO))])
    return filled.select(*groups.keys, torso.alias("_t"))


def pose_normalize(groups: OrderedGroups, pose: str = "pose", scores: str = "scores") -> OrderedGroups:
    """Poses centred on the pelvis in units of the clip's median torso length.

    Adds ``root`` (the pelvis before centring) and ``scale``.
    """
    torsos = _filled_torsos(groups, pose, scores).filter("_t > 1e-6")
    groups = fill_pose_gaps(groups, pose, scores)
    # where no clip is cut, none has more torsos than a task may see
    scales = skew.quantiles(torsos, groups.keys, "_t", (0.5,), "_q", may_be_hot=groups.is_cut)
    scales = scales.select(*groups.keys, F.col("_q")[0].alias("_scale"))
    rows = skew._join_on(groups.df, scales, groups.keys)
    rows = rows.withColumn("scale", F.greatest(F.coalesce("_scale", F.lit(1.0)), F.lit(1e-6))).drop("_scale")
    rows = rows.withColumn("root", F.slice(pose, 1, 3))
    centred = F.transform(F.col(pose), lambda v, i: (v - F.get(F.col("root"), i % 3)) / F.col("scale"))
    return groups.on(rows.withColumn(pose, centred))


# ---------------------------------------------------------------- resampled poses


def pose_samples(groups: OrderedGroups, frames: int, pose: str = "pose", scores: str = "scores") -> DataFrame:
    """Normalized poses, scores and roots at evenly spaced points, ``frames`` rows per clip."""
    groups = S.numbered(groups)
    rows = groups.df.filter(F.col(pose).isNotNull())
    values = F.concat(pose, scores, "root")
    width = 4 * JOINT_COUNT + 3
    pos, n = F.col(S.POS), F.col(S.N)
    step = F.when(n > 1, F.lit(frames - 1) / (n - 1))
    low = F.when(n > 1, F.greatest(F.lit(0), F.floor((pos - 1) * step))).otherwise(F.lit(0)).cast("int")
    high = F.when(n > 1, F.least(F.lit(frames - 1), F.ceil((pos + 1) * step))).otherwise(F.lit(frames - 1)).cast("int")
    spread = rows.select(*groups.keys, S.POS, S.N, "scale", values.alias("_v"), F.explode(F.sequence(low, high)).alias("point"))
    spread = spread.withColumn("_w", S.hat(F.col("point"), frames, pos, n)).filter("_w > 0")
    sums = [F.sum(F.get("_v", F.lit(i)) * F.col("_w")).alias(f"_s{i}") for i in range(width)]
    summed = spread.groupBy(*groups.keys, "point").agg(F.max(S.N).alias("frames"), F.max("scale").alias("scale"), *sums)
    take = lambda a, b: F.array(*[F.col(f"_s{i}") for i in range(a, b)])
    return summed.select(
        *groups.keys, "point", "frames", "scale", take(0, 51).alias("pose"), take(51, 68).alias("scores"), take(68, 71).alias("root")
    )


def sample_series(samples: DataFrame, keys: Sequence[str]) -> OrderedGroups:
    """Resampled rows as series; a clip has a fixed small number of them."""
    return OrderedGroups(samples, keys, ["point"], F.col("point"), is_cut=False)


def joint_angles(pose: Column) -> dict[str, Column]:
    found = {}
    for i, (first, vertex, last) in enumerate(ANGLES):
        a, b = vector(pose, vertex, first), vector(pose, vertex, last)
        cosine = sum(x * y for x, y in zip(a, b)) / F.greatest(length(a) * length(b), F.lit(1e-8))
        found[f"angle{i}"] = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return found


def joint_distances(pose: Column) -> dict[str, Column]:
    return {f"distance{i}": length(vector(pose, a, b)) for i, (a, b) in enumerate(DISTANCES)}


def torso_geometry(pose: Column) -> dict[str, Column]:
    torso = [(at(pose, "l_shoulder", a) + at(pose, "r_shoulder", a)) / 2 - at(pose, "pelvis", a) for a in range(3)]
    norm = F.greatest(length(torso), F.lit(1e-8))
    found = {f"torso_{x}": torso[a] / norm for a, x in enumerate("xyz")}
    for a, x in enumerate("xyz"):
        axis = [at(pose, j, a) for j in range(JOINT_COUNT)]
        found[f"extent_{x}"] = F.greatest(*axis) - F.least(*axis)
    return found


def root_displacement(groups: OrderedGroups, root: str = "root", scale: str = "scale") -> OrderedGroups:
    groups = groups.scan(_start=skew.first_value(F.col(root)))
    moved = {
        f"root_{x}": (F.get(root, F.lit(a)) - F.get("_start", F.lit(a))) / F.greatest(F.col(scale), F.lit(1e-6))
        for a, x in enumerate("xyz")
    }
    return groups.on(groups.df.withColumns(moved).drop("_start"))


def geometry(groups: OrderedGroups, pose: str = "pose") -> OrderedGroups:
    """The 24 geometry signals of every row."""
    p = F.col(pose)
    groups = root_displacement(groups)
    return groups.on(groups.df.withColumns({**joint_angles(p), **joint_distances(p), **torso_geometry(p)}))


def joint_speeds(groups: OrderedGroups, pose: str = "pose") -> OrderedGroups:
    """Speed and acceleration magnitude of every joint; the first row is at rest."""
    groups = groups.scan(_last=skew.previous(F.col(pose)))
    moved = F.when(
        F.col("_last").isNotNull(), F.zip_with(F.col(pose), F.col("_last"), lambda a, b: a - b)
    ).otherwise(F.transform(F.col(pose), lambda v: v * 0))
    groups = groups.with_column("velocity", moved).scan(_lastv=skew.previous(F.col("velocity")))
    pushed = F.when(
        F.col("_lastv").isNotNull(), F.zip_with(F.col("velocity"), F.col("_lastv"), lambda a, b: a - b)
    ).otherwise(F.transform(F.col("velocity"), lambda v: v * 0))
    groups = groups.with_column("_push", pushed)
    norms = lambda c: F.array(*[length([at(F.col(c), j, a) for a in range(3)]) for j in range(JOINT_COUNT)])
    rows = groups.df.withColumns({"speed": norms("velocity"), "acceleration": norms("_push")})
    return groups.on(rows.drop("_last", "_lastv", "_push"))


def joint_motion(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Speed and acceleration statistics per joint."""
    cells = rows.select(*keys, F.posexplode(F.arrays_zip("speed", "acceleration")).alias("joint", "m"))
    s, a = F.col("m.speed"), F.col("m.acceleration")
    return cells.groupBy(*keys, "joint").agg(
        F.avg(s).alias("speed_mean"), F.stddev_pop(s).alias("speed_std"), F.max(s).alias("speed_max"), F.sum(s).alias("speed_sum"),
        F.avg(a).alias("accel_mean"), F.stddev_pop(a).alias("accel_std"), F.max(a).alias("accel_max"),
        F.sqrt(F.avg(a * a)).alias("accel_rms"),
    )


def score_summary(rows: DataFrame, keys: Sequence[str], frames: Column, scores: str = "scores") -> DataFrame:
    """Mean score per joint and overall figures as one array of 22."""
    cells = rows.select(*keys, frames.alias("_frames"), F.posexplode(scores).alias("joint", "s"))
    per_joint = cells.groupBy(*keys, "joint").agg(
        F.count("s").alias("_k"), F.sum("s").alias("_s"), F.sum(F.col("s") * F.col("s")).alias("_ss"),
        F.min("s").alias("_low"), F.count_if(F.col("s") < 0.5).alias("_weak"), F.max("_frames").alias("_frames"),
    )
    mean = F.sum("_s") / F.sum("_k")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("joint", (F.col("_s") / F.col("_k")).alias("m")))), lambda j: j["m"])
    overall = F.array(
        mean, F.sqrt(F.greatest(F.lit(0.0), F.sum("_ss") / F.sum("_k") - mean * mean)), F.min("_low"),
        F.sum("_weak") / F.sum("_k"), F.log1p(F.max("_frames")),
    )
    return per_joint.groupBy(*keys).agg(F.concat(ordered, overall).alias("values"))


def skeleton_base(samples: DataFrame, key: str) -> DataFrame:
    """Positions, first differences and scores of the resampled frames as one array."""
    groups = joint_speeds(sample_series(samples, [key]))
    # a clip has `skeleton_frames` rows here
    frames = F.array_sort(F.collect_list(F.struct("point", "pose", "velocity", "scores")))
    listed = groups.df.groupBy(key).agg(frames.alias("_f"))
    pick = lambda name: F.flatten(F.transform("_f", lambda f: f[name]))
    whole = F.concat(pick("pose"), pick("velocity"), pick("scores"))
    return listed.select(key, F.transform(whole, lambda v: v.cast("float")).alias("skeleton"))


def skeleton_engineered(samples: DataFrame, key: str, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    keys = [key]
    groups = joint_speeds(geometry(sample_series(samples, keys)))
    stats = S.signal_features(groups, GEOMETRY, config.temporal_bins)
    motion = joint_motion(groups.df, keys)
    periodic = {
        "root_x": F.col("root_x"), "root_y": F.col("root_y"), "root_z": F.col("root_z"),
        **{j: F.get("speed", F.lit(JOINT[j])) for j in ("l_wrist", "r_wrist", "l_ankle", "r_ankle")},
    }
    signals = groups.on(groups.df.select(key, "point", *[c.alias(n) for n, c in periodic.items()]))
    waves = S.dynamic_features(S.resample(signals, list(periodic), config.spectral_samples))
    tagged = lambda kind, name: F.concat_ws("/", F.lit(kind), F.col(name).cast("string"))
    values = lambda names: F.array(*[F.col(n).cast("double") for n in names]).alias("values")
    parts = (
        stats.select(key, tagged("signal", "channel").alias("part"), values(S.signal_columns(config.temporal_bins)))
        .unionByName(motion.select(key, tagged("speed", "joint").alias("part"), values(["speed_mean", "speed_std", "speed_max", "speed_sum"])))
        .unionByName(motion.select(key, tagged("accel", "joint").alias("part"), values(["accel_mean", "accel_std", "accel_max", "accel_rms"])))
        .unionByName(score_summary(samples, keys, F.col("frames")).select(key, F.lit("scores").alias("part"), "values"))
        .unionByName(waves.select(key, tagged("wave", "channel").alias("part"), values(S.DYNAMIC_COLUMNS)))
    )
    layout = (
        [(f"signal/{g}", config.signal_size) for g in GEOMETRY]
        + [(f"speed/{j}", 4) for j in range(JOINT_COUNT)]
        + [(f"accel/{JOINT[j]}", 4) for j in ACCELERATED]
        + [("scores", 22)] + [(f"wave/{n}", 9) for n in periodic]
    )
    return S.pack(parts, key, layout, "skeleton_engineered")


def pose_groups(frames: DataFrame) -> OrderedGroups:
    """Frame files of the skeleton scan as one ordered series per clip."""
    order = [F.coalesce("timestamp", F.lit("")), F.coalesce("frame_index", F.lit(-1)), F.element_at(F.split("path", "/"), -1), F.col("path")]
    return OrderedGroups(frames, ["clip_id"], order, None)


def skeleton_samples(frames: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    tracked = person_track(pose_groups(frames))
    rows = tracked.withColumn("pose", flat(F.col("points"))).drop("points", "people")
    return pose_samples(pose_normalize(pose_groups(rows)), config.skeleton_frames)


# ---------------------------------------------------------------- display calibration


def bone_lengths(rows: DataFrame, keys: Sequence[str], pose: str = "pose") -> DataFrame:
    """Median length of every edge over all people and frames, as one array; NULL when one has none."""
    p = F.col(pose)
    lengths = F.array(*[F.struct(F.lit(i).alias("edge"), length(vector(p, a, b)).alias("size")) for i, (a, b) in enumerate(EDGES)])
    cells = rows.select(*keys, F.inline(lengths)).filter("size > 1e-8 AND NOT isnan(size) AND size < double('inf')")
    medians = skew.quantiles(cells, [*keys, "edge"], "size", (0.5,), "_q")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("edge", F.col("_q")[0].alias("v")))), lambda e: e["v"])
    found = medians.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == len(EDGES), listed).alias("bones"))
    return rows.select(*keys).distinct().join(found, list(keys), "left")


def pose_bounds(rows: DataFrame, keys: Sequence[str], pose: str = "pose") -> DataFrame:
    """Cubic display bounds around all joints."""
    p = F.col(pose)
    ends = []
    for a, x in enumerate("xyz"):
        axis = [at(p, j, a) for j in range(JOINT_COUNT)]
        ends += [F.min(F.least(*axis)).alias(f"low_{x}"), F.max(F.greatest(*axis)).alias(f"high_{x}")]
    found = rows.groupBy(*keys).agg(*ends)
    spans = [F.col(f"high_{x}") - F.col(f"low_{x}") for x in "xyz"]
    half = F.greatest(F.greatest(*spans) * 0.58, F.lit(1e-3))
    bounds = {}
    for x in "xyz":
        middle = (F.col(f"low_{x}") + F.col(f"high_{x}")) / 2
        bounds[f"low_{x}"], bounds[f"high_{x}"] = middle - half, middle + half
    return found.withColumns(bounds)


def stabilize_pose(rows: DataFrame, keys: Sequence[str], bones: DataFrame, pose: str = "pose") -> DataFrame:
    """Rebuild each pose along the edge tree with the clip's bone lengths, keeping directions."""
    joined = rows.join(bones, list(keys), "left")
    p = F.col(pose)
    edges = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(EDGES)])

    def scaled(edge: Column) -> Column:
        gap = [F.get(p, edge["b"] * 3 + a) - F.get(p, edge["a"] * 3 + a) for a in range(3)]
        size = length(gap)
        factor = F.when(size > 1e-8, F.get("bones", edge["i"]) / size).otherwise(F.lit(0.0))
        return F.struct(edge["a"].alias("parent"), factor.alias("f"), *[g.alias(x) for g, x in zip(gap, "xyz")])

    def place(placed: Column, step: Column) -> Column:
        parent = F.get(placed, step["parent"])
        return F.concat(placed, F.array(F.struct(*[(parent[x] + step[x] * step["f"]).alias(x) for x in "xyz"])))

    # the edge list reaches the joints in index order, each after its parent
    root = F.array(F.struct(*[at(p, 0, a).alias(x) for a, x in enumerate("xyz")]))
    joints = F.aggregate(F.col("_steps"), root, place)
    rebuilt = F.flatten(F.transform(joints, lambda j: F.array(j["x"], j["y"], j["z"])))
    steps = joined.withColumn("_steps", F.transform(edges, scaled))
    return steps.withColumn(pose, F.when(F.col("bones").isNotNull(), rebuilt).otherwise(p)).drop("bones", "_steps")
