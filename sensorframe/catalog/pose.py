"""Registered queries over poses and image frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.catalog.common import EVENT_TYPES, named, r, rounded, vector_series, vectors
from sensorframe.catalog.signals import wide_rows
from sensorframe.operators import frames as I
from sensorframe.operators import pose as P
from sensorframe.operators import signal as S
from sensorframe.plans import extract as X
from sensorframe.schema import ANGLES, DISTANCES, EDGES, IMU_DEVICES, JOINT, FeatureConfig
from sensorframe.skew import OrderedGroups, checkpointed

# ---------------------------------------------------------------- vectors as poses


def poses(spark, folder, gaps=False):
    """The first 51 numbers of a vector are a pose, shifted copies its scores."""
    pose = F.transform(F.slice("embedding", 1, 51), lambda v: v.cast("double"))
    scores = F.transform(F.slice("embedding", 48, 17), lambda v: v.cast("double") + 0.5)
    rows = vectors(spark, folder).select("label", "vec_id", pose.alias("pose"), scores.alias("scores"))
    if gaps:
        seen = F.col("vec_id") % 5 != 0
        rows = rows.withColumns({c: F.when(seen, F.col(c)) for c in ("pose", "scores")})
    return rows


def xyz(joint, axis):
    index = JOINT[joint] if isinstance(joint, str) else joint
    return f"embedding[{3 * index + axis + 1}]::DOUBLE"


def sql_vector(a, b):
    return [f"({xyz(b, k)} - {xyz(a, k)})" for k in range(3)]


def sql_length(parts):
    return "sqrt(" + " + ".join(f"{p} * {p}" for p in parts) + ")"


def joint_angles(spark, folder):
    rows = poses(spark, folder).select("vec_id", *[c.alias(n) for n, c in P.joint_angles(F.col("pose")).items()])
    return rounded(rows, rows.columns[1:])


def _angles_sql():
    parts = []
    for i, (a, v, b) in enumerate(ANGLES):
        p, q = sql_vector(v, a), sql_vector(v, b)
        dot = " + ".join(f"{x} * {y}" for x, y in zip(p, q))
        parts.append(named(f"greatest(-1, least(1, ({dot}) / greatest({sql_length(p)} * {sql_length(q)}, 1e-8)))", f"angle{i}"))
    return f"SELECT vec_id, {', '.join(parts)} FROM embeddings"


def joint_distances(spark, folder):
    rows = poses(spark, folder).select("vec_id", *[c.alias(n) for n, c in P.joint_distances(F.col("pose")).items()])
    return rounded(rows, rows.columns[1:])


def torso_geometry(spark, folder):
    groups = P.root_displacement(vector_series(
        poses(spark, folder).withColumn("root", F.slice("pose", 1, 3)).withColumn("scale", F.lit(0.5))
    ))
    found = groups.df.withColumns(P.torso_geometry(F.col("pose")))
    names = [f"{p}_{x}" for p in ("torso", "extent", "root") for x in "xyz"]
    return rounded(found.select("vec_id", *names), names)


def _torso_sql():
    torso = [f"(({xyz('l_shoulder', a)} + {xyz('r_shoulder', a)}) / 2 - {xyz('pelvis', a)})" for a in range(3)]
    norm = f"greatest({sql_length(torso)}, 1e-8)"
    parts = [named(f"{torso[a]} / {norm}", f"torso_{x}") for a, x in enumerate("xyz")]
    for a, x in enumerate("xyz"):
        axis = ", ".join(xyz(j, a) for j in range(17))
        parts.append(named(f"greatest({axis}) - least({axis})", f"extent_{x}"))
        parts.append(named(f"({xyz(0, a)} - first_value({xyz(0, a)}) OVER w) / 0.5", f"root_{x}"))
    return f"SELECT vec_id, {', '.join(parts)} FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)"


def pose_normalize(spark, folder):
    groups = P.pose_normalize(vector_series(poses(spark, folder, gaps=True)))
    return rounded(groups.df.select("vec_id", F.posexplode("pose").alias("place", "value")), ["value"])


POSE_NORMALIZE_SQL = f"""
WITH a AS (SELECT label, vec_id, embedding, vec_id % 5 <> 0 AS seen, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
b AS (SELECT *, last_value(CASE WHEN seen THEN pos END IGNORE NULLS) OVER w AS p0, first_value(CASE WHEN seen THEN pos END IGNORE NULLS) OVER u AS p1
  FROM a WINDOW w AS (PARTITION BY label ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  u AS (PARTITION BY label ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT unnest(range(51)) AS place),
c AS (SELECT b.label, b.vec_id, b.pos, k.place, coalesce(x.embedding[place + 1]::DOUBLE + CASE WHEN p1 > p0 THEN
    (y.embedding[place + 1]::DOUBLE - x.embedding[place + 1]::DOUBLE) * (b.pos - p0)::DOUBLE / (p1 - p0) ELSE 0 END,
    x.embedding[place + 1]::DOUBLE, y.embedding[place + 1]::DOUBLE) AS v
  FROM b CROSS JOIN k LEFT JOIN a x ON x.label = b.label AND x.pos = p0 LEFT JOIN a y ON y.label = b.label AND y.pos = p1),
t AS (SELECT label, vec_id, sqrt(sum((s - r) ** 2)) AS torso FROM (SELECT label, vec_id, place % 3 AS axis,
    avg(CASE WHEN place // 3 IN (11, 14) THEN v END) AS s, max(CASE WHEN place // 3 = 0 THEN v END) AS r FROM c GROUP BY label, vec_id, place % 3)
  GROUP BY label, vec_id),
s AS (SELECT label, quantile_cont(torso, 0.5) AS scale FROM t WHERE torso > 1e-6 GROUP BY label)
SELECT c.vec_id, c.place::INTEGER AS place, {named('(c.v - z.v) / greatest(coalesce(scale, 1), 1e-6)', 'value')}
FROM c JOIN c z ON z.vec_id = c.vec_id AND z.place = c.place % 3 LEFT JOIN s ON s.label = c.label"""


def joint_motion(spark, folder):
    groups = P.joint_speeds(vector_series(poses(spark, folder)))
    rows = P.joint_motion(groups.df, ["label"])
    return rounded(rows, rows.columns[2:])


JOINT_MOTION_SQL = """
WITH a AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings),
l AS (SELECT label, pos, unnest(range(51)) AS k, unnest(embedding[1:51])::DOUBLE AS v FROM a),
d AS (SELECT *, coalesce(v - lag(v) OVER (PARTITION BY label, k ORDER BY pos), 0) AS dv FROM l),
e AS (SELECT *, coalesce(dv - lag(dv) OVER (PARTITION BY label, k ORDER BY pos), 0) AS da FROM d),
j AS (SELECT label, pos, k // 3 AS joint, sqrt(sum(dv * dv)) AS s, sqrt(sum(da * da)) AS a FROM e GROUP BY label, pos, k // 3)
SELECT label, joint::INTEGER AS joint, """ + ", ".join(
    named(e, n) for e, n in (
        ("avg(s)", "speed_mean"), ("stddev_pop(s)", "speed_std"), ("max(s)", "speed_max"), ("sum(s)", "speed_sum"),
        ("avg(a)", "accel_mean"), ("stddev_pop(a)", "accel_std"), ("max(a)", "accel_max"), ("sqrt(avg(a * a))", "accel_rms"),
    )
) + " FROM j GROUP BY label, joint"


def score_summary(spark, folder):
    groups = S.numbered(vector_series(poses(spark, folder)))
    rows = P.score_summary(groups.df, ["label"], F.col(S.N))
    return rounded(rows.select("label", F.posexplode("values").alias("place", "value")), ["value"])


SCORE_SQL = f"""
WITH l AS (SELECT label, unnest(range(17)) AS j, unnest(embedding[48:64])::DOUBLE + 0.5 AS s FROM embeddings),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, j::INTEGER AS place, {named('avg(s)', 'value')} FROM l GROUP BY label, j
UNION ALL SELECT label, 17, {r('avg(s)')} FROM l GROUP BY label
UNION ALL SELECT label, 18, {r('stddev_pop(s)')} FROM l GROUP BY label
UNION ALL SELECT label, 19, {r('min(s)')} FROM l GROUP BY label
UNION ALL SELECT label, 20, {r('avg((s < 0.5)::INTEGER)')} FROM l GROUP BY label
UNION ALL SELECT label, 21, {r('ln(1 + n)')} FROM n"""


def bone_lengths(spark, folder):
    rows = P.bone_lengths(poses(spark, folder), ["label"])
    return rounded(rows.select("label", F.posexplode("bones").alias("edge", "size")), ["size"])


EDGE_LENGTHS = "[" + ", ".join(sql_length(sql_vector(a, b)) for a, b in EDGES) + "]"
BONES = f"""bones AS (SELECT label, edge, quantile_cont(size, 0.5) AS size FROM
  (SELECT label, unnest(range(16)) AS edge, unnest({EDGE_LENGTHS}) AS size FROM embeddings) WHERE size > 1e-8 GROUP BY label, edge)"""


def pose_bounds(spark, folder):
    rows = P.pose_bounds(poses(spark, folder), ["label"])
    return rounded(rows, rows.columns[1:])


BOUNDS_SQL = f"""
WITH l AS (SELECT label, unnest(range(51)) % 3 AS a, unnest(embedding[1:51])::DOUBLE AS v FROM embeddings),
m AS (SELECT label, a, min(v) AS lo, max(v) AS hi FROM l GROUP BY label, a),
h AS (SELECT label, greatest(max(hi - lo) * 0.58, 1e-3) AS half FROM m GROUP BY label)
SELECT label, {", ".join(named(f"max(CASE WHEN a = {i} THEN (lo + hi) / 2 - half END)", f"low_{x}") + ", " + named(f"max(CASE WHEN a = {i} THEN (lo + hi) / 2 + half END)", f"high_{x}") for i, x in enumerate("xyz"))}
FROM m JOIN h USING (label) GROUP BY label"""


def stabilize_pose(spark, folder):
    rows = poses(spark, folder)
    steady = P.stabilize_pose(rows, ["label"], P.bone_lengths(rows, ["label"]))
    return rounded(steady.select("vec_id", F.posexplode("pose").alias("place", "value")), ["value"])


def _stabilize_sql():
    chains = {0: []}
    for i, (a, b) in enumerate(EDGES):
        chains[b] = chains[a] + [i]
    values = []
    for joint in range(17):
        for a in range(3):
            steps = []
            for i in chains[joint]:
                s, e = EDGES[i]
                size = sql_length(sql_vector(s, e))
                steps.append(f"CASE WHEN {size} > 1e-8 THEN ({xyz(e, a)} - {xyz(s, a)}) * b[{i + 1}] / {size} ELSE 0 END")
            values.append(" + ".join([xyz(0, a), *steps]))
    return f"""WITH {BONES}, w AS (SELECT label, list(size ORDER BY edge) AS b FROM bones GROUP BY label),
x AS (SELECT vec_id, [{", ".join(values)}] AS p FROM embeddings JOIN w USING (label)),
y AS (SELECT vec_id, unnest(range(51)) AS place, unnest(p) AS v FROM x)
SELECT vec_id, place::INTEGER AS place, {named('v', 'value')} FROM y"""


def people(spark, folder):
    """Two or no people per frame, the second a moved copy of the first."""
    rows = poses(spark, folder)
    triples = lambda shift: F.transform(
        F.sequence(F.lit(0), F.lit(16)),
        lambda j: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda a: F.get(F.col("pose"), j * 3 + a) + shift),
    )
    one = lambda shift, trust: F.struct(
        triples(shift).alias("points"), F.transform("scores", lambda v: v * trust).alias("scores")
    )
    moved = F.get("pose", F.lit(50)) * 3
    none = F.array().cast("array<struct<points:array<array<double>>,scores:array<double>>>")
    listed = (
        F.when(F.col("vec_id") % 7 == 0, none).when(F.col("vec_id") % 3 == 0, F.array(one(F.lit(0.0), F.lit(1.0))))
        .otherwise(F.array(one(moved, F.lit(0.9)), one(F.lit(0.0), F.lit(1.0))))
    )
    return rows.select("label", "vec_id", listed.alias("people"))


def person_track(spark, folder):
    return P.person_track(vector_series(people(spark, folder))).select("label", "vec_id", "person")


def _person_sql():
    axes = {x: "(" + " + ".join(xyz(j, a) for j in range(17)) + ") / 17" for a, x in enumerate("xyz")}
    near = lambda shift: " + ".join(f"(e.{x} + {shift} - t.{x}) ** 2" for x in "xyz")
    moved = f"e.n = 2 AND {near('e.m')} <= {near('0')}"
    return f"""WITH RECURSIVE f AS (SELECT label, vec_id, CASE WHEN vec_id % 7 = 0 THEN 0 WHEN vec_id % 3 = 0 THEN 1 ELSE 2 END AS n,
  {", ".join(f"{c} AS {x}" for x, c in axes.items())}, embedding[51]::DOUBLE * 3 AS m FROM embeddings),
e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM f WHERE n > 0),
t AS (SELECT label, vec_id, k, n - 1 AS person, x, y, z FROM e WHERE k = 1
  UNION ALL SELECT e.label, e.vec_id, e.k, CASE WHEN {moved} THEN 0 ELSE e.n - 1 END,
    {", ".join(f"CASE WHEN {moved} THEN e.{x} + e.m ELSE e.{x} END" for x in "xyz")}
  FROM t JOIN e ON e.label = t.label AND e.k = t.k + 1)
SELECT f.label, f.vec_id, t.person FROM f LEFT JOIN t USING (vec_id)"""


def samples(spark, folder):
    return checkpointed(P.pose_samples(P.pose_normalize(vector_series(poses(spark, folder, gaps=True))), 32))


def block_summary(rows, key, block):
    values = F.col(block)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))
    return rows.select(
        key, F.size(values).alias("width"), F.size(F.filter(values, lambda v: v.isNull())).alias("missing"),
        F.round(total, 1).alias("total"),
    )


def skeleton_base(spark, folder):
    return block_summary(P.skeleton_base(samples(spark, folder), "label"), "label", "skeleton")


def skeleton_engineered(spark, folder):
    rows = P.skeleton_engineered(samples(spark, folder), "label")
    return block_summary(rows, "label", "skeleton_engineered")


# ---------------------------------------------------------------- vectors as 8 x 8 frames

SMALL = FeatureConfig(image_width=8, image_height=8, hog_cell=4, coarse_rows=4, coarse_columns=4)


def images(spark, folder):
    return vector_series(vectors(spark, folder).select("label", "vec_id", F.col("embedding").alias("image")))


def frame_summaries(spark, folder):
    rows = I.frame_summaries(images(spark, folder))
    return rounded(rows, list(I.SUMMARIES))


FRAME_ROWS = """
a AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings),
l AS (SELECT label, pos, unnest(range(64)) AS pixel, unnest(embedding)::DOUBLE AS v FROM a),
d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY label, pixel ORDER BY pos)) AS dv FROM l),
f AS (SELECT label, pixel, arg_min(v, pos) AS "first", arg_max(v, pos) AS "last", avg(v) AS mean, stddev_pop(v) AS std,
  coalesce(avg(dv), 0) AS motion FROM d GROUP BY label, pixel)"""

FRAME_SQL = f"""WITH {FRAME_ROWS} SELECT label, pixel::INTEGER AS pixel, {", ".join(named('"' + s + '"', '"' + s + '"') for s in I.SUMMARIES)} FROM f"""


def grid_pool(spark, folder):
    cells = I.pixels(images(spark, folder).rows(), ["vec_id"])
    return rounded(I.grid_pool(cells, ["vec_id"], 8, 8, 4, 4), ["value"])


GRID_SQL = f"""WITH l AS (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, ((p // 8) // 2 * 4 + (p % 8) // 2)::INTEGER AS cell, {named('avg(v)', 'value')} FROM l GROUP BY 1, 2"""


def motion_center(spark, folder):
    cells = I.frame_summaries(images(spark, folder)).select("label", "pixel", F.col("motion").alias("value"))
    return rounded(I.motion_center(cells, ["label"], 8, 8), ["center_x", "center_y"])


CENTER_SQL = f"""WITH {FRAME_ROWS} SELECT label,
  {named('CASE WHEN sum(motion) > 1e-12 THEN sum(motion * (pixel % 8) / 7.0::DOUBLE) / sum(motion) ELSE 0.5 END', 'center_x')},
  {named('CASE WHEN sum(motion) > 1e-12 THEN sum(motion * (pixel // 8) / 7.0::DOUBLE) / sum(motion) ELSE 0.5 END', 'center_y')}
FROM f GROUP BY label"""


def value_histogram(spark, folder):
    cells = I.pixels(images(spark, folder).rows(), ["label"]).withColumn("value", F.col("value").cast("double") + 0.5)
    return rounded(I.value_histogram(cells, ["label"]), ["share"])


HISTOGRAM_SQL = f"""WITH l AS (SELECT label, unnest(embedding)::DOUBLE + 0.5 AS v FROM embeddings),
c AS (SELECT label, least(floor(v * 12), 11)::INTEGER AS bin, count(*) AS c FROM l WHERE v BETWEEN 0 AND 1 GROUP BY 1, 2)
SELECT label, bin, {named('c / sum(c) OVER (PARTITION BY label)', 'share')} FROM c"""


def hog(spark, folder):
    rows = images(spark, folder).rows()
    figures = rows.select("vec_id", I.hog_features(F.col("image"), 8, 8, SMALL).alias("hog"))
    return rounded(figures.select("vec_id", F.posexplode("hog").alias("place", "value")), ["value"])


def image_base(spark, folder):
    rows = I.image_blocks(images(spark, folder), SMALL, name="depth")
    return block_summary(rows, "label", "depth")


def image_engineered(spark, folder):
    tint = F.flatten(F.transform("image", lambda v: F.array(F.abs(v), v * v, F.lit(0.5).cast("float"))))
    groups = images(spark, folder).with_column("color", tint)
    return block_summary(I.image_blocks(groups, SMALL, name="depth", base=False, color=True), "label", "depth_engineered")


def extract_blocks(spark, folder):
    """Four modalities of the same clips: frames, poses and sensor rows keyed by label."""
    clip = F.col("label").cast("string").alias("clip_id")
    clips = vectors(spark, folder).select(clip).distinct()
    frames = vectors(spark, folder).select(clip, "vec_id", F.col("embedding").alias("image"))
    frames = frames.withColumn("color", F.flatten(F.transform("image", lambda v: F.array(F.abs(v), v * v, F.abs(v)))))
    picture = OrderedGroups(frames, ["clip_id"], ["vec_id"], F.col("vec_id"))
    devices = dict(zip(EVENT_TYPES, IMU_DEVICES))
    sensor = wide_rows(spark, folder).withColumns({
        "clip_id": (F.col("clip_id") % 10).cast("string"), "ts": F.col("seconds"),
        "device": F.create_map(*[F.lit(x) for pair in devices.items() for x in pair])[F.col("device")],
    })
    imu = OrderedGroups(sensor, ["clip_id", "device"], ["ts", "event_id"], F.col("ts"))
    skeleton = samples(spark, folder).withColumnRenamed("label", "clip_id").withColumn("clip_id", F.col("clip_id").cast("string"))
    rows = X.extract_blocks(clips, SMALL, ("depth", "depth_engineered", "ir_engineered", "imu", "skeleton"),
                            depth=picture, infrared=picture, imu=imu, skeleton=skeleton)
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.transform(b, lambda v: v.cast("double")).alias("values")) for b in rows.columns[1:]])).alias("b")
    return rows.select("clip_id", each).select("clip_id", "b.block", F.posexplode("b.values").alias("position", "value")).withColumn("value", F.round("value", 4))


QUERIES = {f.__name__: f for f in (
    joint_angles, joint_distances, torso_geometry, pose_normalize, joint_motion, score_summary, bone_lengths,
    pose_bounds, stabilize_pose, person_track, skeleton_base, skeleton_engineered, frame_summaries, grid_pool,
    motion_center, value_histogram, hog, image_base, image_engineered, extract_blocks,
)}

ORACLES = {
    "joint_angles": _angles_sql(),
    "joint_distances": "SELECT vec_id, " + ", ".join(
        named(sql_length(sql_vector(a, b)), f"distance{i}") for i, (a, b) in enumerate(DISTANCES)) + " FROM embeddings",
    "torso_geometry": _torso_sql(),
    "pose_normalize": POSE_NORMALIZE_SQL,
    "joint_motion": JOINT_MOTION_SQL,
    "score_summary": SCORE_SQL,
    "bone_lengths": f"WITH {BONES} SELECT label, edge::INTEGER AS edge, {named('size', 'size')} FROM bones",
    "pose_bounds": BOUNDS_SQL,
    "stabilize_pose": _stabilize_sql(),
    "person_track": _person_sql(),
    "frame_summaries": FRAME_SQL,
    "grid_pool": GRID_SQL,
    "motion_center": CENTER_SQL,
    "value_histogram": HISTOGRAM_SQL,
}
