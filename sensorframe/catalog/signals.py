"""Registered queries over time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe import skew
from sensorframe.catalog.common import (
    EVENT_ROWS,
    EVENT_TYPES,
    event_series,
    micros,
    named,
    r,
    rounded,
    table,
    vector_series,
    vectors,
)
from sensorframe.operators import signal as S

PAIRS = (("click", "error"), ("purchase", "signup"), ("click", "view"),
         ("error", "view"), ("purchase", "view"), ("signup", "view"))


def signal_features(spark, folder):
    stats = S.signal_features(event_series(spark, folder), ["value"])
    return rounded(stats.drop("channel"), S.signal_columns())


def signal_sql(rows: str, keys: str, digits: int = 4) -> str:
    """Signal features over a relation with keys, pos, n, v, prev."""
    parts = []
    for b in range(4):
        inside = f"CASE WHEN n >= 4 AND part = {b + 1} THEN v END"
        point = f"sum(CASE WHEN n < 4 THEN v * greatest(0, 1 - abs({b} * (n - 1) / 3.0::DOUBLE - pos)) END)"
        parts.append(named(f"CASE WHEN max(n) < 4 THEN {point} ELSE avg({inside}) END", f"bin{b}_mean", digits))
        parts.append(named(f"CASE WHEN max(n) < 4 THEN 0 ELSE stddev_pop({inside}) END", f"bin{b}_std", digits))
    ordered = ", ".join(keys.split(","))
    return f"""
WITH r AS ({rows}), b AS (SELECT *, ntile(4) OVER (PARTITION BY {ordered} ORDER BY pos) AS part FROM r)
SELECT {ordered}, {named('avg(v)', 'mean', digits)}, {named('stddev_pop(v)', 'std', digits)}, {named('min(v)', 'min', digits)},
  {named('max(v)', 'max', digits)}, {named('quantile_cont(v, 0.25)', 'p25', digits)},
  {named('quantile_cont(v, 0.5)', 'median', digits)}, {named('quantile_cont(v, 0.75)', 'p75', digits)},
  {named('sqrt(avg(v * v))', 'rms', digits)}, {named('coalesce(avg(abs(v - prev)), 0)', 'mean_abs_diff', digits)},
  {named('CASE WHEN max(n) = 1 THEN 0 ELSE regr_slope(v, CASE WHEN n > 1 THEN pos::DOUBLE / (n - 1) ELSE 0 END) END', 'slope', digits)},
  {", ".join(parts)}
FROM b GROUP BY {ordered}"""


def gappy(groups):
    return groups.with_column("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))


def fill_gaps(spark, folder):
    filled = S.fill_gaps(gappy(event_series(spark, folder)), ["value"]).rows()
    return rounded(filled.select("event_id", "value"), ["value"])


# Gaps at every third event, filled from the valid rows on both sides.
FILLED = f"""
r AS ({EVENT_ROWS}),
g AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN v END AS k FROM r),
s AS (SELECT *,
  last_value(CASE WHEN k IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS p0,
  last_value(k IGNORE NULLS) OVER w AS v0,
  first_value(CASE WHEN k IS NOT NULL THEN pos END IGNORE NULLS) OVER u AS p1,
  first_value(k IGNORE NULLS) OVER u AS v1
  FROM g
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         u AS (PARTITION BY user_id, event_type ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, CASE WHEN k IS NOT NULL THEN k WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) * (pos - p0)::DOUBLE / (p1 - p0) END AS filled FROM s)
"""


def resampled(spark, folder, length=64):
    return S.resample(event_series(spark, folder), ["value"], length)


def resample(spark, folder):
    points = resampled(spark, folder, 16).select("user_id", "event_type", F.posexplode("samples").alias("point", "value"))
    return rounded(points, ["value"])


def resample_sql(length: int) -> str:
    """Relation s(user_id, event_type, i, v) of evenly spaced samples."""
    last = length - 1
    return f"""r AS ({EVENT_ROWS}),
s AS (SELECT user_id, event_type, i, sum(v * greatest(0, 1 - abs(i * (n - 1) / {last}.0::DOUBLE - pos))) AS v
  FROM r JOIN (SELECT unnest(range({length})) AS i) p
    ON abs(i * (n - 1) / {last}.0::DOUBLE - pos) < 1 GROUP BY user_id, event_type, i)"""


def dynamic_features(spark, folder):
    return rounded(S.dynamic_features(resampled(spark, folder)).drop("channel"), S.DYNAMIC_COLUMNS)


def dynamic_sql(relation: str, keys: list[str], length: int) -> str:
    """Dynamic figures over s(keys, i, v) with ``length`` samples per series."""
    k = ", ".join(keys)
    same = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    bins = length // 2
    return f"""
WITH {relation},
m AS (SELECT {k}, avg(v) AS mean, stddev_pop(v) AS sd, 1e-12 * max(abs(v)) AS eps FROM s GROUP BY {k}),
c AS (SELECT a.*, a.v - b.mean AS c, b.sd, b.eps, lag(a.v) OVER w AS p1, lag(a.v, 2) OVER w AS p2,
  lag(a.v - b.mean) OVER w AS cp
  FROM s a JOIN m b ON {same} WINDOW w AS (PARTITION BY {", ".join("a." + x for x in keys)} ORDER BY a.i)),
f AS (SELECT {k}, sqrt(avg((v - p1) ** 2)) AS rms_diff,
  sqrt(avg(CASE WHEN i >= 2 THEN (v - 2 * p1 + p2) ** 2 END)) AS rms_diff2,
  avg(CASE WHEN i > 0 THEN CASE WHEN (c < -eps) <> (cp < -eps) THEN 1.0 ELSE 0.0 END END) AS sign_changes,
  CASE WHEN max(sd) > 1e-12 THEN avg((c / sd) ** 3) ELSE 0 END AS skewness,
  CASE WHEN max(sd) > 1e-12 THEN avg((c / sd) ** 4) - 3 ELSE 0 END AS kurtosis,
  CASE WHEN max(sd) > 1e-12 THEN coalesce(corr(c, cp), 0) ELSE 0 END AS lag1 FROM c GROUP BY {k}),
d AS (SELECT {k}, f, sum(c * cos(2 * pi() * f * i / {length})) ** 2
    + sum(c * sin(2 * pi() * f * i / {length})) ** 2 AS power
  FROM c, (SELECT unnest(range(1, {bins + 1})) AS f) GROUP BY {k}, f),
t AS (SELECT {k}, sum(power) AS total FROM d GROUP BY {k}),
h AS (SELECT {", ".join("a." + x for x in keys)}, arg_max(f, power) / {bins}.0 AS dominant,
  -sum(power / total * ln(power / total + 1e-12)) / ln({bins}) AS entropy,
  sum(CASE WHEN f > {bins // 2} THEN power END) / max(total) AS high_share, max(total) AS total
  FROM d a JOIN t b ON {same} GROUP BY {", ".join("a." + x for x in keys)})
SELECT {", ".join("a." + x for x in keys)}, {", ".join(named("a." + x, x) for x in S.DYNAMIC_COLUMNS[:6])},
  {", ".join(named(f"CASE WHEN total > 1e-12 THEN b.{x} ELSE 0 END", x) for x in S.DYNAMIC_COLUMNS[6:])}
FROM f a JOIN h b ON {same}"""


def safe_corr(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        S.safe_corr(F.col("l_quantity"), F.col("l_extendedprice")).alias("quantity_price"),
        S.safe_corr(F.col("l_discount"), F.lit(0.5)).alias("discount_constant"),
    )
    return rounded(rows, ["quantity_price", "discount_constant"])


def circular_features(spark, folder):
    groups = event_series(spark, folder)
    groups = groups.with_column("value", F.when(F.col("event_id") % 3 != 0, F.col("value") * 7))
    return rounded(S.circular_features(groups, ["value"]).drop("channel"), S.circular_columns())


CIRCULAR_SQL = f"""
WITH {FILLED},
a AS (SELECT user_id, event_type, pos, n, radians(filled * 7) AS q, lag(radians(filled * 7)) OVER w AS was
  FROM f WHERE filled IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY pos)),
b AS (SELECT *, q - was AS ch FROM a),
c AS (SELECT *, coalesce(-sign(ch) * ceil((abs(ch) - pi()) / (2 * pi()) - 1e-9) * 2 * pi(), 0) AS fix FROM b),
d AS (SELECT *, q + coalesce(sum(fix) OVER (PARTITION BY user_id, event_type ORDER BY pos), 0) AS un,
  ntile(4) OVER (PARTITION BY user_id, event_type ORDER BY pos) AS part FROM c)
SELECT user_id, event_type, {named('avg(sin(q))', 'mean_sin')}, {named('avg(cos(q))', 'mean_cos')},
  {named('sqrt(avg(sin(q)) ** 2 + avg(cos(q)) ** 2)', 'resultant')},
  {named('stddev_pop(un) / pi()', 'unwrapped_std')}, {named('(max(un) - min(un)) / (2 * pi())', 'unwrapped_range')},
  {", ".join(named(f"avg(CASE WHEN CASE WHEN n >= 4 THEN part = {b + 1} ELSE pos = round_even({b} * (n - 1) / 3.0::DOUBLE, 0) END THEN {fn}(q) END)", f"bin{b}_{fn}") for b in range(4) for fn in ("sin", "cos"))}
FROM d GROUP BY user_id, event_type"""


def quaternion_features(spark, folder):
    rows = vectors(spark, folder).select(
        "label", "vec_id", *[F.col("embedding")[i].cast("double").alias(f"q{i}") for i in range(4)]
    )
    stats = S.quaternion_features(vector_series(rows), [f"q{i}" for i in range(4)])
    return rounded(stats, S.signal_columns())


def _quaternion_rows() -> str:
    unit = ", ".join(f"embedding[{i + 1}]::DOUBLE / greatest(nrm, 1e-8) AS u{i}" for i in range(4))
    lagged = ", ".join(f"lag(u{i}) OVER w AS w{i}" for i in range(4))
    dot = " + ".join(f"u{i} * w{i}" for i in range(4))
    signed = ", ".join(f"u{i} * sg AS u{i}" for i in range(4))
    first = ", ".join(f"first_value(u{i}) OVER w AS o{i}" for i in range(4))
    norm = " + ".join(f"embedding[{i}]::DOUBLE ** 2" for i in range(1, 5))
    return f"""
WITH q0 AS (SELECT label, vec_id, embedding, sqrt({norm}) AS nrm FROM embeddings),
q1 AS (SELECT label, vec_id, {unit} FROM q0),
q2 AS (SELECT *, {lagged} FROM q1 WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
q3 AS (SELECT *, {dot} AS dot FROM q2),
q4 AS (SELECT *, sum(CASE WHEN dot < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS turns FROM q3),
q5 AS (SELECT *, CASE WHEN turns % 2 = 1 THEN -1.0 ELSE 1.0 END::DOUBLE AS sg FROM q4),
q6 AS (SELECT label, vec_id, dot, {signed} FROM q5),
q7 AS (SELECT *, {first} FROM q6 WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
q8 AS (SELECT label, vec_id,
  u0 * o0 + u1 * o1 + u2 * o2 + u3 * o3 AS rel_w,
  -u0 * o1 + u1 * o0 - u2 * o3 + u3 * o2 AS rel_x,
  -u0 * o2 + u1 * o3 + u2 * o0 - u3 * o1 AS rel_y,
  -u0 * o3 - u1 * o2 + u2 * o1 + u3 * o0 AS rel_z,
  CASE WHEN dot IS NULL THEN 0 ELSE 2 * acos(least(1, abs(dot))) END AS step FROM q7),
q9 AS (UNPIVOT q8 ON rel_w, rel_x, rel_y, rel_z, step INTO NAME channel VALUE v)
SELECT label, channel, v, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY label, channel) AS n,
  lag(v) OVER w AS prev FROM q9 WINDOW w AS (PARTITION BY label, channel ORDER BY vec_id)"""


def pair_features(spark, folder):
    pairs = S.pair_features(resampled(spark, folder), ["user_id"], "event_type", PAIRS)
    return rounded(pairs.drop("channel"), ["corr", "rmse", "mae"])


PAIR_SQL = f"""
WITH {resample_sql(64)},
u AS (SELECT DISTINCT user_id FROM events),
p AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PAIRS)}) t(l, r)),
x AS (SELECT a.user_id, p.l, p.r, a.v AS x, b.v AS y FROM p JOIN s a ON a.event_type = p.l
  JOIN s b ON b.event_type = p.r AND b.user_id = a.user_id AND b.i = a.i),
y AS (SELECT user_id, l, r, CASE WHEN sqrt(var_pop(x) * var_pop(y)) * count(*) > 1e-12 THEN corr(x, y) ELSE 0 END AS c,
  sqrt(avg((x - y) ** 2)) AS e, avg(abs(x - y)) AS m FROM x GROUP BY user_id, l, r)
SELECT u.user_id, p.l AS "left", p.r AS "right", {named('c', 'corr')}, {named('e', 'rmse')}, {named('m', 'mae')}
FROM u CROSS JOIN p LEFT JOIN y ON y.user_id = u.user_id AND y.l = p.l AND y.r = p.r"""


def vector_shape(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_discount") * 100).alias("discount")
    )
    return rounded(S.vector_shape(rows, ["l_suppkey"], "l_quantity", "price", "discount"), S.SHAPE_COLUMNS)


VECTOR_SHAPE_SQL = f"""
WITH r AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem),
c AS (SELECT l_suppkey, count(*) AS k, var_samp(x) AS a, var_samp(y) AS b, var_samp(z) AS d, covar_samp(x, y) AS xy,
  covar_samp(x, z) AS xz, covar_samp(y, z) AS yz, corr(x, y) AS rxy, corr(x, z) AS rxz, corr(y, z) AS ryz
  FROM r GROUP BY l_suppkey),
m AS (SELECT *, (a + b + d) / 3 AS q FROM c),
p AS (SELECT *, sqrt(((a-q)**2 + (b-q)**2 + (d-q)**2 + 2 * (xy**2 + xz**2 + yz**2)) / 6) AS p FROM m),
g AS (SELECT *, acos(greatest(-1, least(1, ((a-q) * ((b-q) * (d-q) - yz**2) - xy * (xy * (d-q) - yz * xz)
  + xz * (xy * yz - (b-q) * xz)) / (2 * p**3)))) / 3 AS t FROM p),
e AS (SELECT *, q + 2 * p * cos(t) AS hi, q + 2 * p * cos(t + 2 * pi() / 3) AS lo FROM g)
SELECT l_suppkey, {named('lo', 'eig0')}, {named('3 * q - hi - lo', 'eig1')}, {named('hi', 'eig2')},
  {named('rxy', 'corr_xy')}, {named('rxz', 'corr_xz')}, {named('ryz', 'corr_yz')} FROM e"""


def series_meta(spark, folder):
    rows = table(spark, folder, "events")
    meta = S.series_meta(rows, ["user_id", "event_type"], micros("ts") / F.lit(1e6))
    return rounded(meta, S.META_COLUMNS)


SERIES_META_SQL = f"""
WITH m AS (SELECT user_id, event_type, count(*) AS k, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS d
  FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, {named('ln(1 + k)', 'log_count')}, {named('d', 'duration')},
  {named('CASE WHEN d > 1e-9 THEN (k - 1) / d ELSE 0 END', 'rate')} FROM m"""


def imu_features(spark, folder):
    packed = S.imu_features(
        event_series(spark, folder), "user_id", "event_type", EVENT_TYPES, ["value"]
    )
    values = packed.select("user_id", F.posexplode("imu").alias("position", "value"))
    return rounded(values.withColumn("value", F.col("value").cast("double") + 0.0003), ["value"], 2)


def _imu_sql() -> str:
    base = signal_sql(EVENT_ROWS, "user_id,event_type", 9)
    places = ", ".join(f"('{e}', {i * 18})" for i, e in enumerate(EVENT_TYPES))
    names = S.signal_columns()
    fields = ", ".join(f"({i}, \"{n}\")" for i, n in enumerate(names))
    return f"""
WITH b AS ({base}), t AS (SELECT * FROM (VALUES {places}) v(event_type, start)),
u AS (SELECT DISTINCT user_id FROM events),
x AS (SELECT b.user_id, b.event_type, unnest([{", ".join(str(i) for i in range(18))}]) AS j,
  unnest([{", ".join('"' + n + '"' for n in names)}]) AS v FROM b)
SELECT u.user_id, (t.start + j.j)::INTEGER AS position, {named('x.v::FLOAT::DOUBLE + 0.0003', 'value', 2)}
FROM u CROSS JOIN t CROSS JOIN (SELECT unnest(range(18)) AS j) j
LEFT JOIN x ON x.user_id = u.user_id AND x.event_type = t.event_type AND x.j = j.j"""


def wide_rows(spark, folder):
    """Events spread over the channels of an inertial row."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("clip_id"), F.col("event_type").alias("device"), "ts", "event_id", "value",
        (micros("ts") / F.lit(1e6)).alias("seconds"),
    )
    turn = F.col("event_id") * 0.37
    axes = {
        "acc_x": F.col("value"), "acc_y": F.col("value") * F.sin(turn), "acc_z": F.col("value") * F.cos(turn),
        "gyro_x": F.sin(turn), "gyro_y": F.cos(turn), "gyro_z": F.sin(turn * 3),
        "angle_x": F.col("value") * 7, "angle_y": F.col("value") * 3, "angle_z": turn * 50,
        "q0": F.cos(turn / 2), "q1": F.sin(turn / 2), "q2": F.sin(turn) / 4, "q3": F.cos(turn) / 4,
    }
    rows = rows.withColumns(axes)
    return rows.withColumns({
        "acc_norm": F.sqrt(F.col("acc_x") ** 2 + F.col("acc_y") ** 2 + F.col("acc_z") ** 2),
        "gyro_norm": F.sqrt(F.col("gyro_x") ** 2 + F.col("gyro_y") ** 2 + F.col("gyro_z") ** 2),
    })


def imu_engineered(spark, folder):
    groups = S.OrderedGroups(wide_rows(spark, folder), ["clip_id", "device"], ["ts", "event_id"], micros("ts"))
    packed = S.imu_engineered(groups, devices=EVENT_TYPES, pairs=PAIRS, seconds="seconds")
    block = F.col("imu_engineered")
    total = F.aggregate(block, F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))
    return packed.select(
        F.col("clip_id").alias("user_id"),
        F.size(block).alias("width"),
        F.size(F.filter(block, lambda v: v.isNull())).alias("missing"),
        F.round(total, 2).alias("total"),
    )


def imu_trace(spark, folder):
    rows = wide_rows(spark, folder).withColumn("time_known", F.col("ts").isNotNull())
    trace = S.imu_trace(rows.withColumn("ts", F.col("seconds")))
    return rounded(trace.withColumn("ts", F.col("ts")), ["acceleration", "gyroscope"]).withColumn(
        "ts", F.round("ts", 3)
    )


IMU_TRACE_SQL = f"""
SELECT user_id AS clip_id, event_type AS device, round(epoch_us(ts) / 1e6, 3) AS ts,
  {named('sqrt(value**2 + (value * sin(event_id * 0.37::DOUBLE))**2 + (value * cos(event_id * 0.37::DOUBLE))**2)', 'acceleration')},
  {named('sqrt(1 + sin(event_id * 0.37::DOUBLE * 3)**2)', 'gyroscope')} FROM events"""


QUERIES = {
    "signal_features": signal_features,
    "fill_gaps": fill_gaps,
    "resample": resample,
    "safe_corr": safe_corr,
    "dynamic_features": dynamic_features,
    "circular_features": circular_features,
    "quaternion_features": quaternion_features,
    "pair_features": pair_features,
    "vector_shape": vector_shape,
    "series_meta": series_meta,
    "imu_features": imu_features,
    "imu_engineered": imu_engineered,
    "imu_trace": imu_trace,
}

ORACLES = {
    "signal_features": signal_sql(EVENT_ROWS, "user_id,event_type"),
    "fill_gaps": f"WITH {FILLED} SELECT event_id, {named('filled', 'value')} FROM f",
    "resample": f"WITH {resample_sql(16)} SELECT user_id, event_type, i::INTEGER AS point, {named('v', 'value')} FROM s",
    "safe_corr": f"""SELECT l_suppkey, {named('coalesce(corr(l_quantity, l_extendedprice), 0)', 'quantity_price')},
  {named('0', 'discount_constant')} FROM lineitem GROUP BY l_suppkey""",
    "dynamic_features": dynamic_sql(resample_sql(64), ["user_id", "event_type"], 64),
    "circular_features": CIRCULAR_SQL,
    "quaternion_features": signal_sql(_quaternion_rows(), "label,channel"),
    "pair_features": PAIR_SQL,
    "vector_shape": VECTOR_SHAPE_SQL,
    "series_meta": SERIES_META_SQL,
    "imu_features": _imu_sql(),
    "imu_trace": IMU_TRACE_SQL,
}
