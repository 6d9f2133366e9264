"""Features of ordered sensor series, computed for all groups and channels in one pass."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe import skew
from sensorframe.functions.arrays import dynamic_figures, pair_figures
from sensorframe.schema import (
    ANGLE_CHANNELS,
    BASE_CHANNELS,
    IMU_DEVICES,
    IMU_PAIRS,
    QUATERNION_CHANNELS,
    FeatureConfig,
)
from sensorframe.skew import OrderedGroups

POS, N = "_pos", "_n"


def signal_columns(bins: int = 4) -> list[str]:
    names = ["mean", "std", "min", "max", "p25", "median", "p75", "rms", "mean_abs_diff", "slope"]
    for b in range(bins):
        names += [f"bin{b}_mean", f"bin{b}_std"]
    return names


def circular_columns(bins: int = 4) -> list[str]:
    names = ["mean_sin", "mean_cos", "resultant", "unwrapped_std", "unwrapped_range"]
    for b in range(bins):
        names += [f"bin{b}_sin", f"bin{b}_cos"]
    return names


DYNAMIC_COLUMNS = [
    "rms_diff", "rms_diff2", "sign_changes", "skewness", "kurtosis", "lag1",
    "dominant", "entropy", "high_share",
]
SHAPE_COLUMNS = ["eig0", "eig1", "eig2", "corr_xy", "corr_xz", "corr_yz"]
META_COLUMNS = ["log_count", "duration", "rate"]


def split_bin(pos: Column, n: Column, bins: int) -> Column:
    """Index of the nearly equal consecutive part a row falls in; earlier parts are longer."""
    size, longer = F.floor(n / bins), n % bins
    head = longer * (size + 1)
    return F.when(pos < head, F.floor(pos / (size + 1))).otherwise(longer + F.floor((pos - head) / size))


def nearest_part(part: int, pos: Column, n: Column, bins: int) -> Column:
    """Whether a row belongs to a part, repeating nearest rows when there are fewer than parts."""
    return F.when(n >= bins, split_bin(pos, n, bins) == part).otherwise(
        pos == F.rint(F.lit(part) * (n - 1) / (bins - 1))
    )


def hat(target: Column, length: int, pos: Column, n: Column) -> Column:
    """Weight of a row in linear interpolation at one of ``length`` evenly spaced points."""
    at = F.when(n > 1, target * (n - 1) / (length - 1)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(at - pos))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; 0 when the spread vanishes."""
    both = F.count(a)
    scale = F.sqrt(F.var_pop(a) * both * F.var_pop(b) * both)
    return F.when(scale > 1e-12, F.covar_pop(a, b) * both / scale).otherwise(F.lit(0.0))


def numbered(groups: OrderedGroups) -> OrderedGroups:
    if POS in groups.df.columns:
        return groups
    return groups.scan(**{POS: skew.position(), N: skew.total()})


def fill_gaps(groups: OrderedGroups, channels: Sequence[str]) -> OrderedGroups:
    """Linear interpolation over the row index, ends held; an all-missing channel stays NULL."""
    groups = numbered(groups)
    scans = {}
    for c in channels:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(POS).alias("p"), F.col(c).cast("double").alias("v")))
        scans[f"_before_{c}"] = skew.last_valid(known)
        scans[f"_after_{c}"] = skew.next_valid(known)
    groups = groups.scan(**scans)
    filled = {}
    for c in channels:
        a, b = F.col(f"_before_{c}"), F.col(f"_after_{c}")
        share = (F.col(POS) - a["p"]) / (b["p"] - a["p"])
        filled[c] = F.coalesce(
            F.col(c).cast("double"), a["v"] + (b["v"] - a["v"]) * share, a["v"], b["v"]
        )
    return groups.on(groups.df.withColumns(filled).drop(*scans))


def _long(groups: OrderedGroups, channels: Sequence[str], extra: dict[str, str]) -> DataFrame:
    """One row per channel value, with the columns named in ``extra`` per channel."""
    parts = [
        F.struct(
            F.lit(c).alias("channel"),
            F.col(c).cast("double").alias("v"),
            *[F.col(prefix + c).cast("double").alias(name) for name, prefix in extra.items()],
        )
        for c in channels
    ]
    return groups.df.select(*groups.keys, POS, N, F.inline(F.array(*parts)))


def signal_features(groups: OrderedGroups, channels: Sequence[str], bins: int = 4) -> DataFrame:
    """Statistics, trend and per-part moments of every (group, channel)."""
    groups = numbered(groups)
    groups = groups.scan(**{f"_prev_{c}": skew.previous(F.col(c)) for c in channels})
    rows = _long(groups, channels, {"prev": "_prev_"}).filter(F.col("v").isNotNull())
    v, pos, n = F.col("v"), F.col(POS), F.col(N)
    part = split_bin(pos, n, bins)
    at = F.when(n > 1, pos / (n - 1))
    aggregates = [
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.coalesce(F.avg(F.abs(v - F.col("prev"))), F.lit(0.0)).alias("mean_abs_diff"),
        F.coalesce(F.regr_slope(v, at), F.lit(0.0)).alias("slope"),
    ]
    for b in range(bins):
        inside = F.when(part == b, v)
        point = F.sum(F.when(n < bins, v * hat(F.lit(b), bins, pos, n)))
        aggregates += [
            F.coalesce(point, F.avg(F.when(n >= bins, inside))).alias(f"bin{b}_mean"),
            F.when(F.max(n) < bins, F.lit(0.0))
            .otherwise(F.stddev_pop(inside))
            .alias(f"bin{b}_std"),
        ]
    keys = [*groups.keys, "channel"]
    shares = (0.25, 0.5, 0.75)
    if groups.is_cut:
        stats = rows.groupBy(*keys).agg(*aggregates)
        middles = skew.quantiles(rows, keys, "v", shares, "_q")
        stats = skew._join_on(stats, middles, keys)
    else:
        quartiles = F.percentile("v", F.array(*[F.lit(s) for s in shares]))
        stats = rows.groupBy(*keys).agg(*aggregates, quartiles.alias("_q"))
    named = {"p25": F.col("_q")[0], "median": F.col("_q")[1], "p75": F.col("_q")[2]}
    return stats.withColumns(named).select(*keys, *signal_columns(bins))


def resample(groups: OrderedGroups, channels: Sequence[str], length: int) -> DataFrame:
    """Each (group, channel) as ``length`` evenly spaced, linearly interpolated samples.

    A row adds to the few points next to it only, so a long series shrinks before it is shuffled.
    """
    groups = numbered(groups)
    pos, n = F.col(POS), F.col(N)
    step = F.when(n > 1, F.lit(length - 1) / (n - 1))
    low = F.when(n > 1, F.greatest(F.lit(0), F.floor((pos - 1) * step))).otherwise(F.lit(0)).cast("int")
    high = F.when(n > 1, F.least(F.lit(length - 1), F.ceil((pos + 1) * step))).otherwise(F.lit(length - 1)).cast("int")
    near = F.explode(F.sequence(low, high)).alias("point")
    spread = groups.df.select(*groups.keys, POS, N, near, *channels)
    spread = spread.withColumn("_w", hat(F.col("point"), length, pos, n)).filter(F.col("_w") > 0)
    points = spread.groupBy(*groups.keys, "point").agg(
        *[F.sum(F.col(c).cast("double") * F.col("_w")).alias(c) for c in channels]
    )
    # at most `length` points per series remain here
    listed = points.groupBy(*groups.keys).agg(F.array_sort(F.collect_list(F.struct("point", *channels))).alias("_p"))

    def series(channel: str) -> Column:
        return F.struct(F.lit(channel).alias("channel"), F.transform("_p", lambda p: p[channel]).alias("samples"))

    rows = listed.select(*groups.keys, F.inline(F.array(*[series(c) for c in channels])))
    return rows.filter(F.col("samples")[0].isNotNull())


def dynamic_features(samples: DataFrame) -> DataFrame:
    """Motion and spectrum figures of resampled series."""
    figures = samples.withColumn("_f", dynamic_figures("samples"))
    named = {name: F.col("_f")[i] for i, name in enumerate(DYNAMIC_COLUMNS)}
    return figures.withColumns(named).drop("_f", "samples")


def circular_features(groups: OrderedGroups, channels: Sequence[str], bins: int = 4) -> DataFrame:
    """Figures of angles in degrees, free of the 360 degree jump."""
    groups = fill_gaps(groups, channels)
    turned = {f"_rad_{c}": F.radians(c) for c in channels}
    groups = groups.on(groups.df.withColumns(turned))
    groups = groups.scan(**{f"_was_{c}": skew.previous(F.col(f"_rad_{c}")) for c in channels})
    fixes = {}
    for c in channels:
        change = F.col(f"_rad_{c}") - F.col(f"_was_{c}")
        # a jump of exactly half a turn stays as it is, which no rounding of the difference may decide
        turns = F.ceil((F.abs(change) - math.pi) / (2 * math.pi) - 1e-9)
        fixes[f"_fix_{c}"] = F.coalesce(-F.signum(change) * turns * (2 * math.pi), F.lit(0.0))
    groups = groups.on(groups.df.withColumns(fixes))
    groups = groups.scan(**{f"_sum_{c}": skew.running_sum(F.col(f"_fix_{c}")) for c in channels})
    rows = _long(groups, channels, {"rad": "_rad_", "fix": "_sum_"}).filter(F.col("v").isNotNull())
    pos, n = F.col(POS), F.col(N)
    sine, cosine, unwrapped = F.sin("rad"), F.cos("rad"), F.col("rad") + F.col("fix")
    aggregates = [
        F.avg(sine).alias("mean_sin"),
        F.avg(cosine).alias("mean_cos"),
        F.hypot(F.avg(sine), F.avg(cosine)).alias("resultant"),
        (F.stddev_pop(unwrapped) / math.pi).alias("unwrapped_std"),
        ((F.max(unwrapped) - F.min(unwrapped)) / (2 * math.pi)).alias("unwrapped_range"),
    ]
    for b in range(bins):
        inside = nearest_part(b, pos, n, bins)
        aggregates += [
            F.avg(F.when(inside, sine)).alias(f"bin{b}_sin"),
            F.avg(F.when(inside, cosine)).alias(f"bin{b}_cos"),
        ]
    return rows.groupBy(*groups.keys, "channel").agg(*aggregates)


def relative_rotation(groups: OrderedGroups, channels: Sequence[str]) -> OrderedGroups:
    """Unit quaternions with continuous sign, relative to the first row, and the step angle.

    The sign turns over at every negative dot product with the row before and starts again at an
    exact zero, so it is the parity of a running count.
    """
    groups = fill_gaps(groups, channels)
    norm = F.sqrt(sum(F.col(c) * F.col(c) for c in channels))
    unit = {f"_u{i}": F.col(c) / F.greatest(norm, F.lit(1e-8)) for i, c in enumerate(channels)}
    usable = F.when(norm > 1e-8, F.lit(1)).otherwise(F.lit(0))
    groups = groups.on(groups.df.withColumns({**unit, "_usable": usable}))
    groups = groups.scan(**{f"_w{i}": skew.previous(F.col(f"_u{i}")) for i in range(4)})
    dot = sum(F.col(f"_u{i}") * F.col(f"_w{i}") for i in range(4))
    groups = groups.with_column("_dot", dot)
    groups = groups.scan(_turns=skew.running_sum(F.when(F.col("_dot") < 0, 1).otherwise(0)))
    groups = groups.scan(_mark=skew.running_max(F.when(F.col("_dot") == 0, F.col("_turns"))))
    odd = (F.col("_turns") - F.coalesce(F.col("_mark"), F.lit(0))) % 2 == 1
    sign = F.when(odd, F.lit(-1.0)).otherwise(F.lit(1.0))
    groups = groups.on(groups.df.withColumns({f"_u{i}": F.col(f"_u{i}") * sign for i in range(4)}))
    groups = groups.scan(**{f"_o{i}": skew.first_value(F.col(f"_u{i}")) for i in range(4)})
    w, x, y, z = (F.col(f"_u{i}") for i in range(4))
    a, b, c, d = F.col("_o0"), -F.col("_o1"), -F.col("_o2"), -F.col("_o3")
    turned = {
        "rel_w": w * a - x * b - y * c - z * d,
        "rel_x": w * b + x * a + y * d - z * c,
        "rel_y": w * c - x * d + y * a + z * b,
        "rel_z": w * d + x * c - y * b + z * a,
        "step": F.when(
            F.col("_dot").isNotNull(), 2 * F.acos(F.least(F.lit(1.0), F.abs(F.col("_dot"))))
        ).otherwise(F.lit(0.0)),
    }
    scratch = [f"_{p}{i}" for p in "uwo" for i in range(4)] + ["_dot", "_turns", "_mark"]
    return groups.on(groups.df.withColumns(turned).drop(*scratch))


ROTATION = ("rel_w", "rel_x", "rel_y", "rel_z", "step")


def quaternion_features(groups: OrderedGroups, channels: Sequence[str], bins: int = 4) -> DataFrame:
    groups = relative_rotation(groups, channels)
    usable = groups.df.groupBy(*groups.keys).agg(
        F.max("_usable").alias("_usable"), F.count(channels[0]).alias("_known")
    )
    usable = usable.filter((F.col("_usable") == 1) & (F.col("_known") > 0)).select(*groups.keys)
    return signal_features(groups, ROTATION, bins).join(usable, groups.keys, "left_semi")


def vector_shape(rows: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Eigenvalues (ascending) of the sample covariance and the three correlations."""
    axes = [F.col(c).cast("double") for c in (x, y, z)]
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"),
        *[F.covar_samp(axes[i], axes[j]).alias(f"_c{i}{j}") for i in range(3) for j in range(i, 3)],
        safe_corr(axes[0], axes[1]).alias("corr_xy"),
        safe_corr(axes[0], axes[2]).alias("corr_xz"),
        safe_corr(axes[1], axes[2]).alias("corr_yz"),
    )
    c = {ij: F.col(f"_c{ij}") for ij in ("00", "01", "02", "11", "12", "22")}
    middle = (c["00"] + c["11"] + c["22"]) / 3
    p = F.sqrt(
        (
            (c["00"] - middle) ** 2 + (c["11"] - middle) ** 2 + (c["22"] - middle) ** 2
            + 2 * (c["01"] ** 2 + c["02"] ** 2 + c["12"] ** 2)
        ) / 6
    )
    a, b, d = (c["00"] - middle), (c["11"] - middle), (c["22"] - middle)
    det = (
        a * (b * d - c["12"] ** 2) - c["01"] * (c["01"] * d - c["12"] * c["02"])
        + c["02"] * (c["01"] * c["12"] - b * c["02"])
    )
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p**3)))) / 3
    high = F.when(p > 0, middle + 2 * p * F.cos(angle)).otherwise(middle)
    low = F.when(p > 0, middle + 2 * p * F.cos(angle + 2 * math.pi / 3)).otherwise(middle)
    several = F.col("_k") >= 2
    shaped = {
        "eig0": F.when(several, low).otherwise(F.lit(0.0)),
        "eig1": F.when(several, 3 * middle - high - low).otherwise(F.lit(0.0)),
        "eig2": F.when(several, high).otherwise(F.lit(0.0)),
    }
    shaped |= {n: F.when(several, F.col(n)).otherwise(F.lit(0.0)) for n in SHAPE_COLUMNS[3:]}
    return moments.withColumns(shaped).select(*keys, *SHAPE_COLUMNS)


def series_meta(rows: DataFrame, keys: Sequence[str], seconds: Column) -> DataFrame:
    spans = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"), (F.max(seconds) - F.min(seconds)).alias("duration")
    )
    rate = F.when(F.col("duration") > 1e-9, (F.col("_k") - 1) / F.col("duration")).otherwise(F.lit(0.0))
    return spans.select(*keys, F.log1p("_k").alias("log_count"), "duration", rate.alias("rate"))


def pair_features(samples: DataFrame, keys: Sequence[str], device: str, pairs=IMU_PAIRS) -> DataFrame:
    """Correlation, RMSE and mean absolute difference of fixed device pairs per channel."""
    devices = sorted({d for pair in pairs for d in pair})
    wide = samples.groupBy(*keys, "channel").agg(
        *[F.max(F.when(F.col(device) == d, F.col("samples"))).alias(f"_d{i}") for i, d in enumerate(devices)]
    )
    place = {d: F.col(f"_d{i}") for i, d in enumerate(devices)}
    rows = wide.select(
        *keys,
        "channel",
        F.inline(
            F.array(*[
                F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), place[a].alias("a"), place[b].alias("b"))
                for a, b in pairs
            ])
        ),
    )
    figured = rows.withColumn("_f", pair_figures(F.col("a"), F.col("b")))
    return figured.select(
        *keys, "channel", "left", "right",
        F.col("_f")[0].alias("corr"), F.col("_f")[1].alias("rmse"), F.col("_f")[2].alias("mae"),
    )


def pack(parts: DataFrame, key: str, layout: Sequence[tuple[str, int]], name: str) -> DataFrame:
    """Concatenate named value arrays per key in a fixed layout; a missing part becomes NULLs.

    ``parts`` has one row per (key, part); the layout bounds how many there can be.
    """
    table = parts.filter(F.col("part").isin([p for p, _ in layout])).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("part", "values"))).alias("_m")
    )
    pieces = [
        F.coalesce(F.col("_m")[p], F.array_repeat(F.lit(None).cast("double"), width)) for p, width in layout
    ]
    return table.select(key, F.transform(F.concat(*pieces), lambda v: v.cast("float")).alias(name))


def _part(df: DataFrame, key: str, name: Column, columns: Sequence[str]) -> DataFrame:
    return df.select(key, name.alias("part"), F.array(*[F.col(c).cast("double") for c in columns]).alias("values"))


def imu_groups(rows: DataFrame) -> OrderedGroups:
    """Rows of the inertial scan as one ordered series per clip and device."""
    return OrderedGroups(rows, ["clip_id", "device"], ["ts", "path", "line"], F.col("ts"))


def imu_features(groups: OrderedGroups, key: str = "clip_id", device: str = "device",
                 devices: Sequence[str] = IMU_DEVICES, channels: Sequence[str] = BASE_CHANNELS,
                 bins: int = 4) -> DataFrame:
    stats = signal_features(groups, channels, bins)
    part = F.concat_ws("/", F.col(device), F.col("channel"))
    layout = [(f"{d}/{c}", 10 + 2 * bins) for d in devices for c in channels]
    return pack(_part(stats, key, part, signal_columns(bins)), key, layout, "imu")


def imu_engineered(groups: OrderedGroups, config: FeatureConfig = FeatureConfig(), *,
                   key: str = "clip_id", device: str = "device", devices: Sequence[str] = IMU_DEVICES,
                   pairs=IMU_PAIRS, base: Sequence[str] = BASE_CHANNELS,
                   angles: Sequence[str] = ANGLE_CHANNELS, rotation: Sequence[str] = QUATERNION_CHANNELS,
                   seconds: str = "ts") -> DataFrame:
    bins = config.temporal_bins
    # each part below scans and shuffles only the channels it needs
    groups = numbered(groups)
    samples = resample(groups, base, config.spectral_samples)
    named = lambda kind: F.concat_ws("/", F.lit(kind), F.col(device), F.col("channel"))
    single = lambda kind: F.concat_ws("/", F.lit(kind), F.col(device))
    keys = [key, device]
    parts = [
        _part(dynamic_features(samples), key, named("dynamic"), DYNAMIC_COLUMNS),
        _part(circular_features(groups, angles, bins), key, named("circular"), circular_columns(bins)),
        _part(quaternion_features(groups, rotation, bins), key, named("rotation"), signal_columns(bins)),
        _part(series_meta(groups.df, keys, F.col(seconds)), key, single("meta"), META_COLUMNS),
        _part(vector_shape(groups.df, keys, *base[0:3]), key, single("acc"), SHAPE_COLUMNS),
        _part(vector_shape(groups.df, keys, *base[3:6]), key, single("gyro"), SHAPE_COLUMNS),
        _part(pair_features(samples, [key], device, pairs), key,
              F.concat_ws("/", F.lit("pair"), F.col("left"), F.col("right"), F.col("channel")),
              ["corr", "rmse", "mae"]),
    ]
    layout: list[tuple[str, int]] = []
    for d in devices:
        layout += [(f"dynamic/{d}/{c}", 9) for c in base]
        layout += [(f"circular/{d}/{c}", config.circular_size) for c in angles]
        layout += [(f"rotation/{d}/{c}", config.signal_size) for c in ROTATION]
        layout += [(f"meta/{d}", 3), (f"acc/{d}", 6), (f"gyro/{d}", 6)]
    layout += [(f"pair/{a}/{b}/{c}", 3) for a, b in pairs for c in base]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return pack(rows, key, layout, "imu_engineered")


def imu_trace(rows: DataFrame) -> DataFrame:
    """Acceleration and rotation magnitudes over time, for rows with a readable time."""
    return rows.filter(F.col("time_known")).select(
        "clip_id", "device", "ts", F.col("acc_norm").alias("acceleration"), F.col("gyro_norm").alias("gyroscope")
    )
