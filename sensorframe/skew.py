"""Ordered groups that stay distributed when one group holds much of the data.

Order-dependent work (row positions, previous row, running sums, gap filling, exact quantiles)
usually runs in a window partitioned by the group, which puts a whole group in one task. Here
groups above ``spark.sensorframe.hotGroupRows`` rows are cut into slices of consecutive rows. Every
scan is computed per slice, one summary row per slice is combined over the group, and the
combined prefix is joined back. Ordinary groups keep slice 0, and when no group is hot the plan is
the plain single-shuffle window.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS_CONF = "spark.sensorframe.hotGroupRows"
DEFAULT_HOT_ROWS = 2_000_000
BROADCAST_BOUNDS = 2_000_000
# Rows ordered by texts and lists are wide, and one task reads a whole slice of them.
ORDERED_ROWS = 250_000
SLICE = "_slice"
ORDER = "_order"


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written into the cluster's shared checkpoint folder.

    A written table is computed once and survives lost executors; ``DataFrame.checkpoint`` would
    compute the rows a second time.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join treating NULL keys as equal, keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, "left").drop(*[f"_r_{k}" for k in keys])


def _bucket(bounds: Column, value: Column, steps: int) -> Column:
    """Number of sorted bounds below value, by binary search."""
    powers = F.array(*[F.lit(2**s) for s in reversed(range(steps))])
    return F.aggregate(
        powers,
        F.lit(0),
        lambda found, step: F.when(F.get(bounds, found + step - 1) < value, found + step).otherwise(found),
    )


def sliced(df: DataFrame, keys: Sequence[str], lead: Column | None, order: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """Add the slice column; the flag says whether any group was cut.

    With a ``lead`` number hot groups are cut at its quantiles, which are stored so that every use
    sees the same cuts. Without one the rows are range-partitioned by the whole order, in slices of at
    most about ``ORDERED_ROWS``, and the stored partition number is the slice.
    """
    spark = df.sparkSession
    limit = hot_rows(spark) if lead is not None else min(hot_rows(spark), ORDERED_ROWS)
    keys = list(keys)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    found = counted.agg(F.count(F.lit(1)), F.max("_rows")).first()
    if not found[0]:
        return df, False
    if lead is None:
        parts = max(2, math.ceil(df.count() / limit))
        ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
        return checkpointed(ranged.withColumn(SLICE, F.spark_partition_id())), True
    slices = max(2, math.ceil(found[1] / limit))
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    steps = max(1, math.ceil(math.log2(slices + 1)))
    number = lead.cast("double")
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(number, shares, F.lit(max(10_000, 4 * slices))))).alias("_bounds")
    if not keys:
        # one group, so its cuts are one constant array
        ends = [float(v) for v in df.agg(cuts).first()[0] or []]
        constant = F.from_json(F.lit(json.dumps(ends)), "array<double>")
        return df.withColumn(SLICE, F.coalesce(_bucket(constant, number, steps), F.lit(0))), True
    hot = _join_on(df, counted, keys).filter(F.col("_rows").isNotNull())
    bounds = checkpointed(hot.groupBy(*keys).agg(cuts))
    if found[0] * slices <= BROADCAST_BOUNDS:
        bounds = F.broadcast(bounds)
    cut = _join_on(df, bounds, keys).withColumn(
        SLICE, F.coalesce(_bucket(F.col("_bounds"), number, steps), F.lit(0))
    )
    return cut.drop("_bounds"), True


@dataclass(frozen=True)
class Scan:
    """One order-dependent column: its kind and the column it reads."""

    kind: str
    source: Column | None = None


def position() -> Scan:
    return Scan("position")


def total() -> Scan:
    return Scan("total")


def previous(source: Column) -> Scan:
    return Scan("previous", source)


def following(source: Column) -> Scan:
    return Scan("following", source)


def running_sum(source: Column) -> Scan:
    return Scan("running_sum", source)


def running_max(source: Column) -> Scan:
    return Scan("running_max", source)


def last_valid(source: Column) -> Scan:
    return Scan("last_valid", source)


def next_valid(source: Column) -> Scan:
    return Scan("next_valid", source)


def first_value(source: Column) -> Scan:
    return Scan("first", source)


class OrderedGroups:
    """Rows of ``df`` grouped by ``keys`` and totally ordered by ``order`` within each group.

    ``lead`` is a number that grows with the order (ties allowed); it only decides where hot
    groups are cut. None cuts by the order itself.
    """

    def __init__(self, df, keys, order, lead, *, is_cut=None, scans=0):
        self.scans = scans
        self.keys = list(keys)
        # a sort evaluates its expressions at every comparison, so they become columns first
        names = [o if isinstance(o, str) else f"{ORDER}{i}" for i, o in enumerate(order)]
        made = {n: o for n, o in zip(names, order) if not isinstance(o, str)}
        df = df.withColumns(made) if made else df
        self.order = names
        self.lead = lead
        if is_cut is None:
            df, is_cut = sliced(df, self.keys, lead, names)
        self.df = df
        self.is_cut = is_cut

    def on(self, df: DataFrame) -> "OrderedGroups":
        """The same groups and slices over a derived table."""
        return OrderedGroups(df, self.keys, self.order, self.lead, is_cut=self.is_cut, scans=self.scans)

    def with_column(self, name: str, value: Column) -> "OrderedGroups":
        return self.on(self.df.withColumn(name, value))

    def rows(self) -> DataFrame:
        return self.df.drop(SLICE, *[o for o in self.order if o.startswith(ORDER)])

    def scan(self, **scans: Scan) -> "OrderedGroups":
        parts = self.keys + ([SLICE] if self.is_cut else [])
        groups = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
        ordered = groups.orderBy(*self.order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # a frame that ends at the last row is read again for every row; the same rows backwards are read once
        backwards = groups.orderBy(*[F.desc(o) for o in self.order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {}
        for name, scan in scans.items():
            src = scan.source
            local[name] = {
                "position": lambda: F.row_number().over(ordered).cast("long") - 1,
                "total": lambda: F.count(F.lit(1)).over(groups),
                "previous": lambda: F.lag(F.struct(src.alias("v"))).over(ordered),
                "following": lambda: F.lead(F.struct(src.alias("v"))).over(ordered),
                "first": lambda: F.first(src).over(upto),
                "running_sum": lambda: F.coalesce(F.sum(src).over(upto), F.lit(0)),
                "running_max": lambda: F.max(src).over(upto),
                "last_valid": lambda: F.last(src, ignorenulls=True).over(upto),
                "next_valid": lambda: F.last(src, ignorenulls=True).over(backwards),
            }[scan.kind]()
        scanned = self.df.withColumns(local)
        if not self.is_cut:
            opened = {n: F.col(n)["v"] for n, s in scans.items() if s.kind in ("previous", "following")}
            return self.on(scanned.withColumns(opened) if opened else scanned)
        base = self
        if self.scans:
            # a chain of self-joins would repeat everything before it, so keep the last result
            base = self.on(checkpointed(self.df))
            scanned = base.df.withColumns(local)
        after = base.on(base._combine(scanned, scans, parts))
        after.scans = self.scans + 1
        return after

    def _combine(self, scanned: DataFrame, scans: dict[str, Scan], parts: list[str]) -> DataFrame:
        place = F.struct(*self.order)
        summary, prefix, combined = [], {}, {}
        over_keys = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))
        by_slice = over_keys.orderBy(SLICE)
        before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
        # backwards, as in ``scan``: a frame up to the last slice is read again for every slice
        after = over_keys.orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        for name, scan in scans.items():
            src, kind = scan.source, scan.kind
            one, pre = f"_s_{name}", f"_p_{name}"
            col, held = F.col(name), F.col(pre)
            if kind in ("position", "total"):
                summary.append(F.count(F.lit(1)).alias(one))
                prefix[pre] = F.sum(one).over(before if kind == "position" else over_keys)
                combined[name] = col + F.coalesce(held, F.lit(0)) if kind == "position" else held
            elif kind == "previous":
                summary.append(F.max_by(F.struct(src.alias("v")), place).alias(one))
                prefix[pre] = F.lag(one).over(by_slice)
                combined[name] = F.coalesce(col, held)["v"]
            elif kind == "following":
                summary.append(F.min_by(F.struct(src.alias("v")), place).alias(one))
                prefix[pre] = F.lead(one).over(by_slice)
                combined[name] = F.coalesce(col, held)["v"]
            elif kind == "first":
                summary.append(F.min_by(F.struct(src.alias("v")), place).alias(one))
                prefix[pre] = F.first(one).over(before)
                combined[name] = F.when(held.isNotNull(), held["v"]).otherwise(col)
            elif kind == "running_sum":
                summary.append(F.sum(src).alias(one))
                prefix[pre] = F.sum(one).over(before)
                combined[name] = col + F.coalesce(held, F.lit(0))
            elif kind == "running_max":
                summary.append(F.max(src).alias(one))
                prefix[pre] = F.max(one).over(before)
                combined[name] = F.greatest(col, held)
            elif kind == "last_valid":
                summary.append(F.max_by(src, F.when(src.isNotNull(), place)).alias(one))
                prefix[pre] = F.last(one, ignorenulls=True).over(before)
                combined[name] = F.coalesce(col, held)
            else:
                summary.append(F.min_by(src, F.when(src.isNotNull(), place)).alias(one))
                prefix[pre] = F.last(one, ignorenulls=True).over(after)
                combined[name] = F.coalesce(col, held)
        slices = self.df.groupBy(*parts).agg(*summary).withColumns(prefix)
        slices = slices.select(*parts, *prefix)
        return _join_on(scanned, slices, parts).withColumns(combined).drop(*prefix)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str, *, may_be_hot: bool = True
) -> DataFrame:
    """Exact linear-interpolated quantiles per group as one array column.

    Ordinary groups use the built-in aggregate. With a hot group present, equal values are counted
    first and ranks are read off running counts, so no task sees a whole group. Rows are not counted
    where the caller knows that no group is hot.
    """
    keys = list(keys)
    present = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    counts = present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    limit = hot_rows(df.sparkSession)
    crowded = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    if not may_be_hot or crowded.isEmpty():
        return present.groupBy(*keys).agg(
            F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares])).alias(name)
        )
    ranked = OrderedGroups(counts, keys, ["_v"], F.col("_v")).scan(_upto=running_sum(F.col("_c")))
    rows = ranked.rows()
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    rows = _join_on(rows, totals, keys)
    aggregates = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
            aggregates.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{side}{i}"))
    found = rows.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggregates)
    mixed = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_n") - 1)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        mixed.append(low + (high - low) * (at - F.floor(at)))
    return found.select(*keys, F.array(*mixed).alias(name))
