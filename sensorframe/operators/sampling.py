"""Positions, even and stratified sampling, and the walk over unlabeled items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe import skew
from sensorframe.functions.columns import natural_key
from sensorframe.skew import OrderedGroups


def numbered(groups: OrderedGroups, position: str = "position", total: str | None = None) -> DataFrame:
    scans = {position: skew.position()}
    if total:
        scans[total] = skew.total()
    return groups.scan(**scans).rows()


def evenly_sample(groups: OrderedGroups, count: int, *, middle: bool = False, keep_order: bool = False) -> DataFrame:
    """Keep ``count`` evenly spaced rows per group, or all of a smaller group.

    With ``middle`` a sample of one takes the row in the middle instead of the first.
    """
    numbered_ = groups.scan(_pos=skew.position(), _n=skew.total())
    rows = numbered_.df.drop(skew.SLICE) if keep_order else numbered_.rows()
    pos, n = F.col("_pos"), F.col("_n")
    if count == 1:
        kept = pos == (F.floor(n / 2) if middle else F.lit(0))
    else:
        # the targets next to a row are found by rounding back, so no list of targets is joined
        guess = F.rint(pos * (count - 1) / (n - 1))
        kept = F.lit(False)
        for shift in (-1, 0, 1):
            target = guess + shift
            kept = kept | (target.between(0, count - 1) & (F.rint(target * (n - 1) / (count - 1)) == pos))
    return rows.filter((n <= count) | kept).drop("_pos", "_n")


def member_order(timestamp: str = "timestamp", frame: str = "frame_index", path: str = "member_path") -> list[Column]:
    return [F.coalesce(F.col(timestamp), F.lit("")), F.coalesce(F.col(frame), F.lit(-1)), F.col(path)]


def manifest_order() -> list[Column]:
    return [
        F.when(F.col("split") == "train", 0).otherwise(1),
        F.coalesce(F.col("action_id"), F.lit(10_000)),
        natural_key(F.col("user")),
        natural_key(F.col("trial")),
        natural_key(F.col("clip_id")),
    ]


def round_robin_sample(groups: OrderedGroups, stratum_order: Sequence[Column], count: int) -> DataFrame:
    """First row of every stratum, then second of every stratum, and so on, ``count`` rows in all.

    Only rows with a position below ``count`` can be taken, so the final sort is small.
    """
    rows = groups.scan(_round=skew.position()).rows().filter(F.col("_round") < count)
    return rows.orderBy("_round", *stratum_order).limit(count).drop("_round")


def split_budget(available: dict[str, int], count: int) -> dict[str, int]:
    """Divide a budget over splits; what one split cannot use goes to the other."""
    if not available or count <= 0:
        return {name: 0 for name in available}
    base, rest = divmod(count, len(available))
    quota = {
        name: min(size, base + (1 if i < rest else 0)) for i, (name, size) in enumerate(available.items())
    }
    spare = count - sum(quota.values())
    for name, size in available.items():
        extra = min(spare, size - quota[name])
        quota[name] += extra
        spare -= extra
    return quota


def initial_unlabeled(rows: DataFrame, item: str, place: str, labeled: Column) -> DataFrame:
    """First item without a label, or the first item when all have one."""
    found = rows.agg(
        F.min_by(item, F.when(~labeled, F.col(place))).alias("_open"), F.min_by(item, place).alias("_first")
    )
    return found.select(F.coalesce("_open", "_first").alias(item))


def next_unlabeled(rows: DataFrame, item: str, place: str, labeled: Column) -> DataFrame:
    """For every item the next other item without a label, searching in a circle.

    When no other item is open, the neighbour that follows.
    """
    groups = OrderedGroups(rows.withColumn("_done", labeled), [], [place], F.col(place))
    here = F.struct(F.col(place).alias("p"), F.col(item).alias("v"))
    open_here = F.when(~F.col("_done"), here)
    groups = groups.scan(_after=skew.following(here))
    groups = groups.with_column("_open", open_here)
    ahead = groups.scan(_ahead=skew.next_valid(F.col("_open")))
    ahead = ahead.scan(_skip=skew.following(F.col("_ahead"))).rows()
    ends = rows.withColumn("_done", labeled)
    both = ends.agg(F.struct(F.min_by(here, place).alias("first"), F.min(open_here).alias("open"))).scalar()
    first, first_open = both["first"], both["open"]
    wrapped = F.when(first_open["v"] != F.col(item), first_open["v"])
    return ahead.withColumn(
        "next_item", F.coalesce(F.col("_skip")["v"], wrapped, F.col("_after")["v"], first["v"])
    ).drop("_done", "_after", "_open", "_ahead", "_skip")
