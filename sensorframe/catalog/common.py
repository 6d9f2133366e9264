"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.functions.columns import shown
from sensorframe.skew import OrderedGroups

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(moment: str) -> Column:
    return F.unix_micros(F.col(moment).cast("timestamp"))


def event_series(spark: SparkSession, folder: str) -> OrderedGroups:
    """Events as sensor rows: a user is a clip, an event type a device."""
    rows = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return OrderedGroups(rows, ["user_id", "event_type"], ["ts", "event_id"], micros("ts"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def vector_series(rows: DataFrame) -> OrderedGroups:
    """Vectors as frames: a label is a clip, the vector number its frame number."""
    return OrderedGroups(rows, ["label"], ["vec_id"], F.col("vec_id"))


def rounded(df: DataFrame, names, digits: int = 4) -> DataFrame:
    return df.withColumns({n: shown(F.col(n), digits) for n in names})


def r(expression: str, digits: int = 4) -> str:
    return f"(round(({expression})::DOUBLE + 1.3e-7, {digits}) + 0.0)"


def named(expression: str, name: str, digits: int = 4) -> str:
    return f"{r(expression, digits)} AS {name}"


# Rows of a series with place, size and the row before, for the SQL twins.
EVENT_ROWS = """
SELECT user_id, event_type, ts, event_id, value AS v,
       row_number() OVER w - 1 AS pos,
       count(*) OVER (PARTITION BY user_id, event_type) AS n,
       lag(value) OVER w AS prev
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
"""
