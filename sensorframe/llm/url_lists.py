"""Dated URL lists: validity intervals and an as-of join with captures.

**Entries.** A list is a log of changes: at a day a pattern is added to a named list or removed from it. A
pattern is a host, which covers its subdomains, or a host with a path, which covers paths below it. The
changes of one day count by the last of them (a removal where they are equal in time). They become
intervals [from, until) by gaps and islands: an addition while active changes nothing.

**Captures.** Every capture is evaluated against the entries active on the day it was fetched. Its URL is
expanded to the patterns that could cover it (host suffixes and path prefixes: bounded by the URL's own
length), and each distinct (pattern, day) is looked up once, however many captures share it. Intervals are
stored per calendar period that they touch, so the lookup is an equal join on (pattern, period) with a
range test, and a much-captured host spreads over its periods.

Results for odd input: a capture without URL, host or fetch time matches nothing; changes without list,
pattern or time are ignored; equal changes count once, equal captures are reported one by one; empty
tables give an empty result or captures without matches; further columns of captures are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a period.
PERIOD = 32
EVER = 1 << 30


def host_of(url: Column) -> Column:
    """Lower-case host without credentials, port, final dot and leading ``www.``; empty where there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), "^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment, without slashes at its ends."""
    return F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), "^/+|/+$", "")


def patterns_of(url: Column) -> Column:
    """All patterns that cover a URL: its host and the hosts above it, and its host with every prefix of its path."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path_of(url), "/+")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", host_of(url), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    found = F.when(path_of(url) == "", suffixes).otherwise(F.concat(suffixes, prefixes))
    return F.when(host_of(url) != "", F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def day_number(time: Column) -> Column:
    return F.unix_date(F.to_date(time)).cast("long")


def intervals(changes: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_until) in day numbers from changes (list, pattern, time, added)."""
    known = changes.filter("list is not null and pattern is not null and time is not null and added is not null")
    daily = known.groupBy("list", "pattern", day_number(F.col("time")).alias("day")).agg(
        F.max(F.struct("time", (~F.col("added")).alias("gone"))).alias("last")).select("list", "pattern", "day", (~F.col("last")["gone"]).alias("added"))
    # one row a day at most, so a window is bounded by the calendar
    own = Window.partitionBy("list", "pattern").orderBy("day")
    turns = daily.withColumn("before", F.lag("added", 1, False).over(own)).filter("added != before")
    return turns.withColumn("valid_until", F.lead("day", 1, EVER).over(own)).filter("added").select(
        "list", "pattern", F.col("day").alias("valid_from"), "valid_until")


def evaluate(captures: DataFrame, changes: DataFrame, id_column: str = "page_id", url_column: str = "url", time_column: str = "fetched") -> DataFrame:
    """One row per capture: id, url, day of fetch, and the active entries that cover it as sorted [{list, pattern, valid_from}]."""
    rows = captures.select(captures[id_column].alias("_id"), captures[url_column].alias("_url"), day_number(captures[time_column]).alias("day")).withColumn(
        "_row", F.monotonically_increasing_id())
    keyed = rows.select("_id", "_url", "day", "_row", F.explode_outer(F.when(F.col("day").isNotNull(), patterns_of(F.col("_url")))).alias("pattern"))
    asked = keyed.filter("pattern is not null").select("pattern", "day").distinct()
    valid = intervals(changes)
    latest = rows.agg(F.max("day")).first()[0]
    latest = -1 if latest is None else latest
    spread = valid.filter(F.col("valid_from") <= latest).withColumn("period", F.explode(F.expr(
        f"sequence(valid_from div {PERIOD}, least(valid_until - 1, {latest}L) div {PERIOD})")))
    asof = asked.withColumn("period", F.expr(f"day div {PERIOD}")).join(spread, ["pattern", "period"]).filter("valid_from <= day and day < valid_until")
    active = asof.groupBy("pattern", "day").agg(F.collect_set(F.struct("list", "pattern", "valid_from")).alias("entries"))
    found = keyed.join(active, ["pattern", "day"], "left").groupBy("_row").agg(
        F.first("_id").alias(id_column), F.first("_url").alias(url_column), F.first("day").alias("day"), F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries"))
    return found.drop("_row")
