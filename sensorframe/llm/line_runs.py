"""Repeated runs of lines, from a suffix array over line ids, in DataFrame operations only.

**Sequences.** A document is the sequence of its lines (\\n-split) that hold anything but white space; a line's
id is a 64-bit hash of it. A suffix begins at one line and ends with its document.

**Suffix array.** Suffixes are ranked by their first 1, 2, 4, ... lines (prefix doubling): a round joins each
suffix that still shares its rank with the rank of the suffix that many lines ahead (0 where the document has
ended, which settles the suffix), counts the distinct pairs, and ranks the pairs. Ranks are running sums of
those counts over range partitions: each partition sums its own rows, and the sums of the partitions before
are added, so no task sorts or counts everything and a line that fills a third of the corpus is one row.

**Common prefixes.** Suffixes with equal ranks are ordered by place, all are numbered, and neighbours are
compared from the widest doubling down: where their ranks at a width agree, the common prefix grows by that
width and both move on.

**Deletion.** Cutting the array where neighbours have fewer than ``min_lines`` common lines leaves intervals of
suffixes that begin alike. The earliest place of an interval (by id, then row, then line) stays; every other
begins a later copy, whose lines are deleted. The copies that begin inside a longer run cover the rest of it. Cutting it where
neighbours have no common line leaves the copies of single lines, of which those with more than ``long_words`` words go in the same way: a
passage that is one line is as long a repetition as one of several short lines.

Results for odd input: null and empty texts have no lines and stay as they are; blank lines are never part of
a run and stay; of equal rows the first by a row number keeps its lines; null ids come first; an empty table
gives an empty result; further columns are passed over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.session import dropped, stored

MIN_LINES = 2
#: A single line with more words than this is a run by itself.
LONG_WORDS = 50


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before, in an order without ties."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    # one row a partition in this window
    before = ranged.groupBy("_part").agg(F.sum(value).alias("_sum")).select(
        "_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, "_part")
    out = stored(summed.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside"), "running")
    dropped(ranged)
    return out


def line_table(numbered: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc, id, at, line_number, key, long) of the lines that hold something; ``at`` numbers them from 0 in each document."""
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_number"), x.alias("line")))
    filled = F.filter(parts, lambda p: p["line"].rlike("[^\\x20\\x09-\\x0D]"))
    return numbered.select("doc", "id", F.posexplode(filled).alias("at", "part")).select(
        "doc", "id", "at", F.col("part.line_number").alias("line_number"), F.xxhash64("part.line").alias("key"), _is_long(F.col("part.line"), long_words).alias("long"))


def _is_long(line: Column, words: int) -> Column:
    """Whether a line has more than so many words. Only lines with other white space than single blanks between words are split for it."""
    blanks = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for white in ("  ", "\t", "\v", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(white))
    split = F.size(F.regexp_extract_all(line, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    # with one word more a line has two bytes for each, less one
    return F.when(F.octet_length(line) > 2 * words, F.when(odd, split).otherwise(blanks + 1) > words).otherwise(False)


def doubled_ranks(lines: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """All suffixes (doc, id, at, rank), the stored rounds they are in, and per doubling those that share its width with others."""
    last = lines.groupBy("doc").agg(F.max("at").alias("last"))
    keys = running(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")), ["key"], "n", "rank")
    active = stored(lines.join(keys, "key").join(last, "doc").select("doc", "id", "at", "last", (F.col("rank") + 1).alias("rank"), "n"), "suffixes")
    dropped(keys)
    rounds, levels, width = [active], [], 1
    while True:
        # suffixes that still share their rank, and of those the ones as wide as the doubling
        active = rounds[-1].filter("n > 1")
        level = stored(active.filter(f"at + {width} - 1 <= last").select("doc", "at", "rank"), "level")
        if level.isEmpty():
            dropped(level)
            return reduce(DataFrame.unionByName, [r.filter("n <= 1") for r in rounds] + [active]), rounds, levels
        levels.append(level)
        # ranks of settled suffixes stay as they are, and only documents with a suffix in play are looked up
        known = reduce(DataFrame.unionByName, [r.filter("n <= 1") for r in rounds] + [active])
        ahead = known.join(active.select("doc").distinct(), "doc", "left_semi").select("doc", (F.col("at") - width).alias("at"), F.col("rank").alias("next"))
        pairs = stored(active.join(ahead, ["doc", "at"], "left").select(
            "doc", "id", "at", "last", "rank", F.coalesce("next", F.lit(0)).alias("next")), "pairs")
        counted = running(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")), ["rank", "next"], "n", "sum")
        group = counted.groupBy("rank").agg(F.min("sum").alias("base"))
        # a pair with next = 0 has ended: its suffixes are equal, which n = 0 marks as settled
        wider = counted.join(group, "rank").select(
            "rank", "next", (F.col("rank") + F.col("sum") - F.col("base")).alias("new"), F.when(F.col("next") > 0, F.col("n")).otherwise(0).alias("n"))
        rounds.append(stored(pairs.join(wider, ["rank", "next"]).select("doc", "id", "at", "last", F.col("new").alias("rank"), "n"), "suffixes"))
        dropped(pairs, counted)
        width *= 2


def common_prefixes(every: DataFrame, levels: list[DataFrame], min_lines: int) -> DataFrame:
    """The suffix array of suffixes that share ``min_lines`` lines at the least doubling below: (place, doc, id, at, common with the one before)."""
    floor = min(min_lines.bit_length() - 1, len(levels) - 1)
    held = every.join(levels[floor].select("doc", "at"), ["doc", "at"], "left_semi").select("rank", "id", "doc", "at", F.lit(1).alias("one"))
    array = running(held, ["rank", "id", "doc", "at"], "one", "place").drop("one")
    before = array.select((F.col("place") + 1).alias("place"), F.col("doc").alias("b_doc"), F.col("at").alias("b_at"))
    pairs = stored(array.join(before, "place").select("place", "doc", "at", "b_doc", "b_at", F.lit(0).cast("long").alias("common")), "neighbours")
    for k in range(len(levels) - 1, -1, -1):
        one = levels[k].select("doc", F.col("at").cast("long").alias("at_a"), F.col("rank").alias("a_rank"))
        two = levels[k].select(F.col("doc").alias("b_doc"), F.col("at").cast("long").alias("at_b"), F.col("rank").alias("b_rank"))
        moved = pairs.withColumn("at_a", F.col("at") + F.col("common")).withColumn("at_b", F.col("b_at") + F.col("common"))
        moved = moved.join(one, ["doc", "at_a"], "left").join(two, ["b_doc", "at_b"], "left")
        after = stored(moved.select("place", "doc", "at", "b_doc", "b_at", (F.col("common") + F.when(F.col("a_rank") == F.col("b_rank"), 1 << k).otherwise(0)).alias("common")), "neighbours")
        dropped(pairs)
        pairs = after
    return array.join(pairs.select("place", "common"), "place", "left").select("place", "doc", "id", "at", F.coalesce("common", F.lit(0)).alias("common"))


def later_copies(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc, at, length) where a run of ``min_lines`` or more lines, or one long line, begins that an earlier place has as well.

    ``length`` is the number of lines that go for it: ``min_lines``, or 1.
    """
    every, rounds, levels = doubled_ranks(lines.drop("long"))
    if not levels:
        return lines.select("doc", "at", F.lit(1).alias("length")).limit(0)
    # the least doubling: suffixes of one rank share their first line, so its intervals need no lengths
    single = rounds[0].filter("n > 1").join(lines.filter("long").select("doc", "at"), ["doc", "at"], "left_semi")
    first = single.groupBy("rank").agg(F.min(F.struct("id", "doc", "at")).alias("first"))
    alone = stored(single.join(first, "rank").filter("doc != first.doc or at != first.at").select("doc", "at", F.lit(1).alias("length")), "copies")
    array = common_prefixes(every, levels, min_lines)
    # each interval has the number of cuts up to its first place
    cut = array.withColumn("cut", (F.col("common") < min_lines).cast("int"))
    intervals = running(cut, ["place"], "cut", "cuts").withColumn("interval", F.col("cuts") + F.col("cut"))
    earliest = intervals.groupBy("interval").agg(F.min(F.struct("id", "doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = intervals.join(earliest, "interval").filter("doc != first.doc or at != first.at").select("doc", "at", F.lit(min_lines).alias("length"))
    found = stored(copies.unionByName(alone), "copies")
    dropped(intervals, alone, *rounds, *levels)
    return found


def without_repeated_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_lines: int = MIN_LINES,
                          long_words: int = LONG_WORDS) -> DataFrame:
    """One row per document: id, n_lines (that hold something), n_deleted, deleted (line numbers from 0) and the text without them."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    numbered = stored(rows.withColumn("doc", F.monotonically_increasing_id()), "numbered")
    lines = stored(line_table(numbered, long_words), "lines")
    copies = later_copies(lines.drop("line_number"), min_lines)
    covered = copies.select("doc", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("at")).distinct()
    gone = lines.join(covered, ["doc", "at"], "left_semi").groupBy("doc").agg(F.sort_array(F.collect_list("line_number")).alias("deleted"))
    counts = lines.groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"))
    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("deleted"))
    text = F.when(F.col("deleted").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    return numbered.join(gone, "doc", "left").join(counts, "doc", "left").select(
        F.col("id").alias(id_column), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"), text.alias(text_column))
