"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

**Targets.** Sources in code point order (null last) get the weights of the cycle; all share
``share`` times the words there are. A source whose part would exceed ``most`` times its own words stops
there and the excess is shared by weight among the rest, until none is above. Comparisons are made on
whole numbers.

**Rounding.** Every document of a source should be taken target / size of the source times: that many
whole copies, and one more with the probability left over. Documents of like size are dealt to blocks of
about ``BLOCK`` rows. In a block the documents pass one by one, in order of size, against a carried one:
probability moves between the two at random until one of them has 0 or 1 and is settled; the other is
carried on. Each block leaves at most one unsettled document, and those are the rows of the next level,
so a tree of a few levels (the number of documents to the base ``BLOCK``) settles all but one document per
source, which a last draw settles. Expected copies are exact, the number of copies of a block is off by
less than one, and as neighbours in a block have like sizes, so are the words nearly.

Draws are hashes of the row and the level, so reruns agree whatever the partitions.

Results for odd input: a null text has size 0 and is taken 0 words; null is a source of its own; equal
rows are counted first, share their copies and come back as that many rows; a null id is an id like any
other; an empty table gives an empty result; further columns take part in telling rows apart (map
columns do not) and names that the operator adds replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.llm.session import dropped, stored

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST = 2
BLOCK = 256
SEED = 20240
WORD = "[^\\x20\\x09-\\x0D]+"
_NOTHING = 1e-9


def _row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[docs[c] for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row per source with its size."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stored(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    # numbers of whole partitions first, then inside each, so no task sorts all sources
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    numbered = stored(ranged.join(before, "part").select("source", "source_size", F.element_at(cycle, (place % len(weights) + 1).cast("int")).alias("weight")), "weights")
    dropped(ranged)

    # all in hundredths of words; big(a) x big(b) stays exact
    big = lambda c: c.cast("decimal(38,0)")
    total = int(numbered.agg(F.sum(big(F.col("source_size")))).first()[0] or 0) * share_percent
    cap = big(F.col("source_size")) * (100 * most)
    rest, weight = total, int(numbered.agg(F.sum("weight")).first()[0] or 0)
    above = F.lit(False)
    while weight:
        above = big(F.col("weight")) * F.lit(str(rest)).cast("decimal(38,0)") > cap * F.lit(weight).cast("decimal(38,0)")
        held, left = numbered.agg(F.sum(F.when(above, cap).otherwise(F.lit(0).cast("decimal(38,0)"))), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        now = total - int(held or 0), int(left or 0)
        if now == (rest, weight):
            break
        rest, weight = now
    open_target = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(100.0 * max(weight, 1))
    return numbered.select("source", "source_size", F.when(above if weight else F.lit(True), F.col("source_size").cast("double") * most).otherwise(open_target).alias("target"))


def _draw(level: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col("tie"), F.col("id"), F.lit(SEED + level)), 11) / F.lit(float(1 << 53))


def _settle(units: Column, kind: str) -> Column:
    """Pass the units of a block against the carried one: {done: [{unit, take}], carry}."""
    start = F.expr(f"named_struct('done', cast(array() as array<struct<unit:{kind},take:int>>), 'carry', cast(null as {kind}))")
    settled = lambda unit, take: F.struct(unit.alias("unit"), take.cast("int").alias("take"))
    with_rest = lambda unit, q: F.struct(*[(q if f == "q" else unit[f]).alias(f) for f in ("size", "id", "tie", "q", "u")])

    def step(state: Column, x: Column) -> Column:
        carry = state["carry"]
        total = carry["q"] + x["q"]
        under = total < 1
        carry_wins = F.when(under, x["u"] * total < carry["q"]).otherwise(x["u"] * (2 - total) < 1 - x["q"])
        x_leaves = under == carry_wins
        leaver, stayer = F.when(x_leaves, x).otherwise(carry), F.when(x_leaves, carry).otherwise(x)
        left = F.when(under, total).otherwise(total - 1)
        done = F.concat(state["done"], F.array(settled(leaver, ~under)))
        return (
            F.when(carry.isNull(), F.struct(state["done"].alias("done"), x.alias("carry")))
            .when(left > _NOTHING, F.struct(done.alias("done"), with_rest(stayer, left).alias("carry")))
            .otherwise(F.struct(F.concat(done, F.array(settled(stayer, F.lit(0)))).alias("done"), F.lit(None).cast(kind).alias("carry")))
        )

    return F.aggregate(units, start, step)


def _rounded(units: DataFrame, block: int) -> DataFrame:
    """(source, id, tie, take) for units (source, size, id, tie, q), 0 < q < 1."""
    kind = f"struct<size:bigint,id:{units.schema['id'].dataType.simpleString()},tie:bigint,q:double,u:double>"
    done: list[DataFrame] = []
    used: list[DataFrame] = []
    level, rest = 0, units
    while True:
        # like sizes together on the first level; what is left over by then is few and passes in order of size
        like = F.floor(F.log2(F.col("size") + 1) * 4) if level == 0 else F.lit(0).cast("long")
        rest = rest.withColumn("like", like)
        counts = rest.groupBy("source", "like").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        most = counts.agg(F.max("blocks")).first()[0]
        if not most:
            break
        named = counts.select(F.col("source").alias("_s"), F.col("like").alias("_l"), "blocks")
        dealt = rest.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("like") == F.col("_l")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("tie", F.lit(level)), F.col("blocks"))).withColumn("u", _draw(level))
        groups = dealt.groupBy("source", "like", "block").agg(F.array_sort(F.collect_list(F.struct("size", "id", "tie", "q", "u"))).alias("units"))
        passed = stored(groups.select("source", _settle(F.col("units"), kind).alias("state")), "passed")
        used.append(passed)
        done.append(passed.select("source", F.explode("state.done").alias("d")).select("source", "d.unit.id", "d.unit.tie", "d.take"))
        carried = passed.filter("state.carry is not null").select("source", "state.carry.*")
        if most == 1 and level:
            done.append(carried.withColumn("u", _draw(level + 1)).select("source", "id", "tie", (F.col("u") < F.col("q")).cast("int").alias("take")))
            break
        rest, level = carried.drop("u"), level + 1
    every = done[0] if done else units.select("source", "id", "tie", F.lit(0).alias("take"))
    for more in done[1:]:
        every = every.union(more)
    return every


def mixture(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
            weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row per distinct document row: id, tie, source, rows (how many there are), size, source_size, target, copies (of all of them)."""
    size = F.coalesce(F.regexp_count(docs[text_column].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(docs[id_column].alias("id"), docs[source_column].cast("string").alias("source"), _row_hash(docs).alias("tie"), size.alias("size"))
    rows = stored(rows.groupBy("id", "source", "tie", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    goals = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, share_percent, most)
    goals = goals.withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = rows.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("expected", F.when(F.col("size") > 0, rate * F.col("rows")).otherwise(F.lit(0.0)))
    near = F.abs(F.col("expected") - F.round("expected")) < _NOTHING
    wanted = stored(wanted.withColumn("whole", F.when(near, F.round("expected")).otherwise(F.floor("expected")).cast("long")).withColumn(
        "q", F.when(near, F.lit(0.0)).otherwise(F.col("expected") - F.floor("expected"))).drop("expected"), "wanted")
    dropped(rows)
    taken = _rounded(wanted.filter("q > 0").select("source", "size", "id", "tie", "q"), block).select(
        F.col("source").alias("_s"), F.col("id").alias("_i"), F.col("tie").alias("_t"), "take")
    same = (F.col("tie") == F.col("_t")) & F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s"))
    return wanted.join(taken, same, "left").select(
        "id", "tie", "source", "rows", "size", "source_size", "target", (F.col("whole") + F.coalesce("take", F.lit(0))).alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, copies and taken words."""
    each = mixture(docs, **options).withColumn("nth", F.explode(F.expr("sequence(0L, rows - 1)")))
    # copies are dealt evenly over equal rows
    copies = F.expr("copies div rows") + F.when(F.col("nth") < F.col("copies") % F.col("rows"), 1).otherwise(0)
    return each.select(F.col("id").alias(options.get("id_column", "doc_id")), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    plan = mixture(docs, id_column=id_column, source_column=source_column, **options).filter("copies > 0").select(
        F.col("id").alias("_i"), F.col("tie").alias("_t"), F.col("source").alias("_s"), F.col("rows").alias("_rows"), F.col("copies").alias("_copies"))
    keyed = docs.withColumn("_tie", _row_hash(docs))
    same = (F.col("_tie") == F.col("_t")) & docs[id_column].eqNullSafe(F.col("_i")) & docs[source_column].cast("string").eqNullSafe(F.col("_s"))
    found = keyed.join(plan, same)
    # equal rows are one unit: one of them stands for all
    once = found.filter("_rows = 1").unionByName(found.filter("_rows > 1").dropDuplicates(["_tie", id_column, source_column]))
    return once.withColumn("_nth", F.explode(F.expr("sequence(1L, _copies)"))).select(*docs.columns)
