"""Near copies: MinHash with banding, verification on signatures and full sets, connected components.

1. Each text becomes the set of hashes of its word shingles. Equal sets are one class, represented by its
   least id, so exact copies cost one row however many they are.
2. ``BANDS x ROWS`` universal hash minima make the signature; classes that agree in a band share a bucket.
   A pair at similarity 0.85 misses all 32 bands of 4 rows with a probability of 6e-11, one at 0.80 with 5e-8.
3. In each bucket the member that meets most others over all its buckets is the lead. Leads are compared
   with the members of all their buckets (a star, not all pairs), first by signature, then by full sets,
   and the links are joined to components.
4. Members of one lead that are in different components by then are compared among themselves, in square
   blocks of bounded size inside tasks: by signature to see who has a possible partner at all, then on
   full sets by a product of membership matrices. Only links between components leave a block. Members of
   the lead's own component are not compared with each other; their links could change nothing.

So no candidate is skipped and no pair list of a group is written out.

Results for odd input: a null or empty text has an empty set and links with nothing; a text with fewer
words than a shingle is one shingle; rows that share an id count as one document; a null id links with
nothing, has a null component and is kept; an empty table gives an empty result; further columns are
passed over.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.components import components
from sensorframe.llm.session import dropped, stored
from sensorframe.llm.words import FOLDED, chunks, mixed, split_words, word_hashes

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 32, 4
#: Chance at most that a pair at exactly the asked similarity is dropped by its signatures.
MISSED = 1e-6
BLOCK_ROWS = 256
#: Size of the bitmap that tells most documents apart from the few whose full sets are needed (4 MB).
MARK_BITS = 1 << 25
#: Shingles of one block at most, unless a single set is larger.
BLOCK_SHINGLES = 1 << 20


def _numbers(count: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


FACTORS = _numbers(BANDS * ROWS, 1) | np.uint64(1)
ADDENDS = _numbers(BANDS * ROWS, 2)


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    words = split_words(texts, FOLDED)
    hashes = mixed(word_hashes(words.vocabulary))[words.codes]
    weight = _numbers(shingle, 3) | np.uint64(1)
    n = len(hashes)
    rolling = np.zeros(max(n - shingle + 1, 0), np.uint64)
    for k in range(shingle):
        rolling += hashes[k : n - shingle + 1 + k] * weight[k]
    rolling = mixed(rolling)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(rolling[a : b - shingle + 1]))
        elif b > a:
            # the whole sequence; its length keeps it apart from every longer one
            out.append(mixed((hashes[a:b] * weight[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over the set."""
    least = np.full(len(FACTORS), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 512):
        values = (shingles[None, at : at + 512] * FACTORS[:, None] + ADDENDS[:, None]) >> np.uint64(32)
        np.minimum(least, values.min(axis=1).astype(np.uint32), out=least)
    return least


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            sets = shingle_sets(piece.column("text"), shingle)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            minima = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                piece.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(minima, pa.binary()),
            ], ["id", "n_shingles", "digest", "minima"])

    return docs.mapInArrow(run, "id long, n_shingles long, digest binary, minima binary")


def _marks(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the bit of each node's hash set."""
    place = F.pmod(F.xxhash64("node"), F.lit(MARK_BITS))
    words = nodes.select(place.alias("place")).selectExpr("place div 64 as at", "shiftleft(1L, cast(place % 64 as int)) as bit")
    table = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(MARK_BITS // 64, np.int64)
    marks[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return marks


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Full sets of the classes' representatives.

    The bitmap spares the shuffle most other documents; the join behind it decides.
    """
    marks = docs.sparkSession.sparkContext.broadcast(_marks(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            marked = batch.filter(pa.array((marks.value[place >> 6] >> (place & 63)) & 1 == 1))
            for piece in chunks(iter([marked])):
                sets = shingle_sets(piece.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])

    placed = docs.filter("id is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(MARK_BITS)).alias("place"))
    return placed.mapInArrow(run, "node long, members binary").join(nodes.distinct(), "node", "left_semi").dropDuplicates(["node", "members"])


def _pairs_with(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    right = values.select(F.col("node").alias("b"), F.col(column).alias("of_b"))
    left = values.select(F.col("node").alias("a"), F.col(column).alias("of_a"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b")


def _linked(pairs: DataFrame, alike) -> DataFrame:
    """The pairs for which alike(of_a, of_b) holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("of_a"), batch.column("of_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def least_equal(percent: int) -> int:
    """The most equal minima that may be asked for: a pair at ``percent`` has fewer with a probability of ``MISSED`` at most."""
    n, p = BANDS * ROWS, percent / 100
    below = 0.0
    for k in range(n):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > MISSED:
            return k
    return n


def _alike_minima(percent: int):
    least = least_equal(percent)

    def alike(x: pa.Buffer, y: pa.Buffer) -> bool:
        return bool((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum() >= least)

    return alike


def _alike_sets(percent: int):
    def alike(x: pa.Buffer, y: pa.Buffer) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(a) > len(b):
            a, b = b, a
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    return alike


def _blocks(rest: DataFrame, payload: str) -> DataFrame:
    """Deal each lead's members to bounded blocks and every row to the pairs of blocks that it takes part in.

    Blocks of outsiders come first; blocks of the lead's own component pair with those only.
    """
    sizes = rest.groupBy("lead").agg(
        F.sum(F.col("outside").cast("long")).alias("n_out"), F.count(F.lit(1)).alias("n_all"), F.max("n_shingles").alias("longest"))
    each = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_SHINGLES) / F.col("longest"))))
    sizes = sizes.select("lead", F.ceil(F.col("n_out") / each).alias("out_blocks"), F.ceil((F.col("n_all") - F.col("n_out")) / each).alias("in_blocks"))
    dealt = rest.join(sizes, "lead").withColumn("block", F.expr(
        "if(outside, pmod(xxhash64(node), out_blocks), out_blocks + pmod(xxhash64(node), greatest(in_blocks, 1)))"))
    return dealt.select(
        "lead", "node", "component", "outside", "n_shingles", payload, "block",
        F.explode(F.expr("if(outside, sequence(0L, out_blocks + in_blocks - 1), sequence(0L, out_blocks - 1))")).alias("other"),
    ).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the lower and of the higher block, which may be the same."""
    block, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
    component, size = (table.column(c).to_numpy() for c in ("component", "n_shingles"))
    return np.flatnonzero(block == low), np.flatnonzero(block == high), component, size


def _possible(percent: int):
    """Members of a pair of blocks that some member of another component may match, by signature."""
    least = least_equal(percent)

    def run(table: pa.Table) -> pa.Table:
        one, two, component, size = _sides(table)
        minima = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("minima")])
        hit = np.zeros(table.num_rows, bool)
        for i in one:
            other = two[(component[two] != component[i]) & (100 * np.minimum(size[two], size[i]) >= percent * np.maximum(size[two], size[i]))]
            near = other[(minima[other] == minima[i]).sum(axis=1) >= least]
            hit[near] = True
            hit[i] |= len(near) > 0
        return table.select(["lead", "node"]).filter(pa.array(hit))

    return run


def _common(one: list[np.ndarray], two: list[np.ndarray], slab: int = 8192) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, as a product of membership matrices in slabs of columns."""
    values = np.concatenate([*one, *two])
    row = np.repeat(np.arange(len(one) + len(two)), [len(s) for s in (*one, *two)])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    column = np.cumsum(np.concatenate([[0], (values[1:] != values[:-1]).astype(np.int64)])) if len(values) else np.zeros(0, np.int64)
    often = np.bincount(column)
    shared = often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    total = np.zeros((len(one), len(two)), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + slab + 1, slab))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            member = np.zeros((len(one) + len(two), slab), np.float32)
            member[row[a:b], column[a:b] - k * slab] = 1
            total += member[: len(one)] @ member[len(one) :].T
    return total.astype(np.int64)


def _links(percent: int):
    """Links of a pair of blocks between components, only those that join what no earlier link has joined."""
    def run(table: pa.Table) -> pa.Table:
        one, two, component, size = _sides(table)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]
        node = table.column("node").to_numpy()
        both = _common([sets[i] for i in one], [sets[i] for i in two])
        union = size[one][:, None] + size[two][None, :] - both
        good = (100 * both >= percent * union) & (component[one][:, None] != component[two][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        found = []
        for i, j in zip(*np.nonzero(good)):
            x, y = root(component[one[i]]), root(component[two[j]])
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((component[one[i]], component[two[j]]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least linked id), kept (it is its component's least)."""
    rows = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("text"))
    signed = stored(_signed(rows, shingle), "signatures")
    classes = stored(signed.filter("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima")), "classes")

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("minima", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    bands = classes.select("node", F.explode(keys).alias("key"))
    crowded = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = stored(bands.join(crowded, "key"), "bands")
    weight = live.groupBy("node").agg(F.sum("n").alias("weight"))
    leads = live.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("best"))
    leads = leads.select("key", (-F.col("best")["node"]).alias("lead"))
    stars = live.join(leads, "key").filter("node != lead").select("lead", "node").distinct()
    size = classes.select("node", "n_shingles")
    stars = stored(stars.join(size, "node").join(size.select(F.col("node").alias("lead"), F.col("n_shingles").alias("of_lead")), "lead"), "stars")
    dropped(live)

    near = stars.filter(f"100 * least(n_shingles, of_lead) >= {percent} * greatest(n_shingles, of_lead)")
    near = near.select(F.col("lead").alias("a"), F.col("node").alias("b"))
    near = stored(_linked(_pairs_with(near, classes, "minima"), _alike_minima(percent)), "pairs")
    sets = stored(_sets(rows, stars.select("node").union(stars.select("lead")), shingle), "sets")
    links = stored(_linked(_pairs_with(near, sets, "members"), _alike_sets(percent)), "links")
    first = stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    # what the stars left apart
    own = first.select("node", "component")
    of_lead = own.select(F.col("node").alias("lead"), F.col("component").alias("lead_component"))
    rest = stars.join(own, "node", "left").join(of_lead, "lead", "left").select(
        "lead", "node", "n_shingles", F.coalesce("component", "node").alias("component"), F.coalesce("lead_component", "lead").alias("lead_component"))
    rest = rest.withColumn("outside", F.col("component") != F.col("lead_component"))
    open_leads = rest.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.max("outside").alias("any")).filter("n > 1 and any").select("lead")
    rest = stored(rest.join(open_leads, "lead"), "rest")
    signed_rest = rest.join(classes.select("node", "minima"), "node")
    possible = stored(_blocks(signed_rest, "minima").groupBy("lead", "low", "high").applyInArrow(_possible(percent), "lead long, node long").distinct(), "possible")
    full_rest = rest.join(possible, ["lead", "node"]).join(sets, "node")
    more = _blocks(full_rest, "members").groupBy("lead", "low", "high").applyInArrow(_links(percent), "a long, b long")
    second = stored(components(more.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    joined = second.select(F.col("node").alias("component"), F.col("component").alias("joined"))

    node_of = classes.select("digest", "node").join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))
    node_of = node_of.join(joined, "component", "left").select("digest", F.coalesce("joined", "component").alias("component"))
    named = signed.select("id", "n_shingles", "digest").join(node_of, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    result = stored(named.select("id", "n_shingles", component.alias("component_id")), "near-copies")
    dropped(signed, classes, stars, near, sets, links, first, rest, possible, second)
    # rows that share an id are one document, so the least component of its texts is the component of all
    repeated = result.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("least")).filter("n > 1 and id is not null")
    result = result.join(repeated, "id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    return result.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """The kept document of each component, with all columns; of rows equal in id and text one stays, rows without an id all stay."""
    gone = near_copies(docs, id_column, text_column, percent=percent).filter("not kept").select(F.col(id_column).alias("_gone")).distinct()
    left = docs.join(gone, docs[id_column] == gone["_gone"], "left_anti")
    named = left.filter(F.col(id_column).isNotNull()).withColumn("_text", F.xxhash64(text_column))
    return named.dropDuplicates([id_column, "_text"]).drop("_text").union(left.filter(F.col(id_column).isNull()))
