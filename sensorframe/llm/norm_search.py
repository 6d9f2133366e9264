"""Exact top-k inner products by norm buckets.

Vectors are sorted by length and cut into buckets of like length, longest first. A query's k-th best product so far is
its threshold t; against a bucket whose longest vector has length L, a vector can only count if its cosine with the query
reaches t / (|query| * L), the local threshold. Above 1 the bucket is passed over. Otherwise each bucket picks its way for
each query by that cosine:

* by length: the bucket's vectors that are long enough, a prefix of it;
* by coordinate: from a cosine of ``COSINE`` on, the query's ``FOCUS`` largest coordinates each leave an interval of
  directions; sorted coordinates give the shortest list, which the others thin out. It is taken where the list is
  shorter than an eighth of the prefix.

What is left is verified by whole products. Thresholds start from the bucket of the longest vectors and rise on the way;
they prune strictly, so equal scores are never lost. Queries of like need share a group, and buckets too short for a
whole group are not even shuffled to it.

Odd input: a null id, a null vector or one with a null or infinite component takes no part; an empty vector has the product 0
with every other; shorter vectors are filled up with zeros; of repeated rows each is a candidate and a query of its own;
products beyond 2^63 - 1 either way count as that; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm import vector_blocks as vb
from sensorframe.llm.session import dropped, stored
from sensorframe.llm.vector_blocks import SLACK, Best, Block

COSINE, FOCUS = 0.6, 4
#: A list of coordinates is followed if it is so many times shorter than the prefix.
GAIN = 8
FOUND = "query_key long, query_id long, vec_key long, vec_id long, score long"


class Bucket:
    """A bucket, longest vectors first, with sorted coordinates of its directions made when first asked for."""

    def __init__(self, block: Block) -> None:
        order = np.lexsort((block.ids, -block.norms))
        self.keys, self.ids, self.norms, self.values = block.keys[order], block.ids[order], block.norms[order], block.values[order]
        self.top = self.norms[0]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self._lists:
            directions = self.directions(coordinate)
            order = np.argsort(directions, kind="stable")
            self._lists[coordinate] = order, directions[order]
        return self._lists[coordinate]

    def directions(self, coordinate: int) -> np.ndarray:
        return self.values[:, coordinate] / np.maximum(self.norms, 1e-300)


def interval(component: float, cosine: float) -> tuple[float, float]:
    """Between which values a direction's coordinate lies if its cosine with a direction of that component is ``cosine`` at least."""
    a, b = np.arccos(np.clip(component, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return (np.cos(a + b) if a + b < np.pi else -1.0) - SLACK, (np.cos(a - b) if a > b else 1.0) + SLACK


class NormSearch(vb.Walk):
    def __init__(self, queries: Block, k: int) -> None:
        need = np.array([np.frombuffer(e, np.float64)[0] if e else -np.inf for e in queries.extra or [b""] * len(queries.keys)])
        order = np.argsort(need / np.maximum(queries.norms, 1e-300), kind="stable")
        self.keys, self.ids, self.norms, self.values, self.seed = queries.keys[order], queries.ids[order], queries.norms[order], queries.values[order], need[order]
        self.best = Best(len(order), k)
        self.counts = {"passed": 0, "length": 0, "coordinate": 0}

    def thresholds(self) -> np.ndarray:
        return np.maximum(self.seed, self.best.least)

    def meet(self, block: Block) -> None:
        bucket = Bucket(block)
        need = self.thresholds()
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(need > 0, need / self.norms, -np.inf) * (1 - SLACK)
            cosines = np.where(need > 0, need / (self.norms * bucket.top), -1.0) * (1 - SLACK)
        # as many vectors are long enough; a threshold of 0 or less is reached by vectors of any length
        prefix = np.searchsorted(-bucket.norms, -shortest, side="right")
        self.counts["passed"] += int((prefix == 0).sum())
        dims = min(self.values.shape[1], block.values.shape[1])
        dense = prefix > 0
        for q in np.flatnonzero(dense & (cosines >= COSINE)) if dims else []:
            if self._by_coordinate(q, bucket, cosines[q], int(prefix[q]), need[q], dims):
                dense[q] = False
        self._by_length(np.flatnonzero(dense), prefix, bucket)

    def _by_coordinate(self, q: int, bucket: Bucket, cosine: float, prefix: int, need: float, dims: int) -> bool:
        direction = self.values[q, :dims] / self.norms[q]
        focus = np.argsort(-np.abs(direction))[:FOCUS]
        ranges = {int(f): interval(direction[f], cosine) for f in focus}
        short = None
        for f, (low, high) in ranges.items():
            order, values = bucket.list_of(f)
            a, b = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
            if short is None or b - a < len(short[1]):
                short = f, order[a:b]
        if GAIN * len(short[1]) > prefix:
            return False
        self.counts["coordinate"] += 1
        left = short[1][short[1] < prefix]
        for f, (low, high) in ranges.items():
            if f != short[0]:
                values = bucket.values[left, f] / np.maximum(bucket.norms[left], 1e-300)
                left = left[(values >= low) & (values <= high)]
        if len(left):
            self._add(np.full(len(left), q), left, vb.products(self.values[q : q + 1], bucket.values[left])[0], bucket)
        return True

    def _by_length(self, chosen: np.ndarray, prefix: np.ndarray, bucket: Bucket) -> None:
        step = max(1, vb.CELLS // len(bucket.keys))
        self.counts["length"] += len(chosen)
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            long = int(prefix[part].max())
            scores = vb.products(self.values[part], bucket.values[:long])
            row, place = np.nonzero(scores >= self.thresholds()[part, None])
            self._add(part[row], place, scores[row, place], bucket)

    def _add(self, owner: np.ndarray, place: np.ndarray, scores: np.ndarray, bucket: Bucket) -> None:
        other = (bucket.keys[place] != self.keys[owner]) & (scores >= self.thresholds()[owner])
        self.best.add(owner[other], bucket.keys[place[other]], bucket.ids[place[other]], scores[other])

    def results(self) -> Iterator[pa.RecordBatch]:
        b = self.best
        if len(b.owner):
            yield pa.RecordBatch.from_arrays([
                pa.array(self.keys[b.owner]), pa.array(self.ids[b.owner]), pa.array(b.keys), pa.array(b.ids), pa.array(b.scores),
            ], ["query_key", "query_id", "vec_key", "vec_id", "score"])


def top_products(df: DataFrame, asked: Column, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of every row for which ``asked`` holds, its own row left out."""
    rows = vb.vectors(df, scale, asked, id_column, vector_column)
    # the drawn number spreads vectors of equal length
    spread = rows.withColumn("draw", F.rand(5)).repartitionByRange(F.desc("norm"), F.col("draw")).sortWithinPartitions(F.desc("norm"), "id").drop("draw")
    buckets = vb.packed(spread, "buckets")
    # one bucket, so BLOCK_ROWS vectors or BLOCK_BYTES at most
    first = buckets.orderBy(F.desc("top"), "block").limit(1).toArrow().to_batches()
    longest = df.sparkSession.sparkContext.broadcast(next((b for batch in first for b in vb.blocks_of(batch)), None))

    def thresholds(queries: Block) -> tuple[np.ndarray, list[bytes]]:
        search = NormSearch(queries, k)
        search.meet(longest.value)
        # without thresholds the search keeps the queries' order
        need = search.thresholds()
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(need > 0, need / queries.norms, 0.0), [need[i : i + 1].tobytes() for i in range(len(need))]

    queries = stored(vb.asked_vectors(buckets, thresholds), "queries")
    found = vb.walked(queries, buckets, lambda group: NormSearch(group, k), FOUND)
    # a query has k rows of each part at most
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "vec_key")
    ranked = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    dropped(queries, buckets)
    longest.unpersist()
    return ranked

