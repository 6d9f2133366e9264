"""Hard negatives for every (anchor, positive), by a secondary sort.

Two walks of the anchors past blocks of all vectors find what can matter: each part of the blocks gives its best rows of an
anchor's own label, and, once the positives are known, its best rows of other labels in each positive's window of scores.
Both are packed into keys (anchor, descending score, id), dealt by anchor and sorted by key while they are shuffled
(``repartitionAndSortWithinPartitions``). An iterator reads each partition once: a positive opens its window, rows of other
labels that fall into open windows are emitted, a window closes when it is full or the scores have passed it. What it holds is an anchor's
open windows, never its rows.

The window of a positive with score p takes rows with LOW * p <= 100 * score <= HIGH * p; for p < 0 it is empty, and for p = 0 it
takes scores of 0. As 0 <= LOW < HIGH <= 100, no window is above its positive.

Odd input: null ids, labels and vectors and vectors with a null or infinite component take no part; repeated rows are candidates and
anchors of their own; shorter vectors are filled up with zeros; scores beyond 2^63 - 1 either way count as that; anchors without a positive
or negative give no rows; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm import vector_blocks as vb
from sensorframe.llm.session import dropped, stored
from sensorframe.llm.vector_blocks import Best, Block

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
_PAIRS = "anchor_key long, anchor_id long, vec_key long, vec_id long, score long"
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _pairs(anchors: Block, best: Best, chosen: np.ndarray | slice = slice(None)) -> pa.RecordBatch:
    owner = best.owner[chosen]
    return pa.RecordBatch.from_arrays([
        pa.array(anchors.keys[owner]), pa.array(anchors.ids[owner]), pa.array(best.keys[chosen]), pa.array(best.ids[chosen]), pa.array(best.scores[chosen]),
    ], ["anchor_key", "anchor_id", "vec_key", "vec_id", "score"])


class PositiveWalk(vb.Walk):
    """The best other rows of each anchor's own label."""

    def __init__(self, anchors: Block, k: int) -> None:
        self.anchors, self.best = anchors, Best(len(anchors.keys), k)

    def meet(self, block: Block) -> None:
        a = self.anchors
        step = max(1, vb.CELLS // len(block.keys))
        for label in np.unique(a.labels):
            mine, there = np.flatnonzero(a.labels == label), np.flatnonzero(block.labels == label)
            for at in range(0, len(mine) if len(there) else 0, step):
                part = mine[at : at + step]
                scores = vb.products(a.values[part], block.values[there])
                row, place = np.nonzero(scores >= self.best.least[part, None])
                owner, place, found = part[row], there[place], scores[row, place]
                other = block.keys[place] != a.keys[owner]
                self.best.add(owner[other], block.keys[place[other]], block.ids[place[other]], found[other])

    def results(self) -> Iterator[pa.RecordBatch]:
        if len(self.best.owner):
            yield _pairs(self.anchors, self.best)


class NegativeWalk(vb.Walk):
    """The best rows of other labels in each of an anchor's windows."""

    def __init__(self, anchors: Block, k: int, low: int, high: int) -> None:
        self.anchors = anchors
        scores = [sorted(set(json.loads(e)), reverse=True) if e else [] for e in anchors.extra]
        most = max(map(len, scores), default=0)
        empty = (1, 0)
        #: The n-th window of every anchor side by side.
        self.windows = []
        for n in range(most):
            bounds = [window(s[n], low, high) if n < len(s) else empty for s in scores]
            self.windows.append((np.array([b[0] for b in bounds], np.float64), np.array([b[1] for b in bounds], np.float64), Best(len(scores), k)))
        self.exact = [[window(s[n], low, high) if n < len(s) else empty for s in scores] for n in range(most)]

    def meet(self, block: Block) -> None:
        a = self.anchors
        step = max(1, vb.CELLS // len(block.keys))
        for at in range(0, len(a.keys), step):
            part = np.arange(at, min(at + step, len(a.keys)))
            scores = vb.products(a.values[part], block.values)
            apart = a.labels[part, None] != block.labels[None, :]
            for (low, high, best), exact in zip(self.windows, self.exact):
                # doubles next to bounds beyond 2^53 may be off, so bounds are widened there and looked at again
                wide = np.where(np.abs(high[part]) < vb.EXACT, 0.0, np.abs(high[part]) * vb.SLACK)
                inside = (scores >= np.maximum(low[part] - wide, best.least[part])[:, None]) & (scores <= (high[part] + wide)[:, None]) & apart
                row, place = np.nonzero(inside)
                owner, found = part[row], scores[row, place]
                if wide.any():
                    right = np.array([exact[o][0] <= int(s) <= exact[o][1] for o, s in zip(owner, found)], bool)
                    owner, place, found = owner[right], place[right], found[right]
                best.add(owner, block.keys[place], block.ids[place], found)

    def results(self) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, _, best in self.windows:
            pairs = list(zip(best.owner.tolist(), best.keys.tolist()))
            yield _pairs(self.anchors, best, np.array([pair not in seen for pair in pairs], bool))
            seen.update(pairs)


def _sorted_by_anchor(pairs: DataFrame, kind: Column):
    """Records keyed (anchor, -score, kind, id, row), each partition sorted, each anchor in one partition."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = pairs.select("anchor_key", (-F.col("score")).alias("down"), kind.alias("kind"), "vec_id", "vec_key", "anchor_id")
    return keyed.rdd.map(lambda r: (tuple(r[:5]), r[5])).repartitionAndSortWithinPartitions(tasks, lambda key: (key[0] ^ (key[0] >> 33)) * 0x9E3779B1)


def first_positives(records: Iterator[tuple], k: int) -> Iterator[tuple]:
    """(anchor_key, anchor_id, vec_key, vec_id, score) of the first k records of each anchor."""
    anchor, count = None, 0
    for (key, down, _, vec, row), name in records:
        anchor, count = key, count + 1 if key == anchor else 1
        if count <= k:
            yield key, name, row, vec, -down


def mined(records: Iterator[tuple], k: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of every window, from records in the order (anchor, -score, positives first, id)."""
    anchor, windows = None, []
    for (key, down, kind, vec, _), name in records:
        if key != anchor:
            anchor, windows = key, []
        score = -down
        if kind == 0:
            least, most = window(score, low, high)
            if least <= most:
                windows.append([vec, score, least, most, 0])
            continue
        for opened in windows:
            if opened[2] <= score <= opened[3]:
                opened[4] += 1
                yield name, opened[0], opened[4], vec, opened[1], score
        windows = [w for w in windows if w[4] < k and score >= w[2]]


def hard_negatives(df: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256,
                   id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors`` holds."""
    if not 0 <= low < high <= 100:
        raise ValueError("windows need 0 <= low < high <= 100")
    spark = df.sparkSession
    blocks = vb.packed(vb.vectors(df, scale, anchors, id_column, vector_column, label), "rows")
    asked = stored(vb.asked_vectors(blocks, lambda b: (np.zeros(len(b.keys)), [b""] * len(b.keys))), "anchors")
    near = vb.walked(asked, blocks, lambda group: PositiveWalk(group, positives), _PAIRS)
    first = _sorted_by_anchor(near, F.lit(0)).mapPartitions(lambda records: first_positives(records, positives))
    chosen = stored(spark.createDataFrame(first, _PAIRS, verifySchema=False), "positives")
    scores = chosen.groupBy(F.col("anchor_key").alias("key")).agg(F.encode(F.to_json(F.collect_list("score")), "utf-8").alias("extra"))
    told = asked.drop("extra").join(scores, "key")
    apart = vb.walked(told, blocks, lambda group: NegativeWalk(group, negatives, low, high), _PAIRS)
    both = chosen.withColumn("kind", F.lit(0)).unionByName(apart.withColumn("kind", F.lit(1)))
    rows = _sorted_by_anchor(both, F.col("kind")).mapPartitions(lambda records: mined(records, negatives, low, high))
    found = stored(spark.createDataFrame(rows, _MINED, verifySchema=False), "mined")
    dropped(blocks, asked, chosen)
    return found
