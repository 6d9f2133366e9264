"""Labelled samples and held-out rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold_of(id_column: Column, folds: int = FOLDS) -> Column:
    """The unsigned crc32 of the id's text, modulo the number of folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_column: str = "doc_id", columns: tuple[str, ...] = ("text",),
                    folds: int = FOLDS) -> DataFrame:
    """(label, columns) of at most ``sample`` labelled documents outside fold 0, by the least hash of their id.

    An id with both labels counts as 1. Of rows that share an id one is taken, the least by its columns.
    """
    known = labels.select(labels[id_column].alias("_id"), labels[label].cast("int").alias("_label")).filter("_label in (0, 1) and _id is not null")
    chosen = known.filter(fold_of(F.col("_id"), folds) != 0).groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # at most ``sample`` rows of an id and a label, so this broadcast is bounded
    found = docs.select(docs[id_column].alias("_id"), *[docs[c] for c in columns]).join(F.broadcast(chosen), "_id")
    return found.groupBy("_id").agg(F.min(F.struct("_label", *columns)).alias("row")).select(F.col("row._label").alias("label"), *[f"row.{c}" for c in columns])
