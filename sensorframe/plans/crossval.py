"""Participant-grouped, stratified, repeated cross-validation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe import skew
from sensorframe.operators.clips import DataError, require_none
from sensorframe.plans import evaluate as E
from sensorframe.plans.foldstats import fold_preprocessor
from sensorframe.plans.models import Algorithm
from sensorframe.plans.prep import PARALLEL_FITS
from sensorframe.plans.sums import fold_sums
from sensorframe.schema import METRICS


#: Groups that one task deals out.
SLICE_GROUPS = 100_000


def _deal(totals: list[list[int]], vector: Sequence[int], weights: Sequence[int], open_folds: Sequence[int]) -> int:
    """The fold that is fed best: the one that has least of what the vector holds, each class measured by its size; then the smallest, then the first.

    Putting a vector v into a fold with totals t adds (2 t v + v v) / N N to the sum of squared class shares, and v v / N N is the same for all folds.
    """
    best = min(open_folds, key=lambda f: (sum(t * v * w for t, v, w in zip(totals[f], vector, weights) if v), sum(totals[f]), f))
    totals[best] = [t + v for t, v in zip(totals[best], vector)]
    return best


def group_folds(rows: DataFrame, folds: int, seed: int, group: str = "user", label: str = "label") -> DataFrame:
    """Fold number (1..folds) of every group; a group is never split and folds keep the class shares.

    Groups are dealt out from the largest on (then by a draw from seed and name), each by its whole class vector, to the fold that has least of its
    classes so far. With more groups than one task should deal, slices of them are dealt side by side, and then the folds of
    each slice are matched to the folds of all by the same rule, slice after slice. Class counts are whole numbers, so every run agrees.
    """
    if folds < 2:
        raise ValueError("cross-validation needs at least two folds")
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("clips"))
    sizes = {r[label]: r["clips"] for r in counts.filter(F.col(label).isNotNull()).groupBy(label).agg(F.sum("clips").alias("clips")).collect()}
    classes = sorted(sizes)
    total = sum(sizes.values())
    weights = [(1000 * total // sizes[c]) ** 2 for c in classes]
    held = F.coalesce(F.map_from_entries(F.filter(F.collect_list(F.struct(label, "clips")), lambda e: e[label].isNotNull())), F.create_map())
    vectors = counts.groupBy(group).agg(held.alias("_of"), F.sum("clips").alias("_size"))
    vectors = vectors.select(group, "_size", F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.coalesce(F.try_element_at("_of", c), F.lit(0))).alias("_vector"),
                             F.md5(F.concat_ws(":", F.col(group).cast("string"), F.lit(seed))).alias("_draw"))
    vectors = skew.checkpointed(vectors)
    known = vectors.count()
    if known < folds:
        raise DataError(f"{known} participants cannot fill {folds} folds")
    slices = -(-known // SLICE_GROUPS)
    vectors = vectors.withColumn("_slice", F.pmod(F.xxhash64("_draw"), F.lit(slices)).cast("int"))
    names = [group, "_slice", "_vector"]
    schema = T.StructType([*[f for f in vectors.schema if f.name == group], T.StructField("_slice", T.IntegerType()), T.StructField("_local", T.IntegerType()),
                           T.StructField("_vector", T.ArrayType(T.LongType()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, totals = None, []
        for batch in batches:
            found = []
            for number, vector in zip(batch.column("_slice").to_pylist(), batch.column("_vector").to_pylist()):
                if number != now:
                    now, totals = number, [[0] * len(classes) for _ in range(folds)]
                found.append(_deal(totals, vector, weights, range(folds)))
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("_slice"), pa.array(found, pa.int32()), batch.column("_vector")],
                                             [group, "_slice", "_local", "_vector"])

    ordered = vectors.repartition(slices, "_slice").sortWithinPartitions("_slice", F.desc("_size"), "_draw", group)
    dealt = skew.checkpointed(ordered.select(*names).mapInArrow(deal, schema))
    if slices == 1:
        return dealt.select(group, (F.col("_local") + 1).alias("fold"))
    # a row for each slice and fold: the groups of a million tasks would still be a small table
    parts = dealt.select("_slice", "_local", F.posexplode("_vector").alias("c", "n")).groupBy("_slice", "_local", "c").agg(F.sum("n").alias("n"))
    parts = parts.groupBy("_slice", "_local").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "n"))), lambda e: e["n"]).alias("_vector"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free, totals = None, [], [[0] * len(classes) for _ in range(folds)]
        for batch in batches:
            found = []
            for number, vector in zip(batch.column("_slice").to_pylist(), batch.column("_vector").to_pylist()):
                if number != now:
                    now, free = number, list(range(folds))
                found.append(_deal(totals, vector, weights, free))
                free.remove(found[-1])
            yield pa.RecordBatch.from_arrays([batch.column("_slice"), batch.column("_local"), pa.array([f + 1 for f in found], pa.int32())], ["_slice", "_local", "fold"])

    size = F.aggregate("_vector", F.lit(0).cast("long"), lambda a, v: a + v)
    matched = parts.coalesce(1).sortWithinPartitions("_slice", F.desc(size), "_local").mapInArrow(match, "_slice int, _local int, fold int")
    return dealt.join(matched, ["_slice", "_local"]).select(group, "fold")


def cross_validate(
    rows: DataFrame,
    blocks: Sequence[str],
    algorithm: Algorithm,
    candidates: Sequence[Mapping[str, Any]],
    *,
    folds: int = 5,
    repeats: int = 1,
    seed: int = 42,
    selection_metric: str = "macro_f1",
) -> DataFrame:
    """Out-of-fold predictions, one row per (repeat, clip, candidate).

    All fitting happens inside the training part of a fold. The candidates of a fold share its
    prepared features, and every result is stored.
    """
    if repeats < 1:
        raise ValueError("cross-validation needs at least one repeat")
    if not candidates:
        raise ValueError("cross-validation needs at least one candidate")
    if selection_metric not in METRICS:
        raise ValueError(f"unknown selection metric: {selection_metric}")
    settings = [algorithm.resolved(c) for c in candidates]
    require_none(rows.filter("label IS NULL OR user IS NULL").select("clip_id"), "clip without label or participant")
    classes = sorted(int(r["label"]) for r in rows.select("label").distinct().collect())
    found = None
    for repeat in range(repeats):
        assigned = rows.join(skew.checkpointed(group_folds(rows, folds, seed + repeat)), "user")
        # one pass has the training statistics of every fold
        sums = fold_sums(assigned, blocks)

        def evaluate(fold: int, repeat: int = repeat, assigned: DataFrame = assigned, sums: dict = sums) -> list[DataFrame]:
            train, held = assigned.filter(F.col("fold") != fold), assigned.filter(F.col("fold") == fold)
            preprocessor = fold_preprocessor(sums, fold, train)
            prepared = preprocessor.transform(train).select("features", "label").persist()
            checked = preprocessor.transform(held).select("clip_id", "user", "label", "features").persist()
            parts = []
            for number, setting in enumerate(settings):
                model = algorithm.fit(prepared, setting, preprocessor.groups)
                parts.append(skew.checkpointed(model.probabilities(checked).select(
                    F.lit(repeat + 1).alias("repeat"), F.lit(fold).alias("fold"), F.lit(number).alias("candidate"),
                    "clip_id", "user", "label", "prediction",
                    E.align_probabilities(
                        F.col("probability"), F.array(*[F.lit(c) for c in model.classes]), classes
                    ).alias("probability"),
                )))
            prepared.unpersist()
            checked.unpersist()
            return parts

        # folds need nothing of each other, so they are fitted side by side
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            run = inheritable_thread_target(rows.sparkSession)(evaluate)
            for parts in pool.map(run, range(1, folds + 1)):
                for part in parts:
                    found = part if found is None else found.unionByName(part)
    missed = found.groupBy("candidate", "clip_id").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") != repeats)
    require_none(missed, "clip not predicted once per repeat")
    return found


def candidate_metrics(found: DataFrame) -> DataFrame:
    """Mean and deviation over repeats of every candidate's metrics."""
    return E.repeat_summary(E.classification_metrics(found, ["candidate", "repeat"]), ["candidate"])


def consensus(found: DataFrame, classes: Sequence[int]) -> DataFrame:
    """One prediction per candidate and clip over all repeats."""
    listed = F.array(*[F.lit(int(c)) for c in classes])
    cells = found.select("candidate", "clip_id", "user", "label", F.posexplode("probability").alias("_i", "_p"))
    means = cells.groupBy("candidate", "clip_id", "user", "label", "_i").agg(F.avg("_p").alias("_p"))
    best = F.max_by("_i", F.struct(F.col("_p"), -F.col("_i")))
    return means.groupBy("candidate", "clip_id", "user", "label").agg(F.get(listed, best).alias("prediction"))


def out_of_fold(found: DataFrame, candidate: int) -> DataFrame:
    """One row per clip for a candidate: consensus prediction, mean probability, and the fold and prediction of each repeat."""
    classes = sorted(int(r["label"]) for r in found.select("label").distinct().collect())
    own = found.filter(F.col("candidate") == candidate)
    agreed = consensus(own, classes).drop("candidate")
    cells = own.select("clip_id", F.posexplode("probability").alias("_i", "_p")).groupBy("clip_id", "_i").agg(F.avg("_p").alias("_p"))
    means = cells.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda c: c["_p"]).alias("probability"))
    repeats = own.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("repeat", "fold", "prediction"))).alias("repeats"))
    return agreed.join(means, "clip_id").join(repeats, "clip_id").withColumn("classes", F.array(*[F.lit(c) for c in classes]))


def selected_out_of_fold(found: DataFrame, report: Mapping[str, Any]) -> DataFrame:
    """The out-of-fold table of the parameters that a report selected."""
    tried = [a["parameters"] for a in report["aggregate_metrics"]]
    return out_of_fold(found, tried.index(report["selected_parameters"]))


def validation_report(found: DataFrame, algorithm: Algorithm, candidates: Sequence[Mapping[str, Any]], *,
                      selection_metric: str = "macro_f1", seed: int = 42, groups_path: str | None = None) -> dict[str, Any]:
    """Nested report of a cross-validation; every table in it is as small as classes, folds or candidates.

    Participants are listed in it: in each fold, and with their metrics. With ``groups_path`` both are written there by Spark, as tables
    ``users`` and ``metrics``, and the report only names them, however many participants there are.
    """
    settings = [algorithm.resolved(c) for c in candidates]
    classes = sorted(int(r["label"]) for r in found.select("label").distinct().collect())
    pick = lambda row: {m: row[m] for m in METRICS}
    per_candidate = {r["candidate"]: r for r in candidate_metrics(found).collect()}
    repeats = E.classification_metrics(found, ["candidate", "repeat"]).orderBy("candidate", "repeat").collect()
    agreed = skew.checkpointed(consensus(found, classes))
    agreed_metrics = {r["candidate"]: pick(r) for r in E.classification_metrics(agreed, ["candidate"]).collect()}
    best = max(range(len(settings)), key=lambda i: per_candidate[i][selection_metric])
    chosen = agreed.filter(F.col("candidate") == best)
    fold_rows = E.classification_metrics(found, ["repeat", "fold", "candidate"]).orderBy("repeat", "fold", "candidate").collect()
    folds: dict[tuple[int, int], dict[str, Any]] = {}
    in_fold = found.select("repeat", "fold", F.col("user").cast("string").alias("user")).distinct()
    by_group = E.per_group_metrics(chosen, "user")
    if groups_path is None:
        users = {(r["repeat"], r["fold"]): r["users"] for r in in_fold.groupBy("repeat", "fold").agg(F.sort_array(F.collect_list("user")).alias("users")).collect()}
        group_rows: Any = [
            {"group": str(r["user"]), "clips": r["clips"], "metrics": pick(r)} for r in by_group.orderBy(F.col("user").cast("string")).collect()
        ]
    else:
        in_fold.write.mode("overwrite").partitionBy("repeat", "fold").parquet(f"{groups_path}/users")
        by_group.write.mode("overwrite").parquet(f"{groups_path}/metrics")
        users = {(r["repeat"], r["fold"]): f"{groups_path}/users/repeat={r['repeat']}/fold={r['fold']}" for r in fold_rows}
        group_rows = f"{groups_path}/metrics"
    for r in fold_rows:
        entry = folds.setdefault((r["repeat"], r["fold"]), {
            "repeat": r["repeat"], "fold_in_repeat": r["fold"], "fold": len(folds) + 1,
            "validation_clips": r["clips"], "validation_users": users[r["repeat"], r["fold"]], "candidates": [],
        })
        entry["candidates"].append({"parameters": settings[r["candidate"]], "metrics": pick(r)})
    matrix = E.confusion_matrix(chosen, classes).groupBy("actual").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("predicted", "clips"))), lambda c: c["clips"]).alias("row")
    )
    return {
        "algorithm": algorithm.name,
        "algorithm_display_name": algorithm.display_name,
        "selection_metric": selection_metric,
        "selected_parameters": settings[best],
        "cv_repeats": max(r["repeat"] for r in repeats),
        "cv_random_state": seed,
        "metrics_basis": "mean over repeats of out-of-fold predictions",
        "detail_metrics_basis": "consensus of the repeats for the selected parameters",
        "classes": classes,
        "aggregate_metrics": [
            {
                "parameters": parameters,
                "metrics": pick(per_candidate[i]),
                "metrics_std": {m: per_candidate[i][f"{m}_std"] for m in METRICS},
                "repeat_metrics": [pick(r) for r in repeats if r["candidate"] == i],
                "consensus_metrics": agreed_metrics[i],
            }
            for i, parameters in enumerate(settings)
        ],
        "folds": list(folds.values()),
        "per_class_metrics": [
            r.asDict() for r in E.per_class_metrics(chosen, E.class_table(found.sparkSession, classes)).orderBy("class_id").collect()
        ],
        "per_group_metrics": group_rows,
        "confusion_matrix": [r["row"] for r in matrix.orderBy("actual").collect()],
    }
