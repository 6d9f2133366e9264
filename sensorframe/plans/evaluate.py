"""Evaluation of predictions and comparison of runs.

Everything starts from counts per (true, predicted) class, so the row-level data is reduced on the
map side and what follows is as small as the class list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe import skew
from sensorframe.functions.columns import block_list_text
from sensorframe.schema import BLOCKS, METRICS
from sensorframe.skew import OrderedGroups


def confusion_counts(rows: DataFrame, keys: Sequence[str] = (), actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return rows.groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("clips")
    )


def label_counts(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hits, true and predicted totals of every label that occurs on either side."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("clips")).otherwise(0)
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("clips").alias("t"), F.lit(0).cast("long").alias("p"), hit.cast("long").alias("h")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("clips").alias("p"), F.lit(0).cast("long").alias("h")),
    )
    rows = counts.select(*keys, F.inline(sides))
    return rows.groupBy(*keys, "label").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits")
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def classification_metrics(rows: DataFrame, keys: Sequence[str] = (), actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Accuracy, macro F1 over true and predicted labels, recall averaged over true labels."""
    labels = label_counts(confusion_counts(rows, keys, actual, predicted), keys)
    f1 = _share(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support"))
    return labels.groupBy(*keys).agg(
        F.sum("support").alias("clips"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.avg(recall).alias("balanced_accuracy"),
    )


def class_table(spark, classes: Sequence[int], name: str = "label") -> DataFrame:
    return spark.createDataFrame([(int(c),) for c in classes], f"{name} int")


def per_class_metrics(rows: DataFrame, classes: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every listed class."""
    found = classes.join(label_counts(confusion_counts(rows, (), actual, predicted)), "label", "left")
    found = found.na.fill(0, ["support", "predicted", "hits"])
    return found.select(
        F.col("label").alias("class_id"),
        _share(F.col("hits"), F.col("predicted")).alias("precision"),
        _share(F.col("hits"), F.col("support")).alias("recall"),
        _share(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def per_group_metrics(rows: DataFrame, group: str, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return classification_metrics(rows, [group], actual, predicted)


def confusion_matrix(rows: DataFrame, classes: Sequence[int], actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Zero-filled counts for every pair of listed classes, one row per pair."""
    counts = confusion_counts(rows, (), actual, predicted)
    names = [str(c) for c in classes]
    wide = counts.groupBy("actual").pivot("predicted", list(classes)).agg(F.sum("clips"))
    full = class_table(rows.sparkSession, classes, "actual").join(wide, "actual", "left").na.fill(0, names)
    cells = F.array(*[F.struct(F.lit(int(c)).alias("predicted"), F.col(n).alias("clips")) for c, n in zip(classes, names)])
    return full.select("actual", F.inline(cells))


def row_normalize(matrix: DataFrame) -> DataFrame:
    """Share of each cell in its row; an empty row stays zero. The matrix has classes x classes cells."""
    whole = F.sum("clips").over(Window.partitionBy("actual"))
    return matrix.withColumn("share", _share(F.col("clips"), whole)).drop("clips")


def confusion_delta(first: DataFrame, second: DataFrame) -> DataFrame:
    a = row_normalize(first).withColumnRenamed("share", "_a")
    b = row_normalize(second).withColumnRenamed("share", "_b")
    gap = F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return a.join(b, ["actual", "predicted"], "full").select("actual", "predicted", gap.alias("delta"))


def per_class_from_matrix(matrix: DataFrame) -> DataFrame:
    labels = label_counts(matrix)
    precision, recall = _share(F.col("hits"), F.col("predicted")), _share(F.col("hits"), F.col("support"))
    return labels.select(
        F.col("label").alias("class_id"), precision.alias("precision"), recall.alias("recall"),
        _share(2 * precision * recall, precision + recall).alias("f1"),
    )


def class_labels(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """Class names, the id itself where no name is known."""
    return ids.join(mapping, "action_id", "left").select(
        "action_id", F.coalesce("action_name", F.col("action_id").cast("string")).alias("class_label")
    )


def repeat_summary(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean and population deviation of each metric over repeats."""
    return rows.groupBy(*keys).agg(
        *[F.avg(m).alias(m) for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics]
    )


def best_candidate(rows: DataFrame, metric: str, place: str, keys: Sequence[str] = ()) -> DataFrame:
    """Row with the highest metric; the first one wins a tie."""
    best = F.max_by(F.struct("*"), F.struct(F.col(metric), (-F.col(place)).alias("_first")))
    return rows.groupBy(*keys).agg(best.alias("_best")).select("_best.*")


# ---------------------------------------------------------------- probabilities


def align_probabilities(probability: Column, classes: Column, every: Sequence[int]) -> Column:
    """Probabilities in the order of all classes; a class the model never saw gets 0."""
    return F.transform(
        F.array(*[F.lit(int(c)) for c in every]),
        lambda c: F.coalesce(F.try_element_at(probability, F.nullif(F.array_position(classes, c), F.lit(0)).cast("int")), F.lit(0.0)),
    )


def mean_consensus(rows: DataFrame, clip: str, classes: Sequence[int], probability: str = "probability") -> DataFrame:
    """Class with the highest mean probability over repeats; the lowest class wins a tie."""
    listed = F.array(*[F.lit(int(c)) for c in classes])
    cells = rows.select(clip, F.posexplode(probability).alias("_i", "_p"))
    means = cells.groupBy(clip, "_i").agg(F.avg("_p").alias("_p"))
    best = F.max_by("_i", F.struct(F.col("_p"), -F.col("_i")))
    return means.groupBy(clip).agg(F.get(listed, best).alias("prediction"), F.max("_p").alias("probability"))


def majority_vote(rows: DataFrame, clip: str, seed: int, prediction: str = "prediction") -> DataFrame:
    """Most frequent prediction; ties fall by a draw from clip, class and seed instead of the lowest class."""
    votes = rows.groupBy(clip, prediction).agg(F.count(F.lit(1)).alias("votes"))
    draw = F.md5(F.concat_ws(":", F.col(clip).cast("string"), F.col(prediction).cast("string"), F.lit(seed)))
    return votes.groupBy(clip).agg(
        F.max_by(prediction, F.struct(F.col("votes"), draw)).alias("prediction"), F.max("votes").alias("votes")
    )


# ---------------------------------------------------------------- runs

_METRIC_FIELDS = "struct<accuracy:double,macro_f1:double,balanced_accuracy:double>"
REPORT = (
    "algorithm string, algorithm_display_name string, selection_metric string, selected_parameters string, "
    "validation_skipped boolean, classes array<int>, confusion_matrix array<array<bigint>>, "
    f"aggregate_metrics array<struct<parameters:string,metrics:{_METRIC_FIELDS}>>, "
    "folds array<struct<fold:int,validation_clips:bigint,"
    f"candidates:array<struct<parameters:string,metrics:{_METRIC_FIELDS}>>>>, "
    "training_clips bigint, test_clips bigint, feature_blocks string, feature_blocks_display string, "
    "raw_feature_dimensions string"
)


def sorted_json(text: Column) -> Column:
    """A flat JSON object with sorted keys and a blank after colons and commas; numbers stay as written.

    The text is read twice in all, for what is written and for its kinds; both maps have the keys in the order of the text.
    """
    written, kinds = F.from_json(text, "map<string,string>"), F.from_json(text, "map<string,variant>")
    # to_json escapes; of an array with one text it leaves the brackets to take off
    quoted = lambda c: F.btrim(F.to_json(F.array(c)), F.lit("[]"))

    def shown(entry: Column, kind: Column) -> Column:
        value = F.when(F.schema_of_variant(kind) == "STRING", quoted(entry["value"])).otherwise(F.coalesce(entry["value"], F.lit("null")))
        return F.struct(entry["key"].alias("key"), F.concat(quoted(entry["key"]), F.lit(": "), value).alias("text"))

    ordered = F.array_sort(F.zip_with(F.map_entries(written), F.map_values(kinds), shown))
    return F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda e: e["text"]), ", "), F.lit("}"))


def feature_block_list(report: Column) -> Column:
    """Blocks of a run: recorded list, recorded text, or the names of the recorded dimensions."""
    given = report["feature_blocks"]
    listed = F.from_json(given, "array<string>")
    shown = F.filter(F.transform(F.split(report["feature_blocks_display"], ","), F.trim), lambda b: b != "")
    dims = F.map_keys(F.from_json(report["raw_feature_dimensions"], "map<string,string>"))
    return (
        F.when(F.size(listed) > 0, listed).when(F.size(shown) > 0, shown)
        .when(F.size(dims) > 0, F.split(block_list_text(dims), ", ")).otherwise(F.array().cast("array<string>"))
    )


def feature_combo_name(report: Column) -> Column:
    """Display text of a run's blocks."""
    given = F.coalesce(report["feature_blocks"], report["feature_blocks_display"])
    listed = F.from_json(report["feature_blocks"], "array<string>")
    dims = F.map_keys(F.from_json(report["raw_feature_dimensions"], "map<string,string>"))
    return (
        F.when(F.size(listed) > 0, F.array_join(listed, ", ")).when(given.isNotNull(), given)
        .when(F.size(dims) > 0, block_list_text(dims)).otherwise(F.lit("—"))
    )


def parsed_reports(reports: DataFrame) -> DataFrame:
    """Readable reports with their fields in column ``r``."""
    # exploded, so that a report is read once and not for every field
    fields = F.explode(F.array(F.from_json("value", REPORT))).alias("r")
    return reports.filter("error IS NULL").select(*[c for c in reports.columns if c not in ("value", "error")], fields)


def _with_selected(reports: DataFrame) -> DataFrame:
    """The selected parameters as sorted text, written once a report rather than once a candidate."""
    return reports.withColumn("_raw", F.col("r.selected_parameters")).withColumn("_selected", sorted_json(F.col("_raw")))


def _chosen(candidates: Column) -> Column:
    # texts written alike need no sorting; they are the rule where one program writes a report
    alike = lambda c: (c["parameters"] == F.col("_raw")) | sorted_json(c["parameters"]).eqNullSafe(F.col("_selected"))
    return F.get(F.filter(candidates, alike), F.lit(0))


def comparison_rows(reports: DataFrame) -> DataFrame:
    """One row per run with the metrics of its selected parameters."""
    r = F.col("r")
    # the chosen candidate is a column of its own, so that its metrics do not look for it one by one
    reports = _with_selected(reports).withColumn("_metrics", _chosen(r["aggregate_metrics"])["metrics"])
    metrics = F.col("_metrics")
    return reports.select(
        F.coalesce(F.nullif(r["algorithm"], F.lit("")), "artifact_name").alias("algorithm"),
        "artifact_name",
        F.coalesce("_selected", F.lit("{}")).alias("parameters"),
        *[metrics[m].alias(m) for m in METRICS],
        r["training_clips"].alias("training_clips"),
        "report",
        F.coalesce(
            F.nullif(r["algorithm_display_name"], F.lit("")), F.nullif(r["algorithm"], F.lit("")), "artifact_name"
        ).alias("display_name"),
        r["selection_metric"].alias("selection_metric"),
        r["test_clips"].alias("test_clips"),
        feature_combo_name(r).alias("feature_blocks"),
        feature_block_list(r).alias("feature_blocks_list"),
        F.coalesce(r["validation_skipped"], F.lit(False)).alias("validation_skipped"),
    )


def fold_table(reports: DataFrame) -> DataFrame:
    """One row per run, fold and candidate."""
    folds = reports.select("report", F.explode("r.folds").alias("f"))
    rows = folds.select("report", "f.fold", "f.validation_clips", F.explode("f.candidates").alias("c"))
    return rows.select(
        "report", "fold", "validation_clips", sorted_json(F.col("c.parameters")).alias("parameters"),
        *[F.col(f"c.metrics.{m}").alias(m) for m in METRICS],
    )


def fold_series(reports: DataFrame, metric: str) -> DataFrame:
    """Metric per fold of the selected parameters, else of the first candidate."""
    rows = _with_selected(reports).select("report", "_raw", "_selected", F.posexplode("r.folds").alias("i", "f"))
    best = F.coalesce(_chosen(F.col("f.candidates")), F.get("f.candidates", F.lit(0)))
    # exploded, as a filter on the choice would make it twice
    return rows.select("report", "i", "f", F.explode(F.array_compact(F.array(best))).alias("b")).select(
        "report", F.coalesce("f.fold", F.col("i") + 1).alias("fold"), F.col("b")["metrics"][metric].alias(metric)
    )


def filter_runs(rows: DataFrame, algorithms: Sequence[str] | None = None, combinations: Sequence[str] | None = None,
                keep_skipped: bool = True) -> DataFrame:
    if not keep_skipped:
        rows = rows.filter(~F.col("validation_skipped"))
    if algorithms is not None:
        rows = rows.filter(F.col("algorithm").isin(list(algorithms)))
    if combinations is not None:
        rows = rows.filter(F.col("feature_blocks").isin(list(combinations)))
    return rows


def unique_run_labels(rows: DataFrame, place: str) -> DataFrame:
    """Algorithm alone where unique, else with the folder, else also numbered in row order."""
    counts = rows.groupBy("algorithm").agg(F.count(F.lit(1)).alias("_runs"))
    base = F.when(
        F.col("_runs") > 1, F.concat(F.col("algorithm"), F.lit(" ("), F.col("artifact_name"), F.lit(")"))
    ).otherwise(F.col("algorithm"))
    named = rows.join(counts, "algorithm").withColumn("_base", base)
    groups = OrderedGroups(named, ["_base"], [place], F.col(place)).scan(_turn=skew.position())
    label = F.when(F.col("_turn") > 0, F.concat(F.col("_base"), F.lit(" #"), (F.col("_turn") + 1).cast("string")))
    return groups.rows().withColumn("label", F.coalesce(label, "_base")).drop("_runs", "_base", "_turn")


def leaderboard(rows: DataFrame, metric: str, place: str) -> DataFrame:
    """Runs numbered by descending metric, missing metrics last, earlier runs first in a tie."""
    score = F.coalesce(F.col(metric), F.lit(-1.0))
    groups = OrderedGroups(rows, [], [-score, F.col(place)], None)
    return groups.scan(rank=skew.position()).rows().withColumn("rank", F.col("rank") + 1)


def ablation_summary(rows: DataFrame, place: str) -> DataFrame:
    """Per block combination the number of runs and its best run."""
    best = F.max_by(
        F.struct("label", *METRICS), F.struct(F.coalesce("macro_f1", F.lit(-1.0)), -F.col(place))
    )
    found = rows.groupBy("feature_blocks").agg(F.count(F.lit(1)).alias("runs"), best.alias("_b"))
    return found.select("feature_blocks", "runs", F.col("_b.label").alias("best_run"), *[f"_b.{m}" for m in METRICS])


def block_impact(rows: DataFrame, blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """Mean macro F1 with and without each block, for the most common algorithm."""
    counts = rows.groupBy("algorithm").agg(F.count(F.lit(1)).alias("_n"))
    common = counts.orderBy(F.desc("_n"), "algorithm").limit(1).select("algorithm")
    runs = rows.join(common, "algorithm", "left_semi")
    value = F.col("macro_f1")
    aggregates = []
    for i, block in enumerate(blocks):
        has = F.coalesce(F.array_contains("feature_blocks_list", block), F.lit(False))
        aggregates += [
            F.avg(F.when(has, value)).alias(f"_w{i}"), F.avg(F.when(~has, value)).alias(f"_o{i}"),
            F.count(F.when(has, value)).alias(f"_nw{i}"), F.count(F.when(~has, value)).alias(f"_no{i}"),
        ]
    parts = F.array(*[
        F.struct(
            F.lit(b).alias("block"), F.col(f"_w{i}").alias("with_block"), F.col(f"_o{i}").alias("without_block"),
            (F.col(f"_w{i}") - F.col(f"_o{i}")).alias("delta"),
            F.col(f"_nw{i}").alias("n_with"), F.col(f"_no{i}").alias("n_without"),
        )
        for i, b in enumerate(blocks)
    ])
    table = runs.agg(*aggregates).select(F.inline(parts))
    return table.filter("n_with > 0 AND n_without > 0").orderBy(F.desc("delta"))
