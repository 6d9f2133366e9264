"""Registered queries over predictions and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.catalog.common import named, r, rounded, table
from sensorframe.plans import evaluate as E
from sensorframe.schema import BLOCKS, METRICS

# ---------------------------------------------------------------- order lines as classified clips


def predicted(spark, folder, step=1):
    """Order lines: the line number is the class, a fixed rule the prediction."""
    label = F.col("l_linenumber")
    wrong = F.col("l_partkey") % 3 == 0
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", label.alias("label"),
        F.when(wrong, label + step).otherwise(label).alias("prediction"),
        F.col("l_partkey").alias("part"),
    )


def predicted_sql(step: int = 1) -> str:
    return (f"SELECT l_orderkey, l_suppkey, l_linenumber AS label, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber + {step} "
            "ELSE l_linenumber END AS prediction, l_partkey AS part FROM lineitem")


def metrics_sql(relation: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""p AS ({relation}),
s AS (SELECT {k}label AS c, count(*) AS t, count(*) FILTER (label = prediction) AS h, 0 AS q FROM p GROUP BY {k}label
  UNION ALL SELECT {k}prediction, 0, 0, count(*) FROM p GROUP BY {k}prediction),
l AS (SELECT {k}c, sum(t) AS t, sum(h) AS h, sum(q) AS q FROM s GROUP BY {k}c),
metrics AS (SELECT {k}sum(t)::BIGINT AS clips, sum(h) / sum(t) AS accuracy, avg(2.0 * h / (t + q)) AS macro_f1,
  avg(CASE WHEN t > 0 THEN h / t END) AS balanced_accuracy FROM l {by})"""


def classification_metrics(spark, folder):
    return rounded(E.classification_metrics(predicted(spark, folder)), METRICS)


def per_group_metrics(spark, folder):
    return rounded(E.per_group_metrics(predicted(spark, folder), "l_suppkey"), METRICS)


CLASSES = list(range(1, 10))


def per_class_metrics(spark, folder):
    rows = E.per_class_metrics(predicted(spark, folder), E.class_table(spark, CLASSES))
    return rounded(rows, ["precision", "recall", "f1"])


PER_CLASS_SQL = f"""WITH {metrics_sql(predicted_sql())}
SELECT k AS class_id, {named('CASE WHEN q > 0 THEN h / q ELSE 0 END', 'precision')}, {named('CASE WHEN t > 0 THEN h / t ELSE 0 END', 'recall')},
  {named('CASE WHEN t + q > 0 THEN 2.0 * h / (t + q) ELSE 0 END', 'f1')}, coalesce(t, 0)::BIGINT AS support
FROM (SELECT unnest(range(1, 10))::INTEGER AS k) LEFT JOIN l ON c = k"""


def confusion_matrix(spark, folder):
    return E.confusion_matrix(predicted(spark, folder), CLASSES)


def matrix_sql(step: int = 1) -> str:
    return f"""SELECT a AS actual, b AS predicted, count(p.label) AS clips
FROM (SELECT unnest(range(1, 10))::INTEGER AS a) CROSS JOIN (SELECT unnest(range(1, 10))::INTEGER AS b)
LEFT JOIN ({predicted_sql(step)}) p ON p.label = a AND p.prediction = b GROUP BY a, b"""


NORMALIZED = "SELECT actual, predicted, coalesce(clips / nullif(sum(clips) OVER (PARTITION BY actual), 0), 0) AS share FROM"


def row_normalize(spark, folder):
    return rounded(E.row_normalize(E.confusion_matrix(predicted(spark, folder), CLASSES)), ["share"])


def confusion_delta(spark, folder):
    first = E.confusion_matrix(predicted(spark, folder), CLASSES)
    second = E.confusion_matrix(predicted(spark, folder, 2), CLASSES)
    return rounded(E.confusion_delta(first, second), ["delta"])


CONFUSION_DELTA_SQL = f"""WITH a AS ({NORMALIZED} ({matrix_sql()})), b AS ({NORMALIZED} ({matrix_sql(2)}))
SELECT actual, predicted, {named('a.share - b.share', 'delta')} FROM a JOIN b USING (actual, predicted)"""


def per_class_from_matrix(spark, folder):
    rows = E.per_class_from_matrix(E.confusion_matrix(predicted(spark, folder), CLASSES))
    return rounded(rows, ["precision", "recall", "f1"])


PER_CLASS_MATRIX_SQL = f"""WITH m AS ({matrix_sql()}), t AS (SELECT k,
  sum(clips) FILTER (actual = k) AS s, sum(clips) FILTER (predicted = k) AS q, sum(clips) FILTER (actual = k AND predicted = k) AS h
  FROM m, (SELECT unnest(range(1, 10))::INTEGER AS k) GROUP BY k),
u AS (SELECT k, CASE WHEN q > 0 THEN h / q ELSE 0 END AS p, CASE WHEN s > 0 THEN h / s ELSE 0 END AS r FROM t)
SELECT k AS class_id, {named('p', 'precision')}, {named('r', 'recall')}, {named('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END', 'f1')} FROM u"""


def class_labels(spark, folder):
    ids = table(spark, folder, "customer").select((F.col("c_nationkey") * 2).alias("action_id")).distinct()
    mapping = table(spark, folder, "nation").select(F.col("n_nationkey").alias("action_id"), F.col("n_name").alias("action_name"))
    return E.class_labels(ids, mapping)


CLASS_LABELS_SQL = """SELECT DISTINCT c_nationkey * 2 AS action_id, coalesce(n_name, (c_nationkey * 2)::VARCHAR) AS class_label
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey * 2"""


def repeat_metrics(spark, folder):
    """Every order line votes in one of four repeats."""
    return E.classification_metrics(predicted(spark, folder).withColumn("repeat", F.col("l_orderkey") % 4), ["repeat"])


def repeat_summary(spark, folder):
    rows = E.repeat_summary(repeat_metrics(spark, folder), [])
    return rounded(rows, [*METRICS, *[f"{m}_std" for m in METRICS]], 6)


REPEAT_SUMMARY_SQL = f"""WITH {metrics_sql("SELECT *, l_orderkey % 4 AS repeat FROM (" + predicted_sql() + ")", "repeat")}
SELECT {", ".join(named(f'avg({m})', m, 6) for m in METRICS)}, {", ".join(named(f'stddev_pop({m})', m + '_std', 6) for m in METRICS)} FROM metrics"""


def best_candidate(spark, folder):
    rows = E.per_group_metrics(predicted(spark, folder), "l_suppkey")
    rows = rows.withColumn("macro_f1", F.round("macro_f1", 2))
    return E.best_candidate(rows, "macro_f1", "l_suppkey").select("l_suppkey", "macro_f1")


BEST_SQL = f"""WITH {metrics_sql(predicted_sql(), "l_suppkey")}
SELECT l_suppkey, round(macro_f1, 2) AS macro_f1 FROM metrics ORDER BY round(macro_f1, 2) DESC, l_suppkey LIMIT 1"""

# ---------------------------------------------------------------- probabilities


def probabilities(spark, folder):
    """Vectors as class scores: all values, squared and scaled to sum to one."""
    squared = F.transform("embedding", lambda v: v.cast("double") * v)
    total = F.aggregate(squared, F.lit(0.0), lambda a, v: a + v)
    rows = table(spark, folder, "embeddings").select("vec_id", squared.alias("s"), total.alias("t"))
    return rows.select("vec_id", F.transform("s", lambda v: v / F.col("t")).alias("probability"))


PROBABILITIES = """e AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE ** 2 AS s FROM embeddings),
p AS (SELECT vec_id, k, s / sum(s) OVER (PARTITION BY vec_id) AS p FROM e)"""


def align_probabilities(spark, folder):
    seen = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i + F.col("vec_id")) % 70)
    rows = probabilities(spark, folder).withColumn("classes", F.transform(seen, lambda c: c.cast("int")))
    aligned = E.align_probabilities(F.col("probability"), F.col("classes"), range(70))
    return rounded(rows.select("vec_id", F.posexplode(aligned).alias("class", "probability")), ["probability"])


ALIGN_SQL = f"""WITH {PROBABILITIES}
SELECT v.vec_id, c::INTEGER AS class, {named('coalesce(p.p, 0)', 'probability')}
FROM (SELECT vec_id, unnest(range(70)) AS c FROM embeddings) v LEFT JOIN p ON p.vec_id = v.vec_id AND (p.k + p.vec_id) % 70 = v.c"""


def mean_consensus(spark, folder):
    rows = probabilities(spark, folder).withColumn("clip", F.floor(F.col("vec_id") / 3))
    return rounded(E.mean_consensus(rows, "clip", range(10, 74)), ["probability"])


MEAN_CONSENSUS_SQL = f"""WITH {PROBABILITIES}, m AS (SELECT vec_id // 3 AS clip, k, avg(p) AS p FROM p GROUP BY 1, 2)
SELECT clip, (10 + arg_max(k, p))::INTEGER AS prediction, {named('max(p)', 'probability')} FROM m GROUP BY clip"""


def majority_vote(spark, folder):
    return E.majority_vote(predicted(spark, folder), "part", 42)


VOTE_SQL = f"""WITH v AS (SELECT part, prediction, count(*) AS votes FROM ({predicted_sql()}) GROUP BY 1, 2)
SELECT part, prediction, votes FROM v QUALIFY row_number() OVER (PARTITION BY part ORDER BY votes DESC, md5(part || ':' || prediction || ':42') DESC) = 1"""


# ---------------------------------------------------------------- customers as runs


def runs(spark, folder):
    """A customer is a training run: segment and nation name the algorithm, bits of the key the blocks."""
    key = F.col("c_custkey")
    bits = (key % 6 + 1).cast("int")
    blocks = F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(2**i)) > 0, F.lit(b)) for i, b in enumerate(BLOCKS[:3])]))
    score = F.when(key % 11 != 0, F.round(F.col("c_acctbal") / 20000 + 0.25, 3))
    return table(spark, folder, "customer").select(
        key.alias("place"),
        F.when(key % 50 == 1, F.concat(F.lit("single"), key.cast("string"))).otherwise(F.col("c_mktsegment")).alias("algorithm"),
        F.concat(F.lit("run"), F.floor(key / 4).cast("string")).alias("artifact_name"),
        score.alias("macro_f1"), (score + 0.02).alias("accuracy"), (score - 0.01).alias("balanced_accuracy"),
        blocks.alias("feature_blocks_list"), F.array_join(blocks, ", ").alias("feature_blocks"),
        (key % 11 == 0).alias("validation_skipped"),
    )


RUNS = """r0 AS (SELECT c_custkey AS place, CASE WHEN c_custkey % 50 = 1 THEN 'single' || c_custkey ELSE c_mktsegment END AS algorithm,
  'run' || (c_custkey // 4) AS artifact_name, CASE WHEN c_custkey % 11 <> 0 THEN round(c_acctbal / 20000 + 0.25, 3) END AS macro_f1,
  list_filter([CASE WHEN (c_custkey % 6 + 1) & 1 > 0 THEN 'depth' END, CASE WHEN (c_custkey % 6 + 1) & 2 > 0 THEN 'ir' END,
    CASE WHEN (c_custkey % 6 + 1) & 4 > 0 THEN 'imu' END], lambda x: x IS NOT NULL) AS blocks FROM customer),
runs AS (SELECT *, macro_f1 + 0.02 AS accuracy, macro_f1 - 0.01 AS balanced_accuracy, array_to_string(blocks, ', ') AS feature_blocks,
  macro_f1 IS NULL AS validation_skipped FROM r0),
named AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY algorithm) > 1 THEN algorithm || ' (' || artifact_name || ')' ELSE algorithm END AS base FROM runs),
labeled AS (SELECT *, CASE WHEN row_number() OVER w > 1 THEN base || ' #' || row_number() OVER w ELSE base END AS label
  FROM named WINDOW w AS (PARTITION BY base ORDER BY place))"""


def unique_run_labels(spark, folder):
    return E.unique_run_labels(runs(spark, folder), "place").select("place", "label")


def filter_runs(spark, folder):
    kept = E.filter_runs(runs(spark, folder), ["BUILDING", "MACHINERY"], ["depth, ir", "imu"], keep_skipped=False)
    return kept.select("place", "algorithm", "feature_blocks")


def leaderboard(spark, folder):
    return E.leaderboard(runs(spark, folder), "macro_f1", "place").select("place", "rank")


# Half up of the decimal text of a number, as the runs are rounded; rounding the binary number puts ties on either side.
RANKED_RUNS = RUNS.replace("round(c_acctbal / 20000 + 0.25, 3)", "round((c_acctbal / 20000 + 0.25)::VARCHAR::DECIMAL(38, 20), 3)::DOUBLE")


def ablation_summary(spark, folder):
    rows = E.ablation_summary(E.unique_run_labels(runs(spark, folder), "place"), "place")
    return rounded(rows, METRICS)


ABLATION_SQL = f"""WITH {RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY feature_blocks ORDER BY coalesce(macro_f1, -1) DESC, place) AS k,
  count(*) OVER (PARTITION BY feature_blocks) AS n FROM labeled)
SELECT feature_blocks, n AS runs, label AS best_run, {", ".join(named(m, m) for m in METRICS)} FROM b WHERE k = 1"""


def block_impact(spark, folder):
    return rounded(E.block_impact(runs(spark, folder)), ["with_block", "without_block", "delta"])


BLOCK_IMPACT_SQL = f"""WITH {RUNS}, c AS (SELECT algorithm FROM runs GROUP BY algorithm ORDER BY count(*) DESC, algorithm LIMIT 1),
s AS (SELECT * FROM runs WHERE algorithm IN (SELECT algorithm FROM c)),
t AS (SELECT b AS block, avg(macro_f1) FILTER (list_contains(blocks, b)) AS w, avg(macro_f1) FILTER (NOT list_contains(blocks, b)) AS o,
  count(macro_f1) FILTER (list_contains(blocks, b)) AS n_with, count(macro_f1) FILTER (NOT list_contains(blocks, b)) AS n_without
  FROM s, (SELECT unnest([{", ".join(f"'{b}'" for b in BLOCKS)}]) AS b) GROUP BY b)
SELECT block, {named('w', 'with_block')}, {named('o', 'without_block')}, {named('w - o', 'delta')}, n_with, n_without
FROM t WHERE n_with > 0 AND n_without > 0"""


def reports(spark, folder):
    """Customers as validation reports in JSON, with two candidates and two folds each."""
    key = F.col("c_custkey")
    params = lambda c: F.struct(F.lit(c).alias("C"), F.col("c_mktsegment").alias("weighting"))
    scores = lambda shift: F.struct(
        (F.col("c_acctbal") + shift).alias("accuracy"), (F.col("c_acctbal") * 2 + shift).alias("macro_f1"),
        (F.col("c_acctbal") * 3).alias("balanced_accuracy"),
    )
    candidates = F.array(
        F.struct(params(0.1).alias("parameters"), scores(0).alias("metrics")),
        F.struct(params(1.0).alias("parameters"), scores(5).alias("metrics")),
    )
    chosen = F.when(key % 3 == 0, params(0.1)).when(key % 3 == 1, params(1.0)).otherwise(params(9.0))
    fold = lambda i: F.struct(F.lit(i).alias("fold"), (key + i).alias("validation_clips"), candidates.alias("candidates"))
    body = F.struct(
        F.when(key % 4 != 0, F.lit("logistic_regression")).alias("algorithm"),
        chosen.alias("selected_parameters"), candidates.alias("aggregate_metrics"), F.array(fold(1), fold(2)).alias("folds"),
        (key * 10).alias("training_clips"),
        F.when(key % 5 == 1, F.array(F.lit("imu"), F.lit("skeleton"))).alias("feature_blocks"),
        F.when(key % 5 == 2, F.lit("depth, imu ")).alias("feature_blocks_display"),
        F.when(key % 5 == 3, F.struct(F.lit(3).alias("skeleton"), F.lit(4).alias("depth"), F.lit(1).alias("other"))).alias("raw_feature_dimensions"),
    )
    text = F.when(key % 7 == 0, "{broken").otherwise(F.to_json(body))
    rows = table(spark, folder, "customer").select(
        F.concat(F.lit("runs/r"), key.cast("string"), F.lit("/validation.json")).alias("report"),
        # exploded, so that a text is written once as in a file and not by everything that reads it
        F.explode(F.array(text)).alias("value"),
    )
    return rows.select(
        "report", F.element_at(F.split("report", "/"), -2).alias("artifact_name"), "value",
        F.when(F.try_parse_json("value").isNull(), F.lit("not valid JSON")).alias("error"),
    )


def comparison_rows(spark, folder):
    rows = E.comparison_rows(E.parsed_reports(reports(spark, folder)))
    rows = rows.withColumn("blocks", F.size("feature_blocks_list")).drop("feature_blocks_list", "display_name", "selection_metric", "test_clips", "validation_skipped")
    return rounded(rows, METRICS)


COMPARISON_SQL = f"""SELECT CASE WHEN c_custkey % 4 <> 0 THEN 'logistic_regression' ELSE 'r' || c_custkey END AS algorithm,
  'r' || c_custkey AS artifact_name,
  '{{"C": ' || CASE c_custkey % 3 WHEN 0 THEN '0.1' WHEN 1 THEN '1.0' ELSE '9.0' END || ', "weighting": "' || c_mktsegment || '"}}' AS parameters,
  {named('CASE c_custkey % 3 WHEN 0 THEN c_acctbal WHEN 1 THEN c_acctbal + 5 END', 'accuracy')},
  {named('CASE c_custkey % 3 WHEN 0 THEN c_acctbal * 2 WHEN 1 THEN c_acctbal * 2 + 5 END', 'macro_f1')},
  {named('CASE WHEN c_custkey % 3 < 2 THEN c_acctbal * 3 END', 'balanced_accuracy')},
  c_custkey * 10 AS training_clips, 'runs/r' || c_custkey || '/validation.json' AS report,
  CASE c_custkey % 5 WHEN 1 THEN 'imu, skeleton' WHEN 2 THEN 'depth, imu ' WHEN 3 THEN 'depth, skeleton, other' ELSE '—' END AS feature_blocks,
  CASE c_custkey % 5 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS blocks
FROM customer WHERE c_custkey % 7 <> 0"""


def fold_table(spark, folder):
    rows = E.fold_table(E.parsed_reports(reports(spark, folder)))
    return rounded(rows.drop("parameters"), METRICS)


FOLD_TABLE_SQL = f"""SELECT 'runs/r' || c_custkey || '/validation.json' AS report, f::INTEGER AS fold, c_custkey + f AS validation_clips,
  {named('c_acctbal + s', 'accuracy')}, {named('c_acctbal * 2 + s', 'macro_f1')}, {named('c_acctbal * 3', 'balanced_accuracy')}
FROM customer, (SELECT unnest([1, 2]) AS f), (SELECT unnest([0, 5]) AS s) WHERE c_custkey % 7 <> 0"""


def fold_series(spark, folder):
    return rounded(E.fold_series(E.parsed_reports(reports(spark, folder)), "macro_f1"), ["macro_f1"])


FOLD_SERIES_SQL = f"""SELECT 'runs/r' || c_custkey || '/validation.json' AS report, f::INTEGER AS fold,
  {named('c_acctbal * 2 + CASE WHEN c_custkey % 3 = 1 THEN 5 ELSE 0 END', 'macro_f1')}
FROM customer, (SELECT unnest([1, 2]) AS f) WHERE c_custkey % 7 <> 0"""


QUERIES = {f.__name__: f for f in (
    classification_metrics, per_class_metrics, per_group_metrics, confusion_matrix, row_normalize, confusion_delta,
    per_class_from_matrix, class_labels, repeat_summary, best_candidate, align_probabilities, mean_consensus,
    majority_vote, unique_run_labels, filter_runs, leaderboard, ablation_summary, block_impact, comparison_rows,
    fold_table, fold_series,
)}

ORACLES = {
    "classification_metrics": f"WITH {metrics_sql(predicted_sql())} SELECT clips, {', '.join(named(m, m) for m in METRICS)} FROM metrics",
    "per_class_metrics": PER_CLASS_SQL,
    "per_group_metrics": f"WITH {metrics_sql(predicted_sql(), 'l_suppkey')} SELECT l_suppkey, clips, {', '.join(named(m, m) for m in METRICS)} FROM metrics",
    "confusion_matrix": matrix_sql(),
    "row_normalize": f"SELECT actual, predicted, {named('share', 'share')} FROM ({NORMALIZED} ({matrix_sql()}))",
    "confusion_delta": CONFUSION_DELTA_SQL,
    "per_class_from_matrix": PER_CLASS_MATRIX_SQL,
    "class_labels": CLASS_LABELS_SQL,
    "repeat_summary": REPEAT_SUMMARY_SQL,
    "best_candidate": BEST_SQL,
    "align_probabilities": ALIGN_SQL,
    "mean_consensus": MEAN_CONSENSUS_SQL,
    "majority_vote": VOTE_SQL,
    "unique_run_labels": f"WITH {RUNS} SELECT place, label FROM labeled",
    "filter_runs": f"WITH {RUNS} SELECT place, algorithm, feature_blocks FROM runs WHERE macro_f1 IS NOT NULL AND algorithm IN ('BUILDING', 'MACHINERY') AND feature_blocks IN ('depth, ir', 'imu')",
    "leaderboard": f"WITH {RANKED_RUNS} SELECT place, row_number() OVER (ORDER BY coalesce(macro_f1, -1) DESC, place) AS rank FROM runs",
    "ablation_summary": ABLATION_SQL,
    "block_impact": BLOCK_IMPACT_SQL,
    "comparison_rows": COMPARISON_SQL,
    "fold_table": FOLD_TABLE_SQL,
    "fold_series": FOLD_SERIES_SQL,
}
