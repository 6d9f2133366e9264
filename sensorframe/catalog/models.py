"""Registered queries over preprocessing, models and cross-validation."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorframe.catalog.common import named, r, rounded, vectors
from sensorframe.plans import crossval as X
from sensorframe.plans import models as M
from sensorframe.plans import prep as Q

BLOCKS = ("depth", "imu", "skeleton", "imu_engineered")


def features(spark, folder):
    """Vectors as clips: four quarters are four blocks, the label the class, a remainder the participant."""
    quarter = lambda i: F.slice("embedding", 16 * i + 1, 16)
    return vectors(spark, folder).select(
        F.col("vec_id").alias("clip_id"), F.col("label"), (F.col("vec_id") % 17).cast("string").alias("user"),
        F.lit(None).cast("string").alias("submission_path"), *[quarter(i).alias(b) for i, b in enumerate(BLOCKS)],
    )


def gappy(spark, folder):
    holes = F.transform(
        "embedding", lambda v, i: F.when(((F.col("vec_id") + i) % 4 != 0) & (i != 5), F.when(i == 6, F.lit(0.5).cast("float")).otherwise(v))
    )
    return vectors(spark, folder).select(holes.alias("imu"))


GAPPY = """g AS (SELECT vec_id, unnest(range(64)) AS position, unnest(embedding)::DOUBLE AS e FROM embeddings),
h AS (SELECT position, CASE WHEN (vec_id + position) % 4 <> 0 AND position <> 5 THEN CASE WHEN position = 6 THEN 0.5 ELSE e END END AS v FROM g),
m AS (SELECT position, coalesce(avg(v), 0) AS mean FROM h GROUP BY position),
s AS (SELECT h.position, any_value(mean) AS mean, stddev_pop(coalesce(v, mean)) AS std FROM h JOIN m USING (position) GROUP BY h.position)"""


def fit_imputer(spark, folder):
    return rounded(Q.feature_stats(gappy(spark, folder), "imu").select("position", "mean"), ["mean"])


def fit_scaler(spark, folder):
    rows = Q.feature_stats(gappy(spark, folder), "imu").select("position", "mean", "scale")
    return rounded(rows, ["mean", "scale"])


def scale_features(spark, folder):
    rows = vectors(spark, folder).select("vec_id", F.col("embedding").alias("imu"))
    scaled = rows.withColumn("imu", Q.Scaler.fit(rows, "imu").apply("imu"))
    return rounded(scaled.select("vec_id", F.posexplode("imu").alias("position", "value")), ["value"])


SCALE_SQL = f"""WITH g AS (SELECT vec_id, unnest(range(64)) AS position, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, position::INTEGER AS position, {named('(v - avg(v) OVER w) / stddev_pop(v) OVER w', 'value')} FROM g WINDOW w AS (PARTITION BY position)"""


def fit_pca(spark, folder):
    """Every vector in all 64 directions, and what makes the first 8 the principal ones, from the scaled values and the scores alone.

    A vector keeps its power in all directions. Scores of the 8 do not vary together; a score's variance is the length of its covariances
    with all values, as for an eigenvector of length 1; variances fall, and the least is above the mean of what is left over.
    """
    rows = vectors(spark, folder).select("vec_id", F.col("embedding").alias("imu"))
    reducer = Q.Reducer.fit(rows, "imu", 8)
    scores = reducer.apply(rows, "imu").select("vec_id", F.posexplode("imu").alias("component", "y"))
    values = rows.select("vec_id", F.posexplode(reducer.scaler.apply("imu")).alias("position", "z"))
    other = scores.select("vec_id", F.col("component").alias("other"), F.col("y").alias("o"))
    n = rows.count()
    crossed = scores.join(values, "vec_id").groupBy("component", "position").agg((F.sum(F.col("y") * F.col("z")) / n).alias("c"))
    lengths = crossed.groupBy("component").agg(F.sqrt(F.sum(F.col("c") ** 2)).alias("length"))
    pairs = scores.join(other, "vec_id").groupBy("component", "other").agg((F.sum(F.col("y") * F.col("o")) / n).alias("v"))
    own = pairs.filter("component = other").select("component", F.col("v").alias("variance"))
    apart = pairs.filter("component <> other").groupBy("component").agg((F.max(F.abs("v")) < 1e-9).alias("uncorrelated"))
    facts = own.join(lengths, "component").join(apart, "component").join(own.select((F.col("component") - 1).alias("component"), F.col("variance").alias("next")), "component", "left")
    # eight rows
    every = Window.partitionBy(F.lit(0))
    facts = facts.withColumn("least", F.min("variance").over(every)).withColumn("kept", F.sum("variance").over(every)).select(
        "component", "uncorrelated", (F.abs(F.col("length") - F.col("variance")) < 1e-9).alias("principal"),
        (F.coalesce("next", F.lit(0.0)) <= F.col("variance")).alias("descending"), (F.col("least") > (64 - F.col("kept")) / 56).alias("leading"))
    proved = facts.agg(F.count(F.lit(1)).alias("components"), *[F.every(c).alias(c) for c in ("uncorrelated", "principal", "descending", "leading")])
    whole = Q.Reducer.fit(rows, "imu", 64, reducer.scaler).apply(rows, "imu").select(
        "vec_id", F.size("imu").alias("width"), F.aggregate("imu", F.lit(0.0), lambda a, v: a + v * v).alias("power"))
    return rounded(whole, ["power"]).crossJoin(F.broadcast(proved))


PCA_SQL = f"""WITH g AS (SELECT vec_id, unnest(range(64)) AS position, unnest(embedding)::DOUBLE AS v FROM embeddings),
z AS (SELECT vec_id, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM g WINDOW w AS (PARTITION BY position))
SELECT vec_id, 64 AS width, {named('sum(z * z)', 'power')}, 8 AS components, true AS uncorrelated, true AS principal, true AS descending, true AS leading
FROM z GROUP BY vec_id"""


def assemble_features(spark, folder):
    """Every position of the joined features has the mean 0 and the deviation 1 over all clips."""
    rows = features(spark, folder)
    wide = Q.Preprocessor.fit(rows, BLOCKS).transform(rows).select(F.posexplode(vector_to_array("features")).alias("position", "value"))
    return wide.groupBy("position").agg(
        F.count(F.lit(1)).alias("clips"), (F.abs(F.avg("value")) < 1e-9).alias("centred"), (F.abs(F.stddev_pop("value") - 1) < 1e-9).alias("scaled"))


ASSEMBLE_SQL = "SELECT unnest(range(64))::INTEGER AS position, (SELECT count(*) FROM embeddings) AS clips, true AS centred, true AS scaled"


def logistic_regression(spark, folder):
    """The slope of the penalized loss in every weight, from the probabilities of all clips: nowhere does it lead further down."""
    strength = 0.1
    model = M.ClipModel.fit(features(spark, folder), BLOCKS, "logistic_regression", {"C": strength})
    prepared = model.preprocessor.transform(features(spark, folder))
    fitted = model.classifier
    rows = fitted.probabilities(prepared).select("label", "probability", vector_to_array("features").alias("x"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    classes = F.array(*[F.lit(c) for c in fitted.classes])
    gaps = rows.join(sizes, "label").select("x", F.posexplode("probability").alias("row", "p"), (F.lit(total) / (len(fitted.classes) * F.col("_n"))).alias("w"), "label")
    gaps = gaps.withColumn("gap", F.col("w") * (F.col("p") - F.when(F.get(classes, F.col("row")) == F.col("label"), 1.0).otherwise(0.0)))
    slopes = gaps.select("row", "gap", F.posexplode("x").alias("position", "value")).groupBy("row", "position").agg(F.sum(F.col("gap") * F.col("value")).alias("slope"))
    matrix = fitted.models["combined"].coefficientMatrix.toArray()
    weights = F.from_json(F.lit(json.dumps(matrix.tolist())), "array<array<double>>")
    whole = strength * F.col("slope") + F.get(F.get(weights, F.col("row")), F.col("position"))
    return slopes.select(F.get(classes, F.col("row")).alias("class"), "position", (F.abs(whole) < 1e-3).alias("flat"))


LOGISTIC_SQL = "SELECT label AS class, unnest(range(64))::INTEGER AS position, true AS flat FROM (SELECT DISTINCT label FROM embeddings)"


def late_fusion(spark, folder):
    """Probabilities add up to one and the prediction has the highest, for every clip."""
    model = M.ClipModel.fit(features(spark, folder), BLOCKS, "late_fusion")
    listed = F.array(*[F.lit(c) for c in model.classifier.classes])
    return model.predict(features(spark, folder)).select(
        "clip_id", "label", F.size("probability").alias("classes"), (F.abs(F.aggregate("probability", F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9).alias("whole"),
        (F.get("probability", (F.array_position(listed, F.col("prediction")) - 1).cast("int")) == F.array_max("probability")).alias("best"))


FUSION_SQL = "SELECT vec_id AS clip_id, label, (SELECT count(DISTINCT label) FROM embeddings)::INTEGER AS classes, true AS whole, true AS best FROM embeddings"


def blend_probabilities(spark, folder):
    squares = lambda i: F.transform(F.slice("embedding", 16 * i + 1, 16), lambda v: v.cast("double") * v)
    parts = {"depth": squares(0), "imu": squares(1), "skeleton": squares(2), "combined": squares(3)}
    mixed = M.blend(parts, {"depth": 0.75, "imu": 1.25, "skeleton": 1.25, "combined": 0.5})
    return rounded(vectors(spark, folder).select("vec_id", F.posexplode(mixed).alias("class", "probability")), ["probability"])


BLEND_SQL = f"""WITH k AS (SELECT unnest(range(16)) AS k)
SELECT vec_id, k::INTEGER AS class, {named('(0.75 * embedding[k + 1]::DOUBLE ** 2 + 1.25 * embedding[k + 17]::DOUBLE ** 2 + 1.25 * embedding[k + 33]::DOUBLE ** 2 + 0.5 * embedding[k + 49]::DOUBLE ** 2) / 3.75', 'probability')}
FROM embeddings, k"""


def group_folds(spark, folder):
    rows = features(spark, folder)
    return rows.join(X.group_folds(rows, 5, 42), "user").select("clip_id", "user", "label", "fold")


# every group by its class vector to the fold that has least of it, class sizes as weights, all in whole numbers
def _folds_sql(folds: int) -> str:
    return """WITH RECURSIVE r AS (SELECT vec_id AS clip_id, label, (vec_id % 17)::VARCHAR AS "user" FROM embeddings),
k AS (SELECT label, count(*) AS n FROM r GROUP BY label),
w AS (SELECT list(((1000 * (SELECT count(*) FROM r)) // n) ** 2 ORDER BY label)::HUGEINT[] AS w FROM k),
v AS (SELECT "user", list(n ORDER BY label)::HUGEINT[] AS v, sum(n) AS size FROM (
  SELECT u."user", k.label, count(r.clip_id) AS n FROM (SELECT DISTINCT "user" FROM r) u CROSS JOIN k LEFT JOIN r ON r."user" = u."user" AND r.label = k.label GROUP BY ALL) GROUP BY "user"),
g AS (SELECT *, row_number() OVER (ORDER BY size DESC, md5("user" || ':42'), "user") AS i FROM v),
s AS (
  SELECT 0::BIGINT AS i, NULL::VARCHAR AS "user", 0 AS fold, list_transform(range(@), lambda f: list_transform(range(len(w)), lambda c: 0::HUGEINT)) AS totals FROM w
  UNION ALL
  SELECT i, "user", fold, list_transform(range(1, @ + 1), lambda f: CASE WHEN f = fold THEN list_transform(range(1, len(v) + 1), lambda c: totals[f][c] + v[c]) ELSE totals[f] END)
  FROM (SELECT g.i, g."user", v, totals, list_sort(list_transform(range(1, @ + 1), lambda f: {
          's': list_sum(list_transform(range(1, len(v) + 1), lambda c: totals[f][c] * v[c] * w[c])), 'n': list_sum(totals[f]), 'f': f}))[1].f::INTEGER AS fold
        FROM s JOIN g ON g.i = s.i + 1, w))
""".replace("@", str(folds))


GROUP_FOLDS_SQL = _folds_sql(5) + 'SELECT clip_id, "user", label, fold FROM r JOIN s USING ("user")'


def cross_validate(spark, folder):
    algorithm = M.get_algorithm("logistic_regression")
    rows = features(spark, folder).persist()
    found = X.cross_validate(rows, BLOCKS, algorithm, [{"C": 0.01}, {"C": 0.1}], folds=3, repeats=1)
    rows.unpersist()
    known = F.get("probability", (F.array_position(F.array(*[F.lit(c) for c in range(10)]), F.col("prediction")) - 1).cast("int"))
    return found.select("repeat", "fold", "candidate", "clip_id", "user", "label",
                        (F.abs(F.aggregate("probability", F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9).alias("whole"), (known == F.array_max("probability")).alias("best"))


# every clip once for each candidate, in the fold of its participant
CROSS_SQL = _folds_sql(3) + 'SELECT 1 AS repeat, fold, unnest([0, 1]) AS candidate, clip_id, "user", label, true AS whole, true AS best FROM r JOIN s USING ("user")'


QUERIES = {f.__name__: f for f in (
    fit_imputer, fit_scaler, scale_features, fit_pca, assemble_features, logistic_regression, late_fusion,
    blend_probabilities, group_folds, cross_validate,
)}

ORACLES = {
    "fit_imputer": f"WITH {GAPPY} SELECT position::INTEGER AS position, {named('mean', 'mean')} FROM m",
    "fit_scaler": f"WITH {GAPPY} SELECT position::INTEGER AS position, {named('mean', 'mean')}, {named('CASE WHEN std <= 1e-12 THEN 1 ELSE std END', 'scale')} FROM s",
    "scale_features": SCALE_SQL,
    "fit_pca": PCA_SQL,
    "blend_probabilities": BLEND_SQL,
    "group_folds": GROUP_FOLDS_SQL,
    "assemble_features": ASSEMBLE_SQL,
    "logistic_regression": LOGISTIC_SQL,
    "late_fusion": FUSION_SQL,
    "cross_validate": CROSS_SQL,
}
