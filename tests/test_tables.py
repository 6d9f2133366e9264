import pytest
from pyspark.sql import functions as F

from sensorframe.functions import columns as C
from sensorframe.operators import clips as K
from sensorframe.operators import sampling as P
from sensorframe.plans import evaluate as E
from sensorframe.sources import scan, sink


@pytest.fixture(scope="module")
def mapping(spark):
    return spark.createDataFrame([(1, "one"), (2, "two"), (34, "many")], "action_id int, action_name string")


def test_mapping_rules(spark, tmp_path):
    def load(text):
        file = tmp_path / "m.csv"
        file.write_text(text, encoding="utf-8")
        spark.catalog.clearCache()
        return scan.read_class_mapping(spark, str(file))

    assert load("action_id,action_name\n1,a\n2,b\n").count() == 2
    for bad in ("action_id,action_name\n1,a\n1,b\n", "action_id,action_name\n1, \n", "action_id,action_name\nx,a\n",
                "action_id,action_name\n", "id,name\n1,a\n"):
        with pytest.raises(K.DataError):
            load(bad)


@pytest.mark.parametrize("text,problem", [
    ("path,prediction\nx/a/,34.0\n", "not an integer"), ("path,prediction\nx/a,9\n", "unknown action"),
    ("path,prediction\n/,1\n", "empty identifier"), ("path,prediction\nx/a,1\ny/a,2\n", "duplicate clip"),
])
def test_prediction_rules(spark, tmp_path, mapping, text, problem):
    file = tmp_path / "p.csv"
    file.write_text(text)
    with pytest.raises(K.DataError, match=problem):
        scan.read_predictions(spark, str(file), mapping)


def test_prediction_identifiers(spark, tmp_path, mapping):
    file = tmp_path / "p.csv"
    file.write_text("clip_id,path,prediction\n/a\\b/,, +1\nc,./x/c,\nd,./x/d,34\n")
    good, counters = scan.read_predictions(spark, str(file), mapping)
    rows = {r["clip_id"]: r for r in good.collect()}
    assert set(rows) == {"a/b", "d"} and rows["a/b"]["submission_path"] == "a/b" and rows["d"]["submission_path"] == "./x/d"
    assert counters.first().asDict() == {"rows_read": 3, "blank_predictions": 1}
    with pytest.raises(K.DataError):
        scan.prediction_rows(spark.createDataFrame([("a",)], "name string"))


def test_label_tables(spark, tmp_path, mapping):
    def load(text, name="l.csv"):
        file = tmp_path / name
        file.write_text(text, encoding="utf-8")
        return scan.read_label_table(spark, str(file), mapping)

    rows = load("path,prediction\na,1\nb,\n").orderBy("place").collect()
    assert [(r["path"], r["prediction"]) for r in rows] == [("a", "1"), ("b", "")]
    for i, bad in enumerate(("path,prediction\na,1,2\n", "path,prediction\na\n", "path,prediction\na,1\na,2\n",
                             "path,prediction\n ,1\n", "path,prediction\na,x\n", "path,prediction\na,77\n", "path,label\na,1\n")):
        with pytest.raises(K.DataError):
            load(bad, f"bad{i}.csv")
    table = spark.createDataFrame([(0, "a", "2"), (1, "b", "")], "place long, path string, prediction string")
    sink.write_label_table(table, str(tmp_path / "out"), mapping)
    back = scan.read_label_table(spark, str(tmp_path / "out"), mapping).orderBy("place").collect()
    assert [(r["path"], r["prediction"]) for r in back] == [("a", "2"), ("b", "")]
    with pytest.raises(K.DataError):
        sink.write_label_table(table.withColumn("path", F.lit("same")), str(tmp_path / "bad"))


def test_resume_labels(spark):
    source = spark.createDataFrame([(0, "a", "9"), (1, "b", "9")], "place long, path string, prediction string")
    fresh, moved = K.resume_labels(source, None, "path", "place")
    assert {r["prediction"] for r in fresh.collect()} == {""} and moved.isEmpty()
    existing = spark.createDataFrame([(0, "b", "1"), (1, "a", "")], "place long, path string, prediction string")
    assert K.resume_labels(source, existing, "path", "place")[1].count() == 2
    same = spark.createDataFrame([(0, "a", "1"), (1, "b", "")], "place long, path string, prediction string")
    rows, moved = K.resume_labels(source, same, "path", "place")
    assert moved.isEmpty() and [r["prediction"] for r in rows.orderBy("place").collect()] == ["1", ""]


def test_next_unlabeled_wraps(spark):
    for labeled, want in (([True, False, True, False], [1, 3, 3, 1]), ([True] * 3, [1, 2, 0]), ([False], [0]), ([True, False], [1, 0])):
        rows = spark.createDataFrame(list(enumerate(labeled)), "i long, done boolean")
        found = P.next_unlabeled(rows, "i", "i", F.col("done")).orderBy("i").collect()
        assert [r["next_item"] for r in found] == want
    assert P.initial_unlabeled(spark.createDataFrame([(0, True), (1, False)], "i long, done boolean"), "i", "i", F.col("done")).first()[0] == 1


def test_budget():
    assert P.split_budget({"train": 4, "test": 4}, 5) == {"train": 3, "test": 2}
    assert P.split_budget({"train": 1, "test": 9}, 6) == {"train": 1, "test": 5}
    assert P.split_budget({"train": 9, "test": 1}, 6) == {"train": 5, "test": 1}
    assert P.split_budget({"test": 2}, 5) == {"test": 2}


def test_natural_order(spark):
    names = ["user10", "user2", "User1", "a", "", None, "10x", "9", "user2b"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    ordered = [r["name"] for r in df.orderBy(C.natural_key(F.col("name")), "name").collect()]
    assert ordered == [None, "", "9", "10x", "a", "User1", "user2", "user2b", "user10"]


def test_labels(spark):
    df = spark.createDataFrame([("3_Wave_arm",), (None,), ("Sit_down",), ("x_3",)], "n string")
    assert [r[0] for r in df.select(C.pretty_label(F.col("n"))).collect()] == ["Wave arm", "Unknown", "Sit down", "x 3"]
    assert df.select(C.prediction_label(F.lit(3), F.col("n"))).first()[0] == "03 · Wave arm"


def test_blocks():
    assert C.normalize_blocks(["skeleton", " imu ", ""]) == ("imu", "skeleton")
    assert "ir" not in C.normalize_blocks(None) and len(C.normalize_blocks(None)) == 7
    for bad in (["nothing"], [], [""]):
        with pytest.raises(ValueError):
            C.normalize_blocks(bad)


def test_metrics_label_sets(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 5)], "label int, prediction int")
    m = E.classification_metrics(rows).first()
    assert m["accuracy"] == 0.5 and m["balanced_accuracy"] == 0.5
    assert m["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    per_class = {r["class_id"]: r for r in E.per_class_metrics(rows, E.class_table(spark, [0, 1, 2])).collect()}
    assert per_class[2]["support"] == 0 and per_class[2]["f1"] == 0 and per_class[0]["precision"] == 1


def test_confusion_delta(spark):
    a = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 0, 0), (1, 1, 0)], "actual int, predicted int, clips long")
    b = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 2)], "actual int, predicted int, clips long")
    found = {(r["actual"], r["predicted"]): r["delta"] for r in E.confusion_delta(a, b).collect()}
    assert found == {(0, 0): 0.25, (0, 1): -0.25, (1, 0): 0.0, (1, 1): -1.0}


def test_vote_ties_are_spread(spark):
    rows = [(clip, p) for clip in range(300) for p in (1, 2)]
    found = E.majority_vote(spark.createDataFrame(rows, "clip int, prediction int"), "clip", 42)
    share = found.filter("prediction = 1").count() / 300
    assert 0.35 < share < 0.65
    clear = spark.createDataFrame([(0, 1), (0, 2), (0, 2)], "clip int, prediction int")
    assert E.majority_vote(clear, "clip", 1).first()["prediction"] == 2
    means = spark.createDataFrame([(0, [0.5, 0.5]), (0, [0.5, 0.5])], "clip int, probability array<double>")
    assert E.mean_consensus(means, "clip", [7, 9]).first()["prediction"] == 7


def test_timeline(spark):
    rows = [("c", "Depth_Color", i, f"d{i}") for i in range(3)] + [("c", "Thermal", i, f"t{i}") for i in range(8)]
    rows += [("t", "Thermal", i, f"t{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "clip_id string, modality string, i int, member_path string")
    from sensorframe.skew import OrderedGroups

    shown = K.align_timeline(OrderedGroups(df, ["clip_id", "modality"], ["i"], F.col("i")), ("Depth_Color", "IR", "Skeleton"), "Thermal")
    found = {(r["clip_id"], r["modality"], r["frame"]): r["member_path"] for r in shown.collect()}
    assert [found["c", "Depth_Color", i] for i in range(3)] == ["d0", "d1", "d2"]
    assert [found["c", "Thermal", i] for i in range(3)] == ["t0", "t4", "t7"]
    assert [found["t", "Thermal", i] for i in range(4)] == ["t0", "t1", "t2", "t3"]
    assert len(found) == 10


def test_leaderboard_and_its_sql_round_alike(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from compare import compare

    # every balance puts the score halfway between two thousandths
    rows = [(k, 20.0 * ((k * 37) % 500) + 10, "BUILDING", 1) for k in range(1, 500)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert compare(entry.queries()["leaderboard"](spark, str(tmp_path)), con, entry.oracle_sql()["leaderboard"])[0] is None


def test_a_report_is_read_once(spark):
    text = ('{"selected_parameters": {"b": "x\\"]", "a": 1.0}, "aggregate_metrics": [{"parameters": {"a": 2}, "metrics": {"macro_f1": 1}}, '
            '{"parameters": {"a": 1.0, "b": "x\\"]"}, "metrics": {"macro_f1": 2}}], "folds": [{"fold": 3, "candidates": '
            '[{"parameters": {"a": 2}, "metrics": {"macro_f1": 3}}, {"parameters": {"b": "x\\"]", "a": 1.0}, "metrics": {"macro_f1": 4}}]}, {"candidates": []}]}')
    rows = spark.range(2).select(F.concat(F.lit("r"), F.col("id")).alias("report"), F.lit("run").alias("artifact_name"),
                                 F.concat(F.lit(text), F.repeat(F.lit(" "), F.col("id").cast("int"))).alias("value"), F.lit(None).cast("string").alias("error"))
    compared, series = E.comparison_rows(E.parsed_reports(rows)), E.fold_series(E.parsed_reports(rows), "macro_f1")
    assert [(r["macro_f1"], r["parameters"]) for r in compared.collect()] == [(2, '{"a": 1.0, "b": "x\\"]"}')] * 2
    assert [(r["fold"], r["macro_f1"]) for r in series.collect()] == [(3, 4)] * 2
    for found in (compared, series):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(StructField(") == 1
