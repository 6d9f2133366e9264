import random
import re

import pytest
from pyspark.sql import functions as F

from sensorframe import skew
from sensorframe.operators import sampling
from sensorframe.plans import extract
from sensorframe.skew import OrderedGroups
from sensorframe.sources import scan, tree


def natural(text):
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", text)]


def grow(root, actions, tests=0, modality="Depth_Color"):
    """A tree with the given {action: {user: trials}} and a number of test clips."""
    for action, users in actions.items():
        (root / "HAR" / "data" / modality / action).mkdir(parents=True, exist_ok=True)
        for user, trials in users.items():
            (root / "HAR" / "data" / modality / action / user).mkdir(exist_ok=True)
            for t in range(1, trials + 1):
                clip = root / "HAR" / "data" / modality / action / user / f"1-1-{t}"
                clip.mkdir()
                (clip / f"frame_{t}.png").write_bytes(b"png")
    for i in range(tests):
        clip = root / "small_model_track_test" / f"SM_test_{i:04d}" / "IR"
        clip.mkdir(parents=True)
        (clip / "frame_1.png").write_bytes(b"x" * i)
    return {"train": str(root / "HAR"), "test": str(root / "small_model_track_test")}


def in_turn(actions, limit):
    lists = [[f"{a}/{u}/1-1-{t}" for u in sorted(us, key=natural) for t in range(1, us[u] + 1)] for a, us in sorted(actions.items(), key=lambda p: natural(p[0]))]
    return [xs[i] for i in range(max(map(len, lists), default=0)) for xs in lists if i < len(xs)][:limit]


def evenly(names, limit):
    if len(names) <= limit:
        return names
    return names[:1] if limit == 1 else [names[round(i * (len(names) - 1) / (limit - 1))] for i in range(limit)]


def picked(df):
    return [r["clip_id"] for r in df.orderBy("place").collect()]


@pytest.fixture
def counted(spark):
    return spark.sparkContext.accumulator(0)


def test_first_clips_are_spread_over_actions(spark, tmp_path, counted):
    roots = grow(tmp_path, {"0_Wash_face": {"user1": 3}, "1_Brush_teeth": {"user1": 3}})
    assert picked(tree.initial_clips(spark, roots["train"], "train", 2, counted)) == ["0_Wash_face/user1/1-1-1", "1_Brush_teeth/user1/1-1-1"]
    # the folder of actions, and one participant of each
    assert counted.value == 5


@pytest.mark.parametrize("limit", [1, 4, 9, 17, 40, 1000])
def test_walk_equals_the_full_order(spark, tmp_path, limit):
    rng = random.Random(7)
    actions = {f"{a}_Act": {f"user{u}": rng.choice([0, 1, 1, 2, 5]) for u in rng.sample(range(30), rng.choice([0, 1, 3, 8]))} for a in (10, 2, 33, 4, 5, 100)}
    roots = grow(tmp_path, actions)
    assert picked(tree.initial_clips(spark, roots["train"], "train", limit)) == in_turn(actions, limit)


def test_equal_to_sampling_the_full_index(spark, tmp_path):
    actions = {f"{a}_Act": {f"user{u}": 1 + (a * u) % 3 for u in range(1, 6)} for a in range(7)}
    roots = grow(tmp_path, actions)
    clips = scan.scan_split(spark, roots["train"], "train").select("split", "clip_id", "action_id", "user", "trial").distinct()
    groups = OrderedGroups(clips, ["action_id"], sampling.manifest_order(), None)
    full = [r["clip_id"] for r in sampling.round_robin_sample(groups, ["action_id"], 23).collect()]
    assert picked(tree.initial_clips(spark, roots["train"], "train", 23)) == full


def test_listings_stay_near_the_quota(spark, tmp_path, counted):
    actions = {f"{a}_Act": {f"user{u}": 2 for u in range(25)} for a in range(12)}
    roots = grow(tmp_path, actions)
    assert picked(tree.initial_clips(spark, roots["train"], "train", 30, counted)) == in_turn(actions, 30)
    # 12 folders of participants and one of actions; 312 folders hold trials, 2 or 3 of each action are enough
    assert 13 < counted.value <= 13 + 12 + 2 * 12
    before = counted.value
    manifest = tree.initial_manifest(spark, {"train": roots["train"]}, 30, counted).collect()
    assert len(manifest) == 30 and counted.value - before <= 13 + 36 + 30 * 7
    few = spark.sparkContext.accumulator(0)
    # of more actions than the quota the later ones are not opened
    assert len(picked(tree.initial_clips(spark, roots["train"], "train", 3, few))) == 3 and few.value == 1 + 3 + 3


def test_quota_is_divided_and_passed_on(spark, tmp_path):
    one, two, three = tmp_path / "a", tmp_path / "b", tmp_path / "c"
    roots = grow(one, {f"{i}_Action": {"user1": 1} for i in range(4)}, tests=4)
    count = lambda df: {s: df.filter(F.col("split") == s).count() for s in ("train", "test")}
    assert count(tree.initial_manifest(spark, roots, 5)) == {"train": 3, "test": 2}
    assert count(tree.initial_selection(spark, roots, 100)) == {"train": 4, "test": 4}
    roots = grow(two, {"1_Action": {"user1": 1}}, tests=30)
    chosen = tree.initial_selection(spark, roots, 10)
    names = [f"SM_test_{i:04d}" for i in range(30)]
    first = evenly(names, 5)
    assert picked(chosen.filter("split = 'test'")) == first + [n for n in evenly(names, 9) if n not in first][:4]
    roots = grow(three, {"1_Action": {f"user{u}": 3 for u in range(9)}}, tests=1)
    chosen = tree.initial_selection(spark, roots, 11)
    assert picked(chosen.filter("split = 'train'")) == in_turn({"1_Action": {f"user{u}": 3 for u in range(9)}}, 10)
    assert tree.initial_selection(spark, roots, 0).isEmpty()
    assert picked(tree.initial_clips(spark, str(two / "small_model_track_test"), "test", 1)) == ["SM_test_0000"]


def test_another_modality_stands_in(spark, tmp_path):
    (tmp_path / "HAR" / "data" / "Depth_Color" / "1_Empty").mkdir(parents=True)
    roots = grow(tmp_path, {"2_Sit": {"user1": 2, ".hidden": 1}}, modality="IR")
    assert picked(tree.initial_clips(spark, roots["train"], "train", 9)) == ["2_Sit/user1/1-1-1", "2_Sit/user1/1-1-2"]
    assert tree.initial_clips(spark, str(tmp_path / "nothing"), "train", 9).isEmpty()


def test_manifest_rows_are_those_of_the_full_manifest(spark, tree_files):
    roots = {"train": tree_files["train"], "test": tree_files["test"]}
    part = tree.initial_manifest(spark, roots, 6).drop("source_path")
    full = extract.index_split(spark, roots["train"], "train").unionByName(extract.index_split(spark, roots["test"], "test")).drop("source_path")
    rows = {(r["split"], r["clip_id"]): r for r in full.select(part.columns).collect()}
    found = part.collect()
    assert len(found) == 6 and all(rows[r["split"], r["clip_id"]] == r for r in found)


@pytest.fixture(scope="module")
def tree_files(tmp_path_factory):
    import fixtures

    return fixtures.write_tree(tmp_path_factory.mktemp("files"))


def test_rows_in_text_order_are_cut_early(spark, monkeypatch):
    """Slices by the whole order are smaller than hot groups."""
    monkeypatch.setattr(skew, "ORDERED_ROWS", 50, raising=False)
    rows = spark.range(400).select(F.concat(F.lit("user"), F.col("id")).alias("u"))
    groups = OrderedGroups(rows, [], [F.array("u")], None)
    assert groups.is_cut and groups.df.groupBy(skew.SLICE).count().agg(F.max("count")).first()[0] <= 100
    found = groups.scan(p=skew.position()).rows().orderBy("u").collect()
    assert [r["p"] for r in found] == list(range(400))
