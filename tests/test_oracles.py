import pytest

import __spark_entry__ as entry
from compare import compare, connect
from sensorframe.skew import HOT_ROWS_CONF

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# order-dependent queries repeated with every group cut into slices
CUT = ("signal_features", "circular_features", "quaternion_features", "file_count_box", "align_timeline",
       "evenly_sample", "next_unlabeled", "manifest_order", "unique_run_labels", "joint_motion", "frame_summaries",
       "member_order", "active_subset", "round_robin_sample", "split_budget", "natural_key", "fill_gaps", "resample",
       "dynamic_features", "pair_features", "imu_features", "leaderboard", "torso_geometry", "pose_normalize",
       "score_summary", "bone_lengths", "stabilize_pose", "person_track", "grid_pool", "motion_center",
       "value_histogram", "group_folds")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name])[0] is None
    else:
        assert df.limit(1).count() == 1


@pytest.mark.parametrize("name", CUT)
def test_query_on_cut_groups(spark, con, name):
    spark.conf.set(HOT_ROWS_CONF, "7")
    try:
        assert compare(entry.queries()[name](spark, FOLDER), con, ORACLES[name])[0] is None
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
