"""Registered queries over clip manifests, joins and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.catalog.common import (
    EVENT_TYPES,
    event_series,
    micros,
    named,
    r,
    rounded,
    table,
)
from sensorframe.functions import columns as C
from sensorframe.operators import clips as K
from sensorframe.operators import sampling as P
from sensorframe.schema import MODALITIES, PLAYER_MODALITIES, REQUIRED_MODALITIES
from sensorframe.skew import OrderedGroups
from sensorframe.sources import scan

# ---------------------------------------------------------------- events as a tree of sensor files


def member_paths(spark, folder):
    """One file path per event: the event number picks the modality, user and day the clip."""
    user, number = F.col("user_id"), F.col("event_id")
    modality = F.element_at(F.array(*[F.lit(m) for m in MODALITIES]), (number % 6 + 1).cast("int"))
    action = F.concat((user % 12).cast("string"), F.lit("_Act_"), (user % 12).cast("string"))
    stamp = F.date_format("ts", "yyyy-MM-dd_HH-00-00.000")
    suffix = F.when(number % 6 < 3, ".png").when(number % 6 == 5, ".json").otherwise(".csv")
    root = F.when(number % 50 == 7, "__MACOSX").when(number % 50 == 8, ".hidden").otherwise(modality)
    return table(spark, folder, "events").select(
        F.concat_ws(
            "/", F.lit("HAR/data"), root, action, F.concat(F.lit("user"), user.cast("string")),
            F.date_format("ts", "yyyyMMdd"),
            F.concat(F.lit("Depth_"), stamp, F.lit("_"), (number % 1000).cast("string"), suffix),
        ).alias("path"),
        (F.floor(number / 6) % 4 * 100).alias("length"),
    )


def members(spark, folder):
    return scan.parse_members(member_paths(spark, folder), "train")


MEMBERS = """
m0 AS (SELECT *, [{modalities}][(event_id % 6 + 1)] AS modality, (user_id % 12) || '_Act_' || (user_id % 12) AS action_name,
    'user' || user_id AS "user", strftime(ts, '%Y%m%d') AS trial, strftime(ts, '%Y-%m-%d_%H-00-00.000') AS stamp,
    CASE WHEN event_id % 6 < 3 THEN '.png' WHEN event_id % 6 = 5 THEN '.json' ELSE '.csv' END AS suffix
  FROM events WHERE event_id % 50 NOT IN (7, 8)),
m AS (SELECT 'train' AS split, action_name || '/' || "user" || '/' || trial AS clip_id, modality,
    'HAR/data/' || modality || '/' || action_name || '/' || "user" || '/' || trial || '/Depth_' || stamp || '_'
      || (event_id % 1000) || suffix AS member_path,
    (event_id // 6 % 4 * 100)::BIGINT AS size, (user_id % 12)::INTEGER AS action_id, action_name, "user", trial,
    stamp AS "timestamp", CASE WHEN suffix <> '.csv' THEN event_id % 1000 END AS frame_index FROM m0)
""".format(modalities=", ".join(f"'{m}'" for m in MODALITIES))


def parse_members(spark, folder):
    return members(spark, folder)


def drop_ignored(spark, folder):
    return scan.drop_ignored(member_paths(spark, folder)).groupBy("path").agg(F.count(F.lit(1)).alias("files"))


DROP_IGNORED_SQL = f"WITH {MEMBERS} SELECT member_path AS path, count(*) AS files FROM m GROUP BY member_path"


def manifest(spark, folder):
    return K.with_issues(K.build_manifest(members(spark, folder)))


def build_manifest(spark, folder):
    return rounded(manifest(spark, folder), ["duration_seconds"], 3)


def _manifest_sql() -> str:
    counts = ",\n  ".join(
        f"count(*) FILTER (modality = '{m}')::BIGINT AS {m.lower()}_file_count, "
        f"coalesce(sum(size) FILTER (modality = '{m}'), 0)::BIGINT AS {m.lower()}_bytes" for m in MODALITIES
    )
    stamps = ", ".join(f"list_sort(list_distinct(list(\"timestamp\") FILTER (modality = '{m}'))) AS t_{m}"
                       for m in ("Depth_Color", "IR", "Skeleton"))
    present = ", ".join(f"{m.lower()}_file_count > 0 AS {m.lower()}_present" for m in MODALITIES)
    number = " + ".join(f"({m.lower()}_file_count > 0)::INTEGER" for m in MODALITIES)
    missing = ", ".join(f"CASE WHEN {m.lower()}_file_count = 0 THEN '{m}' END" for m in MODALITIES)
    total = " + ".join(f"{m.lower()}_file_count" for m in MODALITIES)
    keep = ", ".join(f"{m.lower()}_file_count, {m.lower()}_bytes" for m in MODALITIES)
    return f"""{MEMBERS},
c AS (SELECT split, clip_id, any_value(action_id) AS action_id, any_value(action_name) AS action_name,
  any_value("user") AS "user", any_value(trial) AS trial,
  coalesce(min("timestamp") FILTER (modality = 'Depth_Color'), min("timestamp") FILTER (modality = 'IR')) AS start_timestamp,
  coalesce(max("timestamp") FILTER (modality = 'Depth_Color'), max("timestamp") FILTER (modality = 'IR')) AS end_timestamp,
  {stamps}, {counts} FROM m GROUP BY split, clip_id),
d AS (SELECT *, {present}, ({number})::INTEGER AS modality_count, concat_ws(', ', {missing}) AS missing_modalities,
  ({total})::BIGINT AS total_file_count,
  CASE WHEN len(t_Depth_Color) > 0 AND len(t_IR) > 0 THEN t_Depth_Color = t_IR END AS depth_ir_aligned,
  CASE WHEN len(t_Depth_Color) > 0 AND len(t_Skeleton) > 0 THEN t_Depth_Color = t_Skeleton END AS depth_skeleton_aligned,
  epoch(strptime(end_timestamp[:19], '%Y-%m-%d_%H-%M-%S') - strptime(start_timestamp[:19], '%Y-%m-%d_%H-%M-%S')) AS duration_seconds
  FROM c),
manifest AS (SELECT split, clip_id, action_id, action_name, "user", trial, {keep},
  {", ".join(m.lower() + "_present" for m in MODALITIES)}, start_timestamp, end_timestamp, depth_ir_aligned,
  depth_skeleton_aligned, {named("duration_seconds", "duration_seconds", 3)}, modality_count, modality_count = 6 AS complete,
  missing_modalities, total_file_count,
  concat_ws('; ', CASE WHEN missing_modalities <> '' THEN 'missing: ' || missing_modalities END,
    CASE WHEN NOT depth_ir_aligned THEN 'Depth/IR timestamps differ' END,
    CASE WHEN NOT depth_skeleton_aligned THEN 'Depth/Skeleton timestamps differ' END) AS issues FROM d)"""


MANIFEST = _manifest_sql()


def issue_string(spark, folder):
    return manifest(spark, folder).groupBy("issues").agg(F.count(F.lit(1)).alias("clips"))


def timestamps_aligned(spark, folder):
    return manifest(spark, folder).groupBy("depth_ir_aligned", "depth_skeleton_aligned").agg(
        F.count(F.lit(1)).alias("clips")
    )


def overview_kpis(spark, folder):
    rows = manifest(spark, folder)
    rows = rows.withColumn("split", F.when(F.col("action_id") % 4 == 3, "test").otherwise("train"))
    return rounded(K.overview_kpis(rows), ["complete_share"])


OVERVIEW_SQL = f"""WITH {MANIFEST}
SELECT count(*) FILTER (action_id % 4 <> 3) AS train_clips, count(*) FILTER (action_id % 4 = 3) AS test_clips,
  count(DISTINCT action_name) AS actions, count(DISTINCT "user") AS users,
  {named('avg(complete::INTEGER) * 100', 'complete_share')} FROM manifest"""


def modality_coverage(spark, folder):
    return rounded(K.modality_coverage(manifest(spark, folder)), ["coverage"])


COVERAGE_SQL = f"WITH {MANIFEST} " + " UNION ALL ".join(
    f"SELECT '{m}' AS modality, count(*) FILTER ({m.lower()}_present) AS clips, "
    f"{named(f'count(*) FILTER ({m.lower()}_present) * 100.0 / count(*)', 'coverage')} FROM manifest"
    for m in MODALITIES
)


def file_count_box(spark, folder):
    boxes = K.file_count_box(manifest(spark, folder))
    return rounded(boxes, ["low", "q1", "median", "q3", "high"])


FILE_COUNT_SQL = f"WITH {MANIFEST}, u AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS modality, split, {m.lower()}_file_count AS files FROM manifest" for m in MODALITIES
) + f""") SELECT modality, split, {named('min(files)', 'low')}, {named('quantile_cont(files, 0.25)', 'q1')},
  {named('quantile_cont(files, 0.5)', 'median')}, {named('quantile_cont(files, 0.75)', 'q3')}, {named('max(files)', 'high')}
FROM u WHERE files > 0 GROUP BY modality, split"""


def modality_combinations(spark, folder):
    return K.modality_combinations(manifest(spark, folder))


COMBINATIONS_SQL = f"""WITH {MANIFEST}
SELECT concat_ws(' + ', {", ".join(f"CASE WHEN {m.lower()}_present THEN '{m}' END" for m in MODALITIES)}) AS combination,
  count(*) AS clips FROM manifest GROUP BY 1"""


def quality_kpis(spark, folder):
    return K.quality_kpis(manifest(spark, folder).join(content_quality(spark, folder), ["split", "clip_id"], "left"))


QUALITY_SQL = f"""WITH {MANIFEST},
content AS (SELECT clip_id, sum(size) FILTER (modality = 'Radar') = 0 AS radar_empty, count(*) FILTER (modality = 'IMU' AND size = 0) AS imu_empty FROM m GROUP BY clip_id)
SELECT count(*) FILTER (NOT complete) AS incomplete_clips, (SELECT count(*) FROM content WHERE radar_empty) AS empty_radar,
  (SELECT sum(imu_empty)::BIGINT FROM content) AS empty_imu_files,
  count(*) FILTER (coalesce(NOT depth_ir_aligned, false) OR coalesce(NOT depth_skeleton_aligned, false)) AS misaligned_clips,
  {", ".join(f"count(*) FILTER (NOT {m.lower()}_present) AS {m.lower()}_missing" for m in MODALITIES)} FROM manifest"""


def issue_counts(spark, folder):
    return K.issue_counts(table(spark, folder, "documents"), "text", " ")


def flagged_clips(spark, folder):
    return K.flagged_clips(manifest(spark, folder), ["clip_id", "modality_count", "issues"])


def content_quality(spark, folder):
    rows = members(spark, folder).select(
        "split", "clip_id", "modality",
        F.when(F.col("modality").isin("IMU", "Radar"), F.col("size") / 100).cast("long").alias("data_rows"),
        F.when(F.col("modality") == "Skeleton", F.floor(F.col("size") / 150)).alias("people"),
        ((F.col("modality") == "Skeleton") & (F.col("size") == 100)).alias("bad_json"),
    )
    return K.content_quality(rows)


CONTENT_SQL = f"""WITH {MEMBERS}
SELECT split, clip_id, count(*) FILTER (modality = 'IMU' AND size = 0) AS imu_empty_files,
  (sum(size / 100) FILTER (modality = 'Radar'))::BIGINT AS radar_data_rows,
  (sum(size / 100) FILTER (modality = 'Radar')) = 0 AS radar_empty,
  count(*) FILTER (modality = 'Skeleton' AND size = 0) AS skeleton_empty_frames,
  count(*) FILTER (modality = 'Skeleton' AND size = 300) AS skeleton_multi_person_frames,
  count(*) FILTER (modality = 'Skeleton' AND size = 100) AS skeleton_bad_json FROM m GROUP BY split, clip_id"""


def member_index(spark, folder):
    return K.member_index(members(spark, folder)).select("clip_id", "modality", "member_path", "position", "members")


MEMBER_INDEX_SQL = f"""WITH {MEMBERS} SELECT clip_id, modality, member_path,
  row_number() OVER (PARTITION BY split, clip_id, modality ORDER BY coalesce("timestamp", ''), coalesce(frame_index, -1), member_path) - 1 AS position,
  count(*) OVER (PARTITION BY split, clip_id, modality) AS members FROM m"""


def member_order(spark, folder):
    rows = members(spark, folder)
    groups = OrderedGroups(rows, ["user"], P.member_order(), None)
    return P.numbered(groups).select("user", "member_path", "position")


MEMBER_ORDER_SQL = f"""WITH {MEMBERS} SELECT "user", member_path,
  row_number() OVER (PARTITION BY "user" ORDER BY coalesce("timestamp", ''), coalesce(frame_index, -1), member_path) - 1 AS position FROM m"""


def manifest_order(spark, folder):
    rows = manifest(spark, folder)
    groups = OrderedGroups(rows, [], P.manifest_order(), None)
    return P.numbered(groups).select("clip_id", "position")


MANIFEST_ORDER_SQL = f"""WITH {MANIFEST} SELECT clip_id,
  row_number() OVER (ORDER BY action_id, substr("user", 5)::INTEGER, trial, clip_id) - 1 AS position FROM manifest"""


def discovery_flags(spark, folder):
    rows = members(spark, folder)
    imu = rows.filter(F.col("modality") == "IMU").select(
        "split", "clip_id", F.col("member_path").alias("path"),
        F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("size") / 100 % 2 + 1).cast("int")).alias("device"),
        F.col("size").alias("data_rows"),
    )
    # clips last ten days here, so that every step keeps some and loses some
    decade = F.regexp_replace("clip_id", r"\d$", "")
    return K.discovery_flags(rows.withColumn("clip_id", decade), imu.withColumn("clip_id", decade), devices=("A", "B"))


def complete_case(spark, folder):
    return K.complete_case(discovery_flags(spark, folder))


def discovery_funnel(spark, folder):
    return K.discovery_funnel(discovery_flags(spark, folder))


FLAGS = f"""{MEMBERS},
w AS (SELECT *, clip_id[:-2] AS clip FROM m),
q AS (SELECT clip, any_value(action_id) AS action_id, any_value("user") AS "user",
  count(DISTINCT modality) FILTER (modality IN ('Depth_Color', 'IR', 'IMU', 'Skeleton')) = 4 AS modality_complete,
  coalesce(bool_or(size > 0) FILTER (modality = 'Depth_Color'), false) AND coalesce(bool_or(size > 0) FILTER (modality = 'IR'), false)
    AND coalesce(bool_or(size > 0) FILTER (modality = 'Skeleton'), false) AS usable,
  count(DISTINCT member_path) FILTER (modality = 'IMU' AND size > 0) AS imu_files,
  count(DISTINCT size / 100 % 2) FILTER (modality = 'IMU') = 2 AS devices FROM w GROUP BY clip),
k AS (SELECT *, modality_complete AND usable AND imu_files >= 2 AS nonempty FROM q)"""


def modality_keys(spark, folder):
    return K.modality_keys(members(spark, folder), "clip_id", REQUIRED_MODALITIES)


MODALITY_KEYS_SQL = f"""WITH {MEMBERS} SELECT clip_id,
  count(DISTINCT modality) FILTER (modality IN ('Depth_Color', 'IR', 'IMU', 'Skeleton')) = 4 AS in_all FROM m GROUP BY clip_id"""


def has_all(spark, folder):
    rows = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return K.has_all(rows, ["user_id", "day"], "event_type", EVENT_TYPES)


def inspect_devices(spark, folder):
    return K.inspect_devices(
        table(spark, folder, "events").withColumn("day", F.to_date("ts")), ["user_id"], "day", "event_type"
    )


def class_counts(spark, folder):
    return K.class_counts(table(spark, folder, "embeddings"))


def crosstab(spark, folder):
    # the five market segments of the schema
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return K.crosstab(table(spark, folder, "customer"), "c_nationkey", "c_mktsegment", segments)


CROSSTAB_SQL = "SELECT c_nationkey, " + ", ".join(
    f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\""
    for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " FROM customer GROUP BY c_nationkey"


def duration_histogram(spark, folder):
    return K.histogram(table(spark, folder, "orders"), "o_totalprice", 50)


HISTOGRAM_SQL = """WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)
SELECT CASE WHEN b > a THEN least(floor((o_totalprice - a) / ((b - a) / 50)), 49) ELSE 0 END::INTEGER AS bin,
  count(*) AS clips FROM orders, e GROUP BY 1"""


def feature_health(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda v: F.when((F.col("vec_id") % 5 != 0) & ((F.col("vec_id") % 7 != 0) | (v > 0)), v)).alias("depth"),
        F.col("embedding").alias("imu"),
    )
    return K.feature_health(rows, ["depth", "imu"])


FEATURE_HEALTH_SQL = """WITH v AS (SELECT vec_id % 5 AS a, vec_id % 7 AS b, len(list_filter(embedding, lambda x: x > 0)) AS pos,
  len(embedding) AS n FROM embeddings),
k AS (SELECT n, CASE WHEN a = 0 THEN 0 WHEN b = 0 THEN pos ELSE n END AS known FROM v)
SELECT 'depth' AS block, count(*) FILTER (known = n) AS complete_rows, count(*) FILTER (known > 0 AND known < n) AS partial_rows,
  count(*) FILTER (known = 0) AS all_missing_rows FROM k
UNION ALL SELECT 'imu', count(*), 0, 0 FROM k"""

# ---------------------------------------------------------------- joins


def attach_test_index(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("clip_id"))
    # customers without money answer to another number, so their orders find nobody
    number = F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))
    customers = table(spark, folder, "customer").select(number.alias("clip_id"), "c_name")
    found, missing = K.attach_test_index(orders, customers)
    return found.unionByName(missing.withColumn("c_name", F.lit(None).cast("string")))


def mapping(spark, folder):
    """All nations; the last ones under numbers that no customer has."""
    number = F.when(F.col("n_nationkey") < 20, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + 100)
    return scan.check_mapping(table(spark, folder, "nation").select(number.alias("action_id"), F.col("n_name").alias("action_name")))


def class_mapping(spark, folder):
    nation = table(spark, folder, "nation")
    return scan.check_mapping(nation.select(F.col("n_nationkey").alias("action_id"), F.col("n_name").alias("action_name")))


def map_actions(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("clip_id"), F.col("c_nationkey").alias("action_id"))
    good, broken = K.map_actions(rows, mapping(spark, folder))
    return good.select("clip_id", "action_id", "action_name", F.lit(None).cast("string").alias("violation")).unionByName(
        broken.select("clip_id", F.lit(None).cast("int").alias("action_id"), F.lit(None).cast("string").alias("action_name"), "violation")
    )


MAP_ACTIONS_SQL = """SELECT c_custkey AS clip_id, CASE WHEN n_name IS NOT NULL THEN c_nationkey END AS action_id, n_name AS action_name,
  CASE WHEN n_name IS NULL THEN 'unknown action' END AS violation
FROM customer LEFT JOIN nation ON CASE WHEN n_nationkey < 20 THEN n_nationkey ELSE n_nationkey + 100 END = c_nationkey"""


def labeled_documents(spark, folder):
    clips = table(spark, folder, "documents").select(
        F.col("doc_id").alias("clip_id"), (F.col("n_chars") % 2).cast("int").alias("action_id"),
        F.when(F.col("lang") == "en", "test").otherwise("train").alias("split"), F.col("source").alias("user"),
    )
    predictions = table(spark, folder, "labels").select(
        F.col("doc_id").alias("clip_id"), F.col("quality").alias("action_id"),
        F.when(F.col("quality") == 1, "1_Good_text").otherwise("0_Poor_text").alias("action_name"),
    )
    return clips, predictions


DOCUMENTS = """d AS (SELECT a.doc_id AS clip_id, (n_chars % 2)::INTEGER AS action_id, CASE WHEN lang = 'en' THEN 'test' ELSE 'train' END AS split,
  source AS "user", quality AS prediction_action_id,
  CASE quality WHEN 1 THEN '1_Good_text' WHEN 0 THEN '0_Poor_text' END AS prediction_action_name,
  CASE WHEN lang <> 'en' THEN quality = n_chars % 2 END AS prediction_correct
  FROM documents a LEFT JOIN labels b USING (doc_id))"""


def add_predictions(spark, folder):
    return K.add_predictions(*labeled_documents(spark, folder))


def filter_clips(spark, folder):
    rows = add_predictions(spark, folder)
    wrong = K.filter_clips(rows, split="train", correctness="incorrect")
    right = K.filter_clips(rows, split="train", predicted=1, correctness="correct")
    test = K.filter_clips(rows, split="test", action_id=0, predicted=1)
    tag = lambda df, t: df.select("clip_id", F.lit(t).alias("choice"))
    return tag(wrong, "wrong").unionByName(tag(right, "right")).unionByName(tag(test, "test"))


FILTER_SQL = f"""WITH {DOCUMENTS}
SELECT clip_id, 'wrong' AS choice FROM d WHERE split = 'train' AND NOT prediction_correct
UNION ALL SELECT clip_id, 'right' FROM d WHERE split = 'train' AND prediction_action_id = 1 AND prediction_correct
UNION ALL SELECT clip_id, 'test' FROM d WHERE split = 'test' AND action_id = 0 AND prediction_action_id = 1"""


def correct_flag(spark, folder):
    return add_predictions(spark, folder).groupBy("split", "prediction_correct").agg(F.count(F.lit(1)).alias("clips"))


def prediction_coverage(spark, folder):
    return K.prediction_coverage(*labeled_documents(spark, folder))


def unused_predictions(spark, folder):
    """Predictions of documents under a number that no document has, beside all others."""
    clips, predictions = labeled_documents(spark, folder)
    number = F.when(F.col("clip_id") % 5 == 0, -1 - F.col("clip_id")).otherwise(F.col("clip_id"))
    return K.unused_predictions(clips, predictions.withColumn("clip_id", number)).select("clip_id", "action_id")


UNUSED_SQL = "SELECT -1 - doc_id AS clip_id, quality AS action_id FROM labels WHERE doc_id % 5 = 0"


def combine_predictions(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("clip_id"), "c_acctbal")
    both, repeats = K.combine_predictions(rows.filter("c_acctbal > 2000"), rows.filter("c_acctbal < 4000"))
    return both.groupBy("clip_id").agg(F.count(F.lit(1)).alias("rows")).join(repeats, "clip_id", "left")


COMBINE_SQL = """SELECT c_custkey AS clip_id, (c_acctbal > 2000)::INTEGER::BIGINT + (c_acctbal < 4000)::INTEGER::BIGINT AS "rows",
  CASE WHEN c_acctbal > 2000 AND c_acctbal < 4000 THEN 2::BIGINT END AS times FROM customer"""


def active_subset(spark, folder):
    canonical = OrderedGroups(
        table(spark, folder, "customer").select(F.col("c_name").alias("path"), "c_custkey"), [], ["c_custkey"], F.col("c_custkey")
    )
    active = table(spark, folder, "orders").select(
        F.format_string("Customer#%09d", "o_custkey").alias("path"), F.col("o_orderkey").alias("place")
    )
    found, missing = K.active_subset(P.numbered(canonical, "row"), active, "path", "row")
    return found.unionByName(missing).select("place", "canonical")


ACTIVE_SQL = """WITH c AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS canonical FROM customer)
SELECT o_orderkey AS place, canonical FROM orders LEFT JOIN c ON c_name = 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0')"""


def resume_labels(spark, folder):
    source = table(spark, folder, "documents").select(F.col("doc_id").alias("place"), F.col("source").alias("path"), F.lit("").alias("prediction"))
    given = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("prediction"))
    existing = table(spark, folder, "documents").join(given, "doc_id", "left").select(
        F.col("doc_id").alias("place"), F.col("source").alias("path"), F.coalesce("prediction", F.lit("")).alias("prediction")
    )
    rows, moved = K.resume_labels(source, existing, "path", "place")
    return rows.select("place", "path", "prediction")


def feature_table_stale(spark, folder):
    events = table(spark, folder, "events")
    stored = events.filter("event_type in ('purchase', 'signup')").select(F.concat(F.to_date("ts"), F.lit("/"), "user_id").alias("clip_id"))
    current = events.filter("event_type not in ('purchase', 'signup')").select(F.concat(F.to_date("ts"), F.lit("/"), "user_id").alias("clip_id"))
    return K.id_differences(stored, current).groupBy("clip_id", "side").agg(F.count(F.lit(1)).alias("times"))


STALE_SQL = """WITH s AS (SELECT ts::DATE || '/' || user_id AS clip_id FROM events WHERE event_type IN ('purchase', 'signup')),
c AS (SELECT ts::DATE || '/' || user_id AS clip_id FROM events WHERE event_type NOT IN ('purchase', 'signup')),
x AS ((SELECT clip_id, 'stored only' AS side FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM c))
  UNION ALL (SELECT clip_id, 'current only' FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM s)))
SELECT clip_id, side, count(*) AS times FROM x GROUP BY clip_id, side"""


#: Event types that stand for each block.
DEALT = {"depth": ("click", "signup"), "imu": ("view",), "skeleton": ("error", "purchase")}


def assemble_blocks(spark, folder):
    events = table(spark, folder, "events").withColumn("clip_id", F.concat_ws("/", F.to_date("ts"), "user_id"))
    block = lambda kinds, name: events.filter(F.col("event_type").isin(*kinds)).groupBy("clip_id").agg(F.avg("value").alias(name))
    rows = K.assemble_blocks({name: block(kinds, name) for name, kinds in DEALT.items()})
    return rounded(rows, ["depth", "imu", "skeleton"])


ASSEMBLE_SQL = f"""SELECT ts::DATE || '/' || user_id AS clip_id, {", ".join(named(f"avg(value) FILTER (event_type IN {k})".replace(",)", ")"), n) for n, k in DEALT.items())}
FROM events GROUP BY 1"""


def union_splits(spark, folder):
    rows = manifest(spark, folder).select("split", "clip_id", "action_id", "user")
    test = table(spark, folder, "customer").select(F.lit("test").alias("split"), F.col("c_name").alias("clip_id"))
    return K.union_splits(rows, test)


def align_timeline(spark, folder):
    rows = members(spark, folder)
    groups = OrderedGroups(rows, ["clip_id", "modality"], P.member_order(), None)
    played = groups.on(groups.df.filter(F.col("modality").isin(*PLAYER_MODALITIES)))
    shown = K.align_timeline(played, ("Depth_Color", "IR", "Skeleton"), "Thermal")
    return shown.select("clip_id", "modality", "frame", "member_path")


TIMELINE_SQL = f"""WITH {MEMBERS},
p AS (SELECT clip_id, modality, member_path, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY clip_id, modality) AS n
  FROM m WHERE modality IN ('Depth_Color', 'IR', 'Thermal', 'Skeleton')
  WINDOW w AS (PARTITION BY clip_id, modality ORDER BY coalesce("timestamp", ''), coalesce(frame_index, -1), member_path)),
f AS (SELECT clip_id, coalesce(max(n) FILTER (modality <> 'Thermal'), max(n), 1) AS frames FROM p GROUP BY clip_id),
t AS (SELECT clip_id, frames, unnest(range(frames)) AS frame FROM f)
SELECT t.clip_id, modality, frame, member_path FROM t JOIN p ON p.clip_id = t.clip_id
  AND pos = CASE WHEN frames > 1 THEN round_even((n - 1) * frame / (frames - 1)::DOUBLE, 0) ELSE 0 END"""

# ---------------------------------------------------------------- samples and walks


def evenly_sample(spark, folder):
    rows = event_series(spark, folder)
    few = P.evenly_sample(rows, 8).select("event_id", F.lit(8).alias("k"))
    one = P.evenly_sample(rows, 1, middle=True).select("event_id", F.lit(1).alias("k"))
    return few.unionByName(one)


EVENLY_SQL = """WITH r AS (SELECT event_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id, event_type) AS n
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT DISTINCT event_id, 8 AS k FROM r, (SELECT unnest(range(8)) AS i) WHERE n <= 8 OR pos = round_even(i * (n - 1) / 7.0::DOUBLE, 0)
UNION ALL SELECT event_id, 1 FROM r WHERE pos = n // 2"""


def round_robin_sample(spark, folder):
    rows = table(spark, folder, "customer")
    groups = OrderedGroups(rows, ["c_mktsegment"], [C.natural_key(F.col("c_name"))], F.col("c_custkey"))
    return P.round_robin_sample(groups, [C.natural_key(F.col("c_mktsegment"))], 37).select("c_custkey", "c_mktsegment")


ROUND_ROBIN_SQL = """WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)
SELECT c_custkey, c_mktsegment FROM r ORDER BY k, c_mktsegment LIMIT 37"""


def split_budget(spark, folder):
    sizes = {r["split"]: r["n"] for r in table(spark, folder, "customer").groupBy(
        F.when(F.col("c_nationkey") == 0, "test").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = P.split_budget({s: sizes.get(s, 0) for s in ("train", "test")}, 201)
    rows = table(spark, folder, "customer").withColumn("split", F.when(F.col("c_nationkey") == 0, "test").otherwise("train"))
    groups = OrderedGroups(rows, ["split"], ["c_custkey"], F.col("c_custkey"))
    numbered = P.numbered(groups)
    limit = F.when(F.col("split") == "train", quota["train"]).otherwise(quota["test"])
    return numbered.filter(F.col("position") < limit).select("split", "c_custkey")


SPLIT_BUDGET_SQL = """WITH r AS (SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'test' ELSE 'train' END AS split FROM customer),
s AS (SELECT count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM r),
q AS (SELECT least(a, 101) AS a0, least(b, 100) AS b0, a, b FROM s),
f AS (SELECT a0 + least(201 - a0 - b0, a - a0) AS qa, a, b, a0, b0 FROM q),
g AS (SELECT qa, b0 + least(201 - qa - b0, b - b0) AS qb FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY c_custkey) AS k FROM r)
SELECT split, c_custkey FROM n, g WHERE k <= CASE WHEN split = 'train' THEN qa ELSE qb END"""


def labeled(spark, folder):
    return table(spark, folder, "documents").select("doc_id").join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )


def initial_unlabeled(spark, folder):
    return P.initial_unlabeled(labeled(spark, folder), "doc_id", "doc_id", F.col("quality").isNotNull())


def next_unlabeled(spark, folder):
    walked = P.next_unlabeled(labeled(spark, folder), "doc_id", "doc_id", F.col("quality").isNotNull())
    return walked.select("doc_id", "next_item")


NEXT_SQL = """WITH l AS (SELECT doc_id, quality IS NULL AS open FROM documents LEFT JOIN labels USING (doc_id))
SELECT a.doc_id, coalesce((SELECT min(b.doc_id) FROM l b WHERE b.open AND b.doc_id > a.doc_id),
  (SELECT min(b.doc_id) FROM l b WHERE b.open AND b.doc_id < a.doc_id),
  (SELECT min(b.doc_id) FROM l b WHERE b.doc_id > a.doc_id), (SELECT min(b.doc_id) FROM l b)) AS next_item FROM l a"""

# ---------------------------------------------------------------- scalars and small tables


# the last four are numbers
ODD_NUMBERS = ("nan", "inf", "x1", "1d", "1.5f", "0x1p3", "", "1e999", "1__0", ".5", "-1.2e2", " 7. ", "1_000")


def safe_float(spark, folder):
    text = F.get_json_object("props", "$.k")
    odd = F.element_at(F.array(*map(F.lit, ODD_NUMBERS)), (F.col("event_id") % 23 + 1).cast("int"))
    odd = F.when(F.col("event_id") % 23 < len(ODD_NUMBERS), odd)
    return table(spark, folder, "events").select("event_id", C.safe_float(F.coalesce(odd, text)).alias("number"))


SAFE_FLOAT_SQL = """SELECT event_id, CASE event_id % 23 WHEN 9 THEN 0.5 WHEN 10 THEN -120.0 WHEN 11 THEN 7.0 WHEN 12 THEN 1000.0 ELSE
  CASE WHEN event_id % 23 > 12 THEN regexp_extract(props, '(\\d+)', 1)::DOUBLE END END AS number FROM events"""


# the last three name a moment: a date, an hour with an offset, a fraction after a comma
ODD_TIMES = ("soon", "2024", "2024-05", "1500", "12:34:56", "T12:00:00", "", "2024-13-01",
             "2024-05-01", "2024-05-01T11+02:00", " 2024-05-01 09:00:00,25Z ")


def parse_time(spark, folder):
    odd = F.element_at(F.array(*map(F.lit, ODD_TIMES)), (F.col("event_id") % 19 + 1).cast("int"))
    text = F.when(F.col("event_id") % 19 < len(ODD_TIMES), odd).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return table(spark, folder, "events").select("event_id", F.round(C.parse_time(text, F.col("event_id")), 3).alias("seconds"))


PARSE_TIME_SQL = """SELECT event_id, CASE event_id % 19 WHEN 8 THEN 1714521600 WHEN 9 THEN 1714554000 WHEN 10 THEN 1714554000.25
  ELSE CASE WHEN event_id % 19 < 8 THEN event_id ELSE (epoch_us(ts) // 1000) / 1000.0 END END::DOUBLE AS seconds FROM events"""


def natural_key(spark, folder):
    names = table(spark, folder, "supplier").select(
        F.concat(F.lit("Unit"), F.col("s_suppkey").cast("string"), F.lit("b"), F.col("s_nationkey").cast("string")).alias("name"),
        "s_suppkey",
    )
    groups = OrderedGroups(names, [], [C.natural_key(F.col("name"))], None)
    return P.numbered(groups).select("name", "position")


NATURAL_SQL = """SELECT 'Unit' || s_suppkey || 'b' || s_nationkey AS name, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier"""


def pretty_label(spark, folder):
    name = F.when(F.col("p_size") % 10 == 0, None).otherwise(F.concat_ws("_", "p_size", F.translate("p_name", " ", "_")))
    return table(spark, folder, "part").select(
        "p_partkey", C.pretty_label(name).alias("label"), C.prediction_label(F.col("p_size"), name).alias("choice"),
        C.label_from_action(name).alias("action_id"),
    )


PRETTY_SQL = """WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 10 = 0 THEN 'Unknown' ELSE p_name END AS n FROM part)
SELECT p_partkey, n AS label, CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size || ' · ' || n AS choice,
  CASE WHEN p_size % 10 <> 0 THEN p_size END AS action_id FROM p"""


def path_tail(spark, folder):
    url = F.concat(F.translate("url", "/", "\\"), F.when(F.col("page_id") % 2 == 0, "/").otherwise(""))
    return table(spark, folder, "pages").select("page_id", C.path_tail(url).alias("clip_id"))


PATH_TAIL_SQL = """SELECT page_id, nullif(regexp_extract(regexp_replace(trim(url), '/+$', ''), '([^/]*)$', 1), '') AS clip_id FROM pages"""


def test_index(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.concat(F.lit("./data/"), F.format_string("SM_test_%07d", "o_orderkey"), F.lit("/")).alias("path"), F.col("o_orderkey").alias("place")
    )
    return scan.test_index(rows)


def text_flags(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", " TRUE").when(F.col("l_returnflag") == "R", "false").alias("returned"), "l_linestatus"
    )
    return scan.normalize_flags(rows).groupBy("returned", "l_linestatus").agg(F.count(F.lit(1)).alias("rows"))


TEXT_FLAGS_SQL = """SELECT CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS returned, l_linestatus, count(*) AS "rows"
FROM lineitem GROUP BY 1, 2"""


def predictions_table(spark, folder):
    """Prediction rows as text with blanks, decimals, unknown ids and repeated clips."""
    key = F.col("o_orderkey")
    given = (
        F.when(key % 13 == 0, " ").when(key % 17 == 0, "34.0").when(key % 19 == 0, "99")
        .otherwise((key % 25).cast("string"))
    )
    return table(spark, folder, "orders").select(
        F.concat(F.lit("data\\clip"), F.floor(key / F.when(key % 100 < 2, 2).otherwise(1)).cast("string"), F.lit("/")).alias("path"),
        given.alias("prediction"),
    )


def check_predictions(spark, folder):
    good, counters, broken = scan.check_predictions(predictions_table(spark, folder), class_mapping(spark, folder))
    text = lambda c: F.col(c).cast("string")
    return (
        good.select("clip_id", text("action_id").alias("value"), F.lit("good").alias("kind"))
        .unionByName(broken.select("clip_id", F.col("violation").alias("value"), F.lit("broken").alias("kind")))
        .unionByName(counters.select(F.lit("all").alias("clip_id"), F.concat_ws("/", "rows_read", "blank_predictions").alias("value"), F.lit("counters").alias("kind")))
    )


CHECK_PREDICTIONS_SQL = """WITH p AS (SELECT 'clip' || (CASE WHEN o_orderkey % 100 < 2 THEN o_orderkey // 2 ELSE o_orderkey END) AS clip_id,
  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN '34.0' WHEN o_orderkey % 19 = 0 THEN '99'
    ELSE (o_orderkey % 25)::VARCHAR END AS given FROM orders)
SELECT clip_id, given AS value, 'good' AS kind FROM p WHERE given NOT IN ('', '34.0', '99')
UNION ALL SELECT clip_id, CASE given WHEN '34.0' THEN 'not an integer' ELSE 'unknown action' END, 'broken' FROM p WHERE given IN ('34.0', '99')
UNION ALL SELECT clip_id, 'duplicate clip', 'broken' FROM p WHERE given <> '' GROUP BY clip_id HAVING count(*) > 1
UNION ALL SELECT 'all', count(*) || '/' || count(*) FILTER (given = ''), 'counters' FROM p"""


def radar_frames(spark, folder):
    points = table(spark, folder, "events").select(
        F.col("user_id").alias("path"), F.date_format("ts", "yyyyMMdd").cast("int").alias("frame"), F.col("event_id").alias("line"),
        F.col("value").alias("x"), (F.col("value") * 2).alias("y"), (F.col("value") * 3).alias("z"),
        F.col("value").alias("velocity"), F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("snr"),
    )
    return rounded(scan.radar_frames(points), ["y", "z"])


RADAR_SQL = f"""SELECT user_id AS path, strftime(ts, '%Y%m%d')::INTEGER AS frame,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY event_id) - 1 AS point,
  value AS x, {r('value * 2')} AS y, {r('value * 3')} AS z, value AS velocity,
  coalesce(regexp_extract(props, '(\\d+)', 1)::DOUBLE, 0) AS snr FROM events"""


QUERIES = {f.__name__: f for f in (
    parse_members, drop_ignored, build_manifest, issue_string, timestamps_aligned, overview_kpis, modality_coverage,
    file_count_box, modality_combinations, quality_kpis, issue_counts, flagged_clips, content_quality, member_index,
    member_order, manifest_order, complete_case, discovery_funnel, modality_keys, has_all, inspect_devices, class_counts,
    crosstab, duration_histogram, feature_health, attach_test_index, class_mapping, map_actions, add_predictions,
    filter_clips, correct_flag, prediction_coverage, unused_predictions, combine_predictions, active_subset, resume_labels,
    feature_table_stale, assemble_blocks, union_splits, align_timeline, evenly_sample, round_robin_sample, split_budget,
    initial_unlabeled, next_unlabeled, safe_float, parse_time, natural_key, pretty_label, path_tail, test_index,
    text_flags, check_predictions, radar_frames,
)}

ORACLES = {
    "parse_members": f"WITH {MEMBERS} SELECT * FROM m",
    "drop_ignored": DROP_IGNORED_SQL,
    "build_manifest": f"WITH {MANIFEST} SELECT * FROM manifest",
    "issue_string": f"WITH {MANIFEST} SELECT issues, count(*) AS clips FROM manifest GROUP BY issues",
    "timestamps_aligned": f"WITH {MANIFEST} SELECT depth_ir_aligned, depth_skeleton_aligned, count(*) AS clips FROM manifest GROUP BY 1, 2",
    "overview_kpis": OVERVIEW_SQL,
    "modality_coverage": COVERAGE_SQL,
    "file_count_box": FILE_COUNT_SQL,
    "modality_combinations": COMBINATIONS_SQL,
    "quality_kpis": QUALITY_SQL,
    "issue_counts": "SELECT issue, count(*) AS clips FROM (SELECT unnest(string_split(text, ' ')) AS issue FROM documents) WHERE issue <> '' GROUP BY issue",
    "flagged_clips": f"WITH {MANIFEST} SELECT clip_id, modality_count, issues FROM manifest WHERE issues <> ''",
    "content_quality": CONTENT_SQL,
    "member_index": MEMBER_INDEX_SQL,
    "member_order": MEMBER_ORDER_SQL,
    "manifest_order": MANIFEST_ORDER_SQL,
    "complete_case": f"WITH {FLAGS} SELECT 'train' AS split, clip AS clip_id, action_id AS label, \"user\" FROM k WHERE nonempty AND devices",
    "discovery_funnel": f"WITH {FLAGS} SELECT count(*) AS logical_clips, count(*) FILTER (modality_complete) AS modality_complete, count(*) FILTER (nonempty) AS nonempty_imu_files, count(*) FILTER (nonempty AND devices) AS all_imu_devices FROM k",
    "modality_keys": MODALITY_KEYS_SQL,
    "has_all": "SELECT user_id, ts::DATE AS day FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 5",
    "inspect_devices": "SELECT user_id, count(DISTINCT event_type) AS devices, count(*) AS row_count, count(DISTINCT ts::DATE) AS nonempty_files FROM events GROUP BY user_id",
    "class_counts": "SELECT label, count(*) AS clips FROM embeddings GROUP BY label",
    "crosstab": CROSSTAB_SQL,
    "duration_histogram": HISTOGRAM_SQL,
    "feature_health": FEATURE_HEALTH_SQL,
    "attach_test_index": "SELECT o_custkey AS clip_id, o_orderkey AS place, c_name FROM orders LEFT JOIN customer ON CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END = o_custkey",
    "class_mapping": "SELECT n_nationkey AS action_id, n_name AS action_name FROM nation",
    "map_actions": MAP_ACTIONS_SQL,
    "add_predictions": f"WITH {DOCUMENTS} SELECT * FROM d",
    "filter_clips": FILTER_SQL,
    "correct_flag": f"WITH {DOCUMENTS} SELECT split, prediction_correct, count(*) AS clips FROM d GROUP BY 1, 2",
    "unused_predictions": UNUSED_SQL,
    "prediction_coverage": f"WITH {DOCUMENTS} SELECT split, count(*) AS matched FROM d WHERE prediction_action_id IS NOT NULL GROUP BY split",
    "combine_predictions": f"SELECT * FROM ({COMBINE_SQL}) WHERE \"rows\" > 0",
    "active_subset": ACTIVE_SQL,
    "resume_labels": "SELECT doc_id AS place, source AS path, coalesce(quality::VARCHAR, '') AS prediction FROM documents LEFT JOIN labels USING (doc_id)",
    "feature_table_stale": STALE_SQL,
    "assemble_blocks": ASSEMBLE_SQL,
    "union_splits": f"WITH {MANIFEST} SELECT split, clip_id, action_id, \"user\" FROM manifest UNION ALL SELECT 'test', c_name, NULL, NULL FROM customer",
    "align_timeline": TIMELINE_SQL,
    "evenly_sample": EVENLY_SQL,
    "round_robin_sample": ROUND_ROBIN_SQL,
    "split_budget": SPLIT_BUDGET_SQL,
    "initial_unlabeled": "SELECT coalesce(min(doc_id) FILTER (quality IS NULL), min(doc_id)) AS doc_id FROM documents LEFT JOIN labels USING (doc_id)",
    "next_unlabeled": NEXT_SQL,
    "safe_float": SAFE_FLOAT_SQL,
    "parse_time": PARSE_TIME_SQL,
    "natural_key": NATURAL_SQL,
    "pretty_label": PRETTY_SQL,
    "path_tail": PATH_TAIL_SQL,
    "test_index": "SELECT './data/SM_test_' || lpad(o_orderkey::VARCHAR, 7, '0') || '/' AS path, o_orderkey AS place, 'SM_test_' || lpad(o_orderkey::VARCHAR, 7, '0') AS clip_id FROM orders",
    "text_flags": TEXT_FLAGS_SQL,
    "check_predictions": CHECK_PREDICTIONS_SQL,
    "radar_frames": RADAR_SQL,
}
