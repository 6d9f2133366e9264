"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm import (
    collocations,
    hard_negatives,
    line_runs,
    mixing,
    near_copies,
    norm_search,
    phrase_index,
    quality,
    repetition,
    suffix_tree,
    token_files,
    toxicity,
    url_lists,
)
from sensorframe.llm.learning import fold_of
from sensorframe.llm.session import ready


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_repetition(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return repetition.repetition(_table(spark, folder, "documents")).drop("longest_repeat", "spans")


# the longest repeat is over the limit where a window one word longer than the limit is found twice
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w),
windows AS (SELECT doc_id, i, words[i:i + 7] AS piece FROM places),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, piece) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
far AS (SELECT doc_id, words, unnest(range(1, len(words) - {repetition.MAX_LONGEST - 1})) AS i FROM w),
long_ones AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, md5(array_to_string(words[i:i + {repetition.MAX_LONGEST}], ' ')) AS piece FROM far)
              GROUP BY doc_id, piece HAVING count(*) > 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         long_ones.doc_id IS NOT NULL AS too_long
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN long_ones USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.BASE_COVERED} * n_words AS base_failed,
       NOT (n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.BASE_COVERED} * n_words)
       AND 100 * n_repeat_words <= {repetition.MAX_COVERED} * n_words AND NOT too_long AS kept
FROM f
"""

def op3_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return near_copies.near_copies(_table(spark, folder, "documents"))


OP3_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (SELECT DISTINCT doc_id, words[i:i + 4] AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_.n >= 85 * (p.n + q.n - both_.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.x = d.doc_id
"""


def byte_vocabulary() -> str:
    """The production vocabulary's place; any other file can be passed to the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return token_files.token_table(_table(spark, folder, "documents"), byte_vocabulary())


def _days(text: F.Column, modulus: int) -> F.Column:
    """A number below modulus from the text's md5, which other engines have as well."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long") % modulus


def list_log(pages: DataFrame) -> DataFrame:
    """A log of list changes derived from the hosts and first path parts of the pages.

    Half of all patterns enter a list on a day of 2024; most leave it again and some return.
    """
    first = F.split(url_lists.path_of(F.col("url")), "/+")[0]
    host = url_lists.host_of(F.col("url"))
    patterns = pages.select(F.explode(F.array(
        host, F.regexp_replace(host, r"^[^.]*\.", ""), F.when(first != "", F.concat_ws("/", host, first)))).alias("pattern"))
    patterns = patterns.filter("pattern is not null and pattern != ''").distinct()
    chosen = patterns.filter(_days(F.concat(F.lit("in"), "pattern"), 2) == 0).withColumn("start", _days(F.concat(F.lit("at"), "pattern"), 366))
    name = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (_days(F.concat(F.lit("list"), "pattern"), 3) + 1).cast("int"))
    stays = 20 + _days(F.concat(F.lit("for"), "pattern"), 200)
    again = stays + 10 + _days(F.concat(F.lit("back"), "pattern"), 100)
    steps = F.array(F.struct(F.lit(0).cast("long").alias("plus"), F.lit(True).alias("added")), F.struct(stays.alias("plus"), F.lit(False).alias("added")),
                    F.struct(again.alias("plus"), (_days(F.concat(F.lit("again"), "pattern"), 3) == 0).alias("added")))
    return chosen.select("pattern", name.alias("list"), "start", F.explode(steps).alias("step")).select(
        "list", "pattern", F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("start") + F.col("step.plus")).cast("int"))).alias("time"), "step.added")


def op5_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), _days(F.concat(F.lit("fetched"), "url"), 500).cast("int"))
    found = url_lists.evaluate(pages.withColumn("fetched", F.to_timestamp(fetched)), list_log(pages))
    return found.select(
        "page_id", F.date_from_unix_date(F.col("day").cast("int")).alias("fetched"), F.size("entries").cast("long").alias("n_entries"),
        F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["list"], e["pattern"])), ",").alias("entries"), (F.size("entries") > 0).alias("blocked"))


OP5_SQL = r"""
WITH p AS (SELECT page_id, trim(url) AS url FROM pages),
cut AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority,
               regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '^/+|/+$', '', 'g') AS path FROM p),
h AS (SELECT page_id, url, path, regexp_replace(regexp_replace(regexp_replace(lower(authority), '^.*@', ''), '\.?(:[0-9]*)?$', ''), '^www\.', '') AS host FROM cut),
parts AS (SELECT *, string_split(host, '.') AS labels, regexp_split_to_array(path, '/+') AS steps FROM h WHERE host <> ''),
log_patterns AS (
  SELECT DISTINCT pattern FROM (
    SELECT unnest([host, regexp_replace(host, '^[^.]*\.', ''), CASE WHEN steps[1] <> '' THEN host || '/' || steps[1] END]) AS pattern FROM parts)
  WHERE pattern IS NOT NULL AND pattern <> ''),
drawn AS (
  SELECT pattern, ('0x' || substr(md5('in' || pattern), 1, 6))::BIGINT % 2 AS c_in, ('0x' || substr(md5('at' || pattern), 1, 6))::BIGINT % 366 AS start,
         ['adult', 'malware', 'spam'][('0x' || substr(md5('list' || pattern), 1, 6))::BIGINT % 3 + 1] AS list,
         20 + ('0x' || substr(md5('for' || pattern), 1, 6))::BIGINT % 200 AS stays,
         10 + ('0x' || substr(md5('back' || pattern), 1, 6))::BIGINT % 100 AS pause, ('0x' || substr(md5('again' || pattern), 1, 6))::BIGINT % 3 AS again
  FROM log_patterns),
valid AS (
  SELECT list, pattern, start AS a, start + stays AS b FROM drawn WHERE c_in = 0
  UNION ALL SELECT list, pattern, start + stays + pause, 1000000 FROM drawn WHERE c_in = 0 AND again = 0),
keys AS (
  SELECT page_id, array_to_string(labels[i:], '.') AS pattern FROM (SELECT page_id, labels, unnest(range(1, len(labels) + 1)) AS i FROM parts)
  UNION SELECT page_id, host || '/' || array_to_string(steps[:i], '/') FROM (SELECT page_id, host, steps, unnest(range(1, len(steps) + 1)) AS i FROM parts WHERE path <> '')),
taken_at AS (SELECT page_id, ('0x' || substr(md5('fetched' || pages.url), 1, 6))::BIGINT % 500 AS day FROM pages),
hit AS (SELECT page_id, list, pattern, a FROM keys JOIN taken_at USING (page_id) JOIN valid USING (pattern) WHERE a <= day AND day < b),
per AS (SELECT page_id, count(*) AS n, string_agg(list || ':' || pattern, ',' ORDER BY list, pattern, a) AS entries FROM hit GROUP BY page_id)
SELECT page_id, DATE '2024-01-01' + day::INT AS fetched, coalesce(n, 0)::BIGINT AS n_entries, coalesce(entries, '') AS entries, coalesce(n, 0) > 0 AS blocked
FROM taken_at LEFT JOIN per USING (page_id)
"""


def op7_phrase_index(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    found = phrase_index.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(len(words), 10) AS k FROM b WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, k, words[i:i + k - 1] AS piece FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT k FROM windows),
spots AS (SELECT doc_id, k, words[i:i + k - 1] AS piece, i FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, lengths)),
hits AS (SELECT doc_id, item_id, i, k FROM spots JOIN windows USING (k, piece)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mixed_rows(_table(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    docs = _table(spark, folder, "documents")
    return _judged(toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, folder, "labels"))), 0.5)


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    docs = _table(spark, folder, "documents")
    return _judged(quality.quality(docs, quality.fit(docs, _table(spark, folder, "labels"))), 0.3)


def op6_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    found = suffix_tree.suffix_tree_scores(_table(spark, folder, "documents"))
    return found.select("doc_id", (F.col("fold") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = line_runs.without_repeated_runs(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", F.md5("text").alias("text_md5"))


# a line of more than 50 words is a run by itself, so that a passage on one line is deleted like one on several
OP9_SQL = """
WITH all_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM documents),
lines AS (SELECT doc_id, nr, line, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS i FROM all_lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
pairs AS (SELECT a.doc_id, a.i, a.line AS one, b.line AS two FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
copies AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY one, two ORDER BY doc_id, i) AS k FROM pairs) WHERE k > 1),
alone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM lines
          WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 50) WHERE k > 1),
gone AS (SELECT doc_id, unnest([i, i + 1]) AS i FROM copies UNION SELECT doc_id, i FROM alone),
gone_lines AS (SELECT doc_id, nr FROM gone JOIN lines USING (doc_id, i)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY nr) AS text FROM all_lines ANTI JOIN gone_lines USING (doc_id, nr) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone_lines GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_deleted, md5(CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END) AS text_md5
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return collocations.collocations(_table(spark, folder, "documents"))


OP11_SQL = """
WITH pieces AS (SELECT row_number() OVER () AS p, lang, piece FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, p, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM (SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces)),
g AS (SELECT lang, w1, lead(w1) OVER (PARTITION BY p ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY p ORDER BY i) AS w3 FROM w),
one AS (SELECT lang, w1, count(*) AS n FROM g GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS n FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM one GROUP BY lang),
inside AS (SELECT lang, w1, w2, max(n) AS n FROM (SELECT lang, w1, w2, n FROM three UNION ALL SELECT lang, w2, w3, n FROM three) GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.n AS a, 1 AS k, x.n AS l, y.n AS r FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1
  JOIN one y ON y.lang = t.lang AND y.w1 = t.w2 LEFT JOIN inside i ON i.lang = t.lang AND i.w1 = t.w1 AND i.w2 = t.w2 WHERE i.n IS NULL OR 100 * i.n < 50 * t.n
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.n, 1, x.n, y.n FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1
  JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.n, 2, x.n, y.n FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
  JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT lang, phrase, a, k, l, r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op12_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return norm_search.top_products(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


# vectors as unrolled numbers: a vector takes part if no component is null, NaN or infinite
OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


QUERIES = {
    "op1_repetition": op1_repetition,
    "op2_toxicity": op2_toxicity,
    "op3_near_copies": op3_near_copies,
    "op4_token_files": op4_token_files,
    "op5_url_lists": op5_url_lists,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_phrase_index": op7_phrase_index,
    "op8_mixing": op8_mixing,
    "op9_line_runs": op9_line_runs,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_norm_buckets": op12_norm_buckets,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {"op1_repetition": OP1_SQL, "op3_near_copies": OP3_SQL, "op5_url_lists": OP5_SQL, "op7_phrase_index": OP7_SQL, "op9_line_runs": OP9_SQL,
           "op11_collocations": OP11_SQL, "op12_norm_buckets": OP12_SQL, "op13_hard_negatives": OP13_SQL}
