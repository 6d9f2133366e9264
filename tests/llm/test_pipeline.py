import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from sensorframe.llm import mixing, near_copies, repetition, token_files
from sensorframe.llm.catalog import byte_vocabulary
from sensorframe.llm.session import ready

import sys, os  # noqa: E401

sys.path.insert(0, os.path.dirname(__file__))
from test_near_copies import brute as same_groups  # noqa: E402
from test_phrase_index import brute as passages  # noqa: E402
from test_repetition import brute as repeats  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_against_plain_python(spark):
    ready(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = []
    for r in docs.itertuples():
        words = (r.text or "").encode().split()
        if len(words) > 3000:  # the plain restatement of the longest repeat is cubic
            found = next(iter(repetition.repetition(spark.createDataFrame([(r.doc_id, r.text)], "doc_id long, text string")).collect()))
            covered, longest = range(found.n_repeat_words), found.longest_repeat
        else:
            covered, longest = repeats(words, 8)
        if len(words) >= 20 and 100 * len(covered) <= 20 * len(words) and longest <= repetition.MAX_LONGEST:
            rows.append((r.doc_id, r.text, r.source))
    component = same_groups(rows, 80)
    rows = [r for r in rows if component[r[0]] == r[0]]
    rows = [r for r in rows if not passages(r[1], items, 10)[1]]
    left = spark.createDataFrame(docs).join(spark.createDataFrame([(r[0],) for r in rows], "doc_id long"), "doc_id", "left_semi").select(*docs.columns)
    copies = {x.doc_id: x.copies for x in mixing.mixed_rows(left).collect()}
    assert set(copies) == {r[0] for r in rows} and 0 < len(rows) < len(docs)
    found = sorted(corpus_pipeline.run(spark, FOLDER).collect(), key=lambda x: x.start)
    assert Counter(x.doc_id for x in found) == +Counter(copies)
    tokenizer, place, texts = token_files._tokenizer(byte_vocabulary()), 0, {r[0]: r[1] for r in rows}
    for x in found:
        ids = tokenizer.encode(texts[x.doc_id], add_special_tokens=False).ids + [0]
        assert (x.start, x.n_tokens, x.ids_crc32) == (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)


def test_stages(spark, table, odd, tmp_path):
    docs = table(odd)
    spark.createDataFrame([(1, "some text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copy_removal", "decontamination", "source_mixing", "token_output"]
    assert near_copies.PERCENT == 85 and corpus_pipeline.SIMILARITY == 80
