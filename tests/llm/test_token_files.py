import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sensorframe.llm import token_files
from sensorframe.llm.catalog import byte_vocabulary
from sensorframe.llm.session import ready, shared_folder

ODD = ["", None, " ", "\n", "a", "a  b", "a \n b\t\tc ", "don't we'll 'tis", "x<|endoftext|>y <|endoftext|> z", "é è  ü  　 ß", "日本 語  x",
       "naïve  café\r\n\r\nend  ", "👍 👍🏽  ok", "1 23  456\x1c 7\x85 8", "aa" * 500, " lead", "trail ", "à b"]


def wanted(text):
    return token_files._tokenizer(byte_vocabulary()).encode(text or "", add_special_tokens=False).ids + [0]


def cases():
    rng = random.Random(3)
    letters = ["a", "b", "é", "ß", " ", " ", "\n", "\t", ".", "'", "s", "1", " ", " ", "日", "👍", "́", "\u0085", "<|endoftext|>"]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]


def test_pieces_encode_like_whole_texts():
    texts = cases()
    ids, starts = token_files.encoded(pa.array(texts), byte_vocabulary())
    for text, a, b in zip(texts, starts[:-1], starts[1:]):
        assert ids[a:b].tolist() == wanted(text), repr(text)


def test_other_vocabularies_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = cases()[:400]
    ids, starts = token_files.encoded(pa.array(texts), path, None)
    tokenizer = token_files._tokenizer(path)
    for text, a, b in zip(texts, starts[:-1], starts[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_sliced_and_empty_arrays():
    texts = pa.array(ODD).slice(3, 5)
    ids, starts = token_files.encoded(texts, byte_vocabulary())
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [wanted(t) for t in ODD[3:8]]
    ids, starts = token_files.encoded(pa.array([], pa.string()), byte_vocabulary())
    assert len(ids) == 0 and starts.tolist() == [0]


@pytest.mark.parametrize("rows", [0, 1, 300])
def test_round_trip(spark, rows):
    ready(spark)
    texts = cases()
    data = [(None if i == 7 else i // 2 * 3, texts[i], i, "x") for i in range(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_tokens int, ids string").repartition(5)
    root = f"{shared_folder(spark)}/round-{rows}"
    token_files.write_tokens(docs, root, byte_vocabulary())
    got = sorted(token_files.read_tokens(spark, root, with_ids=True).collect(), key=lambda r: r.start)
    assert len(got) == rows
    place = 0
    for row in got:
        assert row.start == place and row.n_tokens == len(row.ids)
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        place += row.n_tokens
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((d[0], wanted(d[1])) for d in data), key=key)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda v: (v is not None, v or 0))
    assert got == sorted(token_files.token_table(docs, byte_vocabulary()).join(
        spark.createDataFrame([(r.start, r.ids) for r in got], "start long, ids array<long>"), "start").select(got[0].__fields__ if got else "*").collect(),
        key=lambda r: r.start)
