"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by id; each task encodes its partition and writes three
files: ``.bin`` the ids of all its documents one behind the other (unsigned 16 bit where the
vocabulary allows it, else 32), ``.idx`` unsigned 64-bit offsets of its documents in that file and its
end, ``.doc`` the signed 64-bit document ids. The manifest, a small table with one row a partition,
gives each file's place in the whole: its first token and first document are prefix sums of the counts
of the partitions before it. Global offset = base + offset in the file.

File names carry a number drawn by the attempt, and only the attempt whose row reaches the manifest
counts, so retried and speculative tasks cannot mix.

The byte-level vocabulary never merges over the border between a character and white space behind it,
so texts are cut there and only the distinct pieces of a batch are encoded.

Results for odd input: a null or empty text is the end token alone; equal ids are ordered by a hash of
their text and each gets its own entry; a null id is stored as the smallest 64-bit number and read back
as null; an empty table gives an empty manifest; further columns are passed over.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorframe.llm.session import shared_folder
from sensorframe.llm.words import chunks, plain_strings, text_bytes

END_ID = 0
NO_ID = -(1 << 63)
ENCODE_AT_ONCE = 256
ENCODE_BYTES = 1 << 15
PIECE_BYTES = 24 << 20  # more text at once has fewer distinct pieces for its size
MANIFEST = "part int, file string, first_id long, n_docs long, n_tokens long, width int"
_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _solid_before(data: np.ndarray) -> np.ndarray:
    """For each byte place and the end: is the character before surely no white space?

    Surely none are printable ASCII and the two-byte characters from U+00C0 on.
    """
    before, lead = np.zeros(len(data) + 1, np.uint8), np.zeros(len(data) + 1, np.uint8)
    before[1:], lead[2:] = data, data[:-1]
    return ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead < 0xE0))


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin: at documents, and at a space or line end behind a character that is surely no space."""
    cut = ((data == 0x20) | (data == 0x0A)) & _solid_before(data)[:-1]
    cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def _taken(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] for all i, one behind the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _bytewise(path: str) -> bool:
    """Does the vocabulary write each byte as a character, without changing texts before?"""
    key = f"{path} bytewise"
    if key not in _TOKENIZERS:
        says = json.loads(_tokenizer(path).to_str())
        split = says["pre_tokenizer"] or {}
        _TOKENIZERS[key] = says["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    return _TOKENIZERS[key]


def _byte_lengths(path: str) -> np.ndarray:
    """Bytes that each id stands for; the vocabulary writes one character for a byte."""
    key = f"{path} bytes"
    if key not in _TOKENIZERS:
        tokenizer = _tokenizer(path)
        special = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
        vocabulary = tokenizer.get_vocab()
        lengths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        for token, i in vocabulary.items():
            lengths[i] = special.get(i, len(token))
        _TOKENIZERS[key] = lengths
    return _TOKENIZERS[key]


def _piece_ids(path: str, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all pieces, and where each piece's begin and how many they are.

    Pieces that begin with white space and end solid are encoded joined, as the joints are again borders
    that no token crosses; the ids' byte lengths tell where each piece ends. The few others go one by one.
    """
    tokenizer = _tokenizer(path)
    bounds, raw = text_bytes(pieces)
    data = np.frombuffer(raw, np.uint8)
    sizes = np.diff(bounds)
    joined = np.isin(data[bounds[:-1]], (0x20, 0x0A)) & _solid_before(data)[bounds[1:]]
    own = sizes[joined]
    ends = np.cumsum(own)
    text = data[np.repeat(joined, sizes)].tobytes()
    cuts = np.unique(ends[np.searchsorted(ends, np.arange(ENCODE_BYTES, len(text), ENCODE_BYTES))]) if len(own) else own
    cuts = [0, *cuts.tolist(), *([len(text)] if len(own) and (not len(cuts) or cuts[-1] < len(text)) else [])]
    flat = _ids(tokenizer, [text[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])])[0]
    reached = np.concatenate([[0], np.cumsum(_byte_lengths(path)[flat])])
    at = np.searchsorted(reached, np.concatenate([[0], ends]))
    if not np.array_equal(reached[at[1:]], ends):
        raise ValueError("the ids' bytes do not add up to the pieces")
    begins, lengths = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    begins[joined], lengths[joined] = at[:-1], np.diff(at)
    rest, many = _ids(tokenizer, pieces.filter(pa.array(~joined)).to_pylist())
    begins[~joined], lengths[~joined] = len(flat) + np.cumsum(many) - many, many
    return np.concatenate([flat, rest]), begins, lengths


def _ids(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found, sizes = [np.zeros(0, np.uint32)], []
    for at in range(0, len(texts), ENCODE_AT_ONCE):
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts[at : at + ENCODE_AT_ONCE], add_special_tokens=False)]
        sizes += map(len, ids)
        found.append(np.array(list(chain.from_iterable(ids)), np.uint32))
    return np.concatenate(found), np.array(sizes, np.int64)


def encoded(texts: pa.Array, path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by the end token, and where each text begins (and the last ends)."""
    texts = plain_strings(texts)
    bounds, raw = text_bytes(texts)
    data = np.frombuffer(raw, np.uint8)
    # other kinds of vocabulary get whole texts
    cuts = _cuts(data, bounds) if _bytewise(path) else np.unique(bounds[:-1][np.diff(bounds) > 0])
    pieces = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(raw))
    coded = pieces.dictionary_encode()
    codes = np.asarray(coded.indices)
    if _bytewise(path):
        flat, begins, lengths = _piece_ids(path, coded.dictionary)
    else:
        flat, lengths = _ids(_tokenizer(path), coded.dictionary.to_pylist())
        begins = np.cumsum(lengths) - lengths
    ids = _taken(flat, begins[codes], lengths[codes])
    # tokens before each text, then one more place per text for its end
    so_far = np.concatenate([[0], np.cumsum(lengths[codes])])
    starts = so_far[np.searchsorted(cuts, bounds)]
    if end_id is None:
        return ids, starts
    return np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))


def _files(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def write_tokens(docs: DataFrame, root: str, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
                 end_id: int = END_ID) -> DataFrame:
    """Write the files below ``root`` and return the manifest with its prefix sums."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind = np.dtype("<u2" if _tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4")
        store, folder = _files(root)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        first, n_docs, n_tokens = None, 0, 0
        with (store.open_output_stream(f"{folder}/{name}.bin") as tokens, store.open_output_stream(f"{folder}/{name}.idx") as offsets,
              store.open_output_stream(f"{folder}/{name}.doc") as names):
            for piece in chunks(batches, "text", PIECE_BYTES):
                ids, starts = encoded(piece.column("text"), tokenizer_path, end_id)
                doc_ids = piece.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
                first = int(doc_ids[0]) if first is None else first
                tokens.write(ids.astype(kind).tobytes())
                offsets.write((starts[:-1] + n_tokens).astype("<u8").tobytes())
                names.write(doc_ids.tobytes())
                n_docs, n_tokens = n_docs + len(doc_ids), n_tokens + len(ids)
            offsets.write(np.array([n_tokens], "<u8").tobytes())
        if n_docs:
            row = [part, name, first, n_docs, n_tokens, kind.itemsize]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in MANIFEST.split(", ")])

    rows = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("text"))
    placed = rows.withColumn("_tie", F.xxhash64("text"))
    placed = placed.repartitionByRange("id", "_tie").sortWithinPartitions("id", "_tie").select("id", "text")
    store, folder = _files(root)
    store.create_dir(folder, recursive=True)
    placed.mapInArrow(write, MANIFEST).write.parquet(f"{root}/parts")
    # one row a partition, so the running sums are over the partitions and not over documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.schema(MANIFEST).parquet(f"{root}/parts")
    parts.select(
        "*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"),
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"),
    ).write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def _array(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped where the store is local, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_tokens(spark: SparkSession, root: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: id, first token's place in the whole, tokens, checksum and, if asked for, the ids."""
    manifest = spark.read.parquet(f"{root}/manifest")
    files = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _files(root)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{folder}/{row['file']}"
                tokens = _array(store, f"{path}.bin", f"<u{row['width']}")
                offsets = _array(store, f"{path}.idx", "<u8").astype(np.int64)
                names = _array(store, f"{path}.doc", "<i8")
                for at in range(0, len(names), 1024):
                    edges = offsets[at : at + 1025]
                    parts = [tokens[a:b].astype("<u4") for a, b in zip(edges[:-1], edges[1:])]
                    own = np.asarray(names[at : at + 1024])
                    out = [
                        pa.array(own, mask=own == NO_ID), pa.array(edges[:-1] + row["token_base"]), pa.array(np.diff(edges)),
                        pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                    ]
                    if with_ids:
                        out.append(pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return manifest.select("file", "width", "token_base").repartition(max(1, files)).mapInArrow(read, schema)


def token_table(docs: DataFrame, tokenizer_path: str, root: str | None = None, **columns: str) -> DataFrame:
    """Write the files, below the shared folder unless told otherwise, and read them back."""
    spark = docs.sparkSession
    root = root or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, root, tokenizer_path, **columns)
    return read_tokens(spark, root)
