"""From documents to token files: quality rules, near-copy removal, decontamination, mixing, token output.

Every stage takes all rows that its predecessor kept and is written as Parquet and reread before the next.
Copies that the mix takes twice are rows of their own, and the token files hold them twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sensorframe.llm import catalog, mixing, near_copies, phrase_index, repetition, token_files
from sensorframe.llm.session import ready, shared_folder


#: Hundredths of five-word shingles that near copies share.
SIMILARITY = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the limits on repetition."""
    ready(spark)
    return repetition.without_repetitive(docs)


def near_copy_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ready(spark)
    return near_copies.one_of_each(docs, percent=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    ready(spark)
    return phrase_index.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and what they say of each: doc_id, start, n_tokens, ids_crc32."""
    ready(spark)
    return token_files.token_table(docs, catalog.byte_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copy_removal", near_copy_removal),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The mix draws by a hash that other engines lack, so the pipeline is tested against its brute-force restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
