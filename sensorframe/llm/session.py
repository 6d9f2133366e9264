"""What the operators need from the session: shared tables, imports on executors, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sensorframe.shipping import ship

#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 16 << 20
#: Spark's setting that deletes shuffle files when an execution ends.
_SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the batches they get by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a local one only under a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "table", **options: object) -> DataFrame:
    """Compute once, as a table in the shared folder: this cuts lineage and survives lost executors.

    The shuffle files of the computation go with its end, since the table replaces them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_FILES, "false")
    spark.conf.set(_SHUFFLE_FILES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_FILES, before)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_at = path
    return again


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
