"""Tables that a query writes once and then reads more than once: indexes and side tables. They are kept in the shared
folder that ``spark.checkpoint.dir`` names; a local session without it gets a temporary folder, any other an error."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='cinderlens-')}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path that is deleted when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _local_folder()
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop, files = hadoop_path(spark, path)
    files.deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, path: str, parts: tuple[str, ...] = (), **options) -> DataFrame:
    """``df`` written to ``path`` and read again."""
    writer = df.write.options(**options)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
