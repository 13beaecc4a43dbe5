"""Intermediate tables that outlive a lost executor.

``durable(df)`` writes ``df`` as Parquet under the shared folder named by ``spark.checkpoint.dir`` and returns the
table read back, so lineage ends there and no later step recomputes it. ``release`` deletes such tables once nothing
reads them any more; the others are deleted when the driver's JVM ends. Where the setting is missing, a local session
(as in tests), whose only executor is the driver itself, gets a temporary folder; any other session gets an error, as
its executors would not see such a folder.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local_dir()
    return folder.rstrip("/")


@functools.cache
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='cinderlens-')}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted at the end of the application."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop, files = _file_system(spark, path)
    files.deleteOnExit(hadoop)
    return path


def durable(df: DataFrame, label: str = "step", codec: str = "zstd", group_bytes: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again; with ``group_bytes`` as the size of Parquet's row groups, which
    are read at once when rows are long."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", codec)
    (writer.option("parquet.block.size", group_bytes) if group_bytes else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """``df`` written to the shared folder by buckets of ``key``, sorted by it, and read again: joins on ``key`` move the
    other side only."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, name = new_path(spark, label), f"{label}_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    out.stored_at, out.named = path, name
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` and ``bucketed`` returned and that nothing reads from now on."""
    for t in tables:
        if hasattr(t, "named"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.named}")
        hadoop, files = _file_system(t.sparkSession, t.stored_at)
        files.delete(hadoop, True)
