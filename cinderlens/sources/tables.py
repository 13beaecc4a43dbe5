"""Loading of the Parquet tables, with zone-less timestamps turned into instants (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(field, F.col(field).cast("timestamp"))
    return df
