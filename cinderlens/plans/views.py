"""Domain views over the driver's tables, and the same as SQL for the oracles.

``HISTORY_SQL`` and the others are WITH clauses that the oracle texts start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.sources.tables import load


def extension(key: Column) -> Column:
    """File extension of a dump by its number."""
    return F.when(key % 4 == 0, ".hprof").when(key % 4 == 1, ".bin").when(key % 4 == 2, ".hprof.gz").otherwise("")


def history(spark: SparkSession, d: str) -> DataFrame:
    """One row per analysed dump, with its server (null for local ones)."""
    orders, customer, nation = (load(spark, d, t) for t in ("orders", "customer", "nation"))
    servers = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "ERROR").otherwise("NOT_ANALYZED")
    return orders.join(servers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("dump_"), F.col("o_orderkey").cast("string"), extension(F.col("o_orderkey"))).alias("filename"),
        status.alias("status"),
        F.col("o_orderdate").alias("analyzed_at"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("used_heap"),
        (F.col("o_orderkey") % 7 == 0).alias("file_deleted"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("n_name")).alias("server_name"),
        F.col("o_custkey").alias("owner"),
    )


def severity(percent: Column) -> Column:
    """50, 25, 10 and more than 0 percent; medium otherwise."""
    return F.when(percent >= 50, "critical").when(percent >= 25, "high").when(percent >= 10, "medium").when(percent > 0, "low").otherwise("medium")


def weight(level: Column) -> Column:
    """Rank of a severity; unknown ones weigh 0."""
    level = F.lower(level)
    return F.when(level == "critical", 4).when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0)


def suspects(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each dump, numbered in a total order."""
    w = Window.partitionBy("id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    return load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id").select(
        "id",
        F.row_number().over(w).alias("ordinal"),
        (F.col("l_quantity") * 2).alias("percent"),
        severity(F.col("l_quantity") * 2).alias("severity"),
        F.col("l_returnflag").alias("category"),
    )


def transfers(spark: SparkSession, d: str) -> DataFrame:
    """Transfers of files, from events."""
    size = F.round(F.col("value") * 100).cast("long")
    return load(spark, d, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 25).alias("server_id"),
        F.concat(F.lit("dump_"), (F.col("event_id") % 500).cast("string"), F.lit(".hprof")).alias("filename"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        size.alias("file_size"),
        F.col("ts").alias("started_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.greatest(size, F.lit(0)) * 1000).alias("completed_at"),
        F.col("user_id").alias("username"),
        F.col("event_type"),
    )


HISTORY_SQL = """history AS (SELECT o_orderkey AS id, 'dump_' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.hprof' WHEN 1 THEN '.bin' WHEN 2 THEN '.hprof.gz' ELSE '' END AS filename,
 CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'ERROR' ELSE 'NOT_ANALYZED' END AS status, o_orderdate AS analyzed_at, CAST(round(o_totalprice * 100) AS BIGINT) AS used_heap,
 o_orderkey % 7 = 0 AS file_deleted, CASE WHEN o_custkey % 5 <> 0 THEN n_name END AS server_name, o_custkey AS owner
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
SUSPECTS_SQL = """suspects AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS ordinal,
 l_quantity * 2 AS percent, CASE WHEN l_quantity * 2 >= 50 THEN 'critical' WHEN l_quantity * 2 >= 25 THEN 'high' WHEN l_quantity * 2 >= 10 THEN 'medium' WHEN l_quantity > 0 THEN 'low' ELSE 'medium' END AS severity, l_returnflag AS category FROM lineitem)"""
TRANSFERS_SQL = """transfers AS (SELECT event_id AS id, user_id % 25 AS server_id, 'dump_' || event_id % 500 || '.hprof' AS filename, CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
 CAST(round(value * 100) AS BIGINT) AS file_size, ts AS started_at, ts + to_milliseconds(greatest(CAST(round(value * 100) AS BIGINT), 0)) AS completed_at, user_id AS username, event_type FROM events)"""
