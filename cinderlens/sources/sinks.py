"""Where results go: results and sidecars by dump and upserts as versions of a table, exports with a limit, deletes and
updates. What changes a table makes a new version of it, so that a reader sees the old or the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlens.sources.versioned import VersionedTable

#: Rows of an export; fixed value.
EXPORT_ROWS = 50_000


def results(spark: SparkSession, path: str, key: str = "filename") -> VersionedTable:
    """Packed JSON, one object per row, in buckets of the key."""
    return VersionedTable(spark, path, key, form="json", compression="gzip")


def write_results(df: DataFrame, path: str, key: str = "filename") -> int:
    """Results in place of those of the same dumps, without their logs; returns the version."""
    return results(df.sparkSession, path, key).merge(df.drop("log"))


def write_sidecar(df: DataFrame, path: str, lists: list[str], key: str = "filename") -> int:
    """Sidecars in place of those of the same dumps; one whose lists are all empty would hide what can still be worked out
    and is refused. Returns how many were written."""
    filled = F.lit(False)
    for c in lists:
        filled = filled | (F.coalesce(F.size(c), F.lit(0)) > 0)
    rows = df.where(filled)
    n = rows.count()
    if n:
        results(df.sparkSession, path, key).merge(rows)
    return n


def upsert(table: DataFrame, rows: DataFrame, key: str = "filename", first: str = "analyzed_at", good: str = "SUCCESS") -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key, which have one row each in both. The time of the first
    analysis stays where that went well."""
    old = table.select(F.col(key).alias("__key"), F.col("status").alias("__status"), F.col(first).alias("__first"))
    new = rows.join(old, F.col(key) == F.col("__key"), "left").withColumn(first, F.when(F.col("__status") == good, F.col("__first")).otherwise(F.col(first))).select(*table.columns)
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(new)


def upsert_into(table: VersionedTable, rows: DataFrame) -> int:
    """``upsert`` as a new version of a table, of which only the buckets of these rows are written."""
    return table.merge(rows, lambda old, new: upsert(old, new, table.key))


def insert_missing(table: DataFrame, rows: DataFrame, key: str = "filename") -> DataFrame:
    """The rows to append: those whose key the table does not hold, one of each."""
    return rows.join(table.select(key), key, "left_anti").dropDuplicates([key]).select(*table.columns)


def exported(df: DataFrame, order: list, most: int = EXPORT_ROWS) -> tuple[DataFrame, bool]:
    """The first rows of an export, and whether some are left out."""
    rows = df.orderBy(*order)
    return rows.limit(most), df.limit(most + 1).count() > most


def export_csv(df: DataFrame, path: str, order: list, most: int = EXPORT_ROWS) -> bool:
    """Quoted where a value holds a comma, a quote or a line end, quotes doubled; returns whether rows are left out."""
    rows, cut = exported(df, order, most)
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    return cut


def export_json(df: DataFrame, path: str, order: list, most: int = EXPORT_ROWS) -> bool:
    rows, cut = exported(df, order, most)
    rows.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return cut


def deleted(tables: dict[str, DataFrame], files: DataFrame, key: str = "filename") -> dict[str, DataFrame]:
    """Each table without the rows of these files. ``messages`` go with the ``chats`` that they are in."""
    out = {name: t.join(files.select(key), key, "left_anti") for name, t in tables.items() if name != "messages"}
    if "messages" in tables:
        gone = tables["chats"].join(files.select(key), key, "left_semi").select("chat_id")
        out["messages"] = tables["messages"].join(gone, "chat_id", "left_anti")
    return out


def filled(df: DataFrame, column: str, source: str) -> DataFrame:
    """``df`` with ``column`` taken from ``source`` where it is null."""
    return df.withColumn(column, F.coalesce(column, source))
