"""The history of analyses: stored rows, files on disk and cached results as one list, with what each says about a dump.

A dump has one row, from the first of three places that knows it: the stored rows, the files (with a cached result of that
name, if there is one), and the cached results. The three tables meet in two joins by name; each has one row per name, of
files the one that was changed last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlens.functions.scalars import format_bytes
from cinderlens.plans.views import HISTORY_SQL, history
from cinderlens.sources.tables import load

STORED = "filename string, id long, status string, suspect_count int, analysis_ms long, used_heap long, server_name string, dump_created timestamp, analyzed_at timestamp, file_size long, original_size long"
FILES = "filename string, size long, modified timestamp, compressed boolean, original_size long, compressed_size long"
CACHED = "filename string, status string, suspects int, analysis_ms long, used_heap long, file_size long, modified timestamp"
INSIGHTS = "filename string, severity string"


def short_duration(ms: Column) -> Column:
    """Milliseconds, seconds, or minutes and seconds, without blanks before the units; a dash for nothing."""
    s = F.floor(ms / 1000)
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(ms.isNull() | (ms <= 0), "-").when(ms < 1000, part(ms, "ms")).when(s < 60, part(s, "s")).otherwise(F.concat(part(F.floor(s / 60), "m "), part(s % 60, "s")))


def file_bytes(n: Column) -> Column:
    """Two decimals for KB, MB and GB, bytes as they are."""
    unit = lambda least, name: F.concat(F.format_string("%.2f", n / float(least)), F.lit(name))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(1 << 10, " KB")).when(n < 1 << 30, unit(1 << 20, " MB")).otherwise(unit(1 << 30, " GB"))


def shown_name(filename: Column, server: Column, at: Column) -> Column:
    """``[EXT]server_file_yyyyMMdd``: the ending in capitals (that of what is packed, ``DUMP`` without one), the server in
    small letters or ``local``."""
    low = F.lower(F.coalesce(filename, F.lit("")))
    bare = F.when(low.endswith(".gz"), F.substring(low, F.lit(1), F.length(low) - 3)).otherwise(low)
    ending = F.upper(F.regexp_extract(bare, r"\.([^.]+)$", 1))
    named = F.when(F.trim(F.coalesce(server, F.lit(""))) == "", "local").otherwise(F.lower(server))
    return F.concat(F.lit("["), F.when(ending == "", "DUMP").otherwise(ending), F.lit("]"), named, F.lit("_"), F.coalesce(filename, F.lit("")), F.lit("_"), F.date_format(at, "yyyyMMdd"))


def _named(rows: DataFrame, prefix: str) -> DataFrame:
    """The table's columns as one struct beside its name."""
    return rows.where("filename IS NOT NULL").select("filename", F.struct(*rows.columns).alias(prefix))


def assembled(stored: DataFrame, files: DataFrame, cached: DataFrame, insights: DataFrame) -> DataFrame:
    """One row per dump, newest first by ``last_modified`` where the caller sorts; see the schemas above."""
    latest = files.groupBy("filename").agg(F.max_by(F.struct(*files.columns), "modified").alias("f"))
    rows = _named(stored, "s").join(latest, "filename", "full").join(_named(cached, "c"), "filename", "full").join(insights.select("filename", F.col("severity").alias("insight_severity"), F.lit(True).alias("has_insight")), "filename", "left")
    s, f, c = (F.col(x).isNotNull() for x in ("s", "f", "c"))
    col = F.col
    of = lambda in_stored, in_file, in_cache: F.when(s, in_stored).when(f, in_file).otherwise(in_cache)
    # a file's figures count where there is a file, also for stored rows
    disk = lambda there, stored_, cached_: F.when(f, there).when(s, stored_).otherwise(cached_)
    zero, dash, none = F.lit(0).cast("long"), F.lit("-"), F.lit(None)
    millis = lambda x: F.unix_millis(x)
    minute = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    analysis_ms = of(F.coalesce("s.analysis_ms", zero), F.coalesce("c.analysis_ms", zero), F.coalesce("c.analysis_ms", zero))
    shown_ms = F.when(s | c, short_duration(analysis_ms))
    packed = F.coalesce(f & col("f.compressed"), F.lit(False))
    modified = disk(col("f.modified"), col("s.analyzed_at"), col("c.modified"))
    named_at = F.when(s & col("s.analyzed_at").isNotNull(), col("s.analyzed_at")).otherwise(modified)
    return rows.select(
        col("s.id").alias("id"),
        "filename",
        of(F.lit("stored"), F.lit("file"), F.lit("cache")).alias("origin"),
        of(col("s.status"), F.coalesce("c.status", F.lit("NOT_ANALYZED")), col("c.status")).alias("status"),
        of(F.coalesce("s.suspect_count", F.lit(0)), F.coalesce("c.suspects", F.lit(0)), F.coalesce("c.suspects", F.lit(0))).alias("suspect_count"),
        analysis_ms.alias("analysis_ms"),
        shown_ms.alias("analysis_time"),
        of(F.when(col("s.used_heap").isNotNull(), format_bytes(col("s.used_heap"))).otherwise(dash), F.when(c, format_bytes(col("c.used_heap"))), format_bytes(col("c.used_heap"))).alias("heap_used"),
        F.coalesce("s.used_heap", zero).alias("heap_used_bytes"),
        col("s.server_name").alias("server_name"),
        col("s.dump_created").alias("dump_created"),
        F.coalesce(millis(col("s.analyzed_at")), zero).alias("analyzed_epoch"),
        (~f).alias("file_deleted"),
        disk(file_bytes(col("f.size")), F.when(col("s.file_size").isNotNull(), format_bytes(col("s.file_size"))).otherwise(dash), format_bytes(col("c.file_size"))).alias("size"),
        disk(col("f.size"), F.coalesce("s.file_size", zero), zero).alias("size_bytes"),
        F.when(packed, F.when(col("f.original_size") > 0, file_bytes(col("f.original_size"))).otherwise(file_bytes(col("f.size")))).alias("original_size"),
        F.when(packed, F.when(col("f.compressed_size") > 0, file_bytes(col("f.compressed_size"))).otherwise(dash)).alias("compressed_size"),
        disk(F.when(packed & (col("f.original_size") > 0), col("f.original_size")).otherwise(col("f.size")), F.coalesce("s.original_size", "s.file_size", zero), zero).alias("original_bytes"),
        F.when(packed, F.coalesce("f.compressed_size", zero)).otherwise(zero).alias("compressed_bytes"),
        F.coalesce(minute(modified), dash).alias("date"),
        F.coalesce(millis(modified), zero).alias("last_modified"),
        packed.alias("compressed"),
        F.coalesce("has_insight", F.lit(False)).alias("has_insight"),
        F.when(col("has_insight"), col("insight_severity")).otherwise(none).alias("insight_severity"),
        shown_name(col("filename"), col("s.server_name"), named_at).alias("analysis_name"),
    )


# ---- queries


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the history but those of customers in debt, whose records are lost; some say no size."""
    lost = load(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("owner"))
    k = F.col("id")
    return history(spark, d).join(lost, "owner", "left_anti").select("filename", "id", "status", F.when(k % 6 != 0, (k % 5).cast("int")).alias("suspect_count"), F.when(k % 11 != 0, k * 37).alias("analysis_ms"), F.when(k % 13 != 0, F.col("used_heap")).alias("used_heap"), "server_name", F.when(k % 2 == 0, F.col("analyzed_at")).alias("dump_created"), F.col("analyzed_at"), F.when(k % 17 != 0, k * 1500).alias("file_size"), F.when(k % 3 == 0, k * 2500).alias("original_size"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each dump with line items of more than one ship year's start, packed where its name says so."""
    rows = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.max("l_shipdate").alias("modified"))
    k = F.col("id")
    ending = F.when(k % 4 == 0, ".hprof").when(k % 4 == 1, ".bin").when(k % 4 == 2, ".hprof.gz").otherwise("")
    return rows.select(F.concat(F.lit("dump_"), k.cast("string"), ending).alias("filename"), (F.col("q") * k * 16).alias("size"), "modified", (k % 4 == 2).alias("compressed"), F.when(k % 8 == 2, F.col("q") * k * 64).otherwise(0).alias("original_size"), F.when(k % 16 == 2, 0).otherwise(F.col("q") * k * 16).alias("compressed_size"))


def _cached(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("dump_"), (k * 3).cast("string"), F.when(k * 3 % 4 == 0, ".hprof").when(k * 3 % 4 == 1, ".bin").when(k * 3 % 4 == 2, ".hprof.gz").otherwise(F.when(k % 2 == 0, ".old").otherwise("")))
    return load(spark, d, "customer").select(name.alias("filename"), F.when(k % 4 == 0, "ERROR").otherwise("SUCCESS").alias("status"), (k % 3).cast("int").alias("suspects"), (k * 91).alias("analysis_ms"), (k * 70_000).alias("used_heap"), (k * 9_000).alias("file_size"), F.timestamp_seconds(F.lit(1_700_000_000) + k * 60).alias("modified"))


def _insights(spark: SparkSession, d: str) -> DataFrame:
    """The newest insight of each file."""
    name = F.concat(F.lit("dump_"), (F.col("event_id") % 2000 * 4).cast("string"), F.lit(".hprof"))
    return load(spark, d, "events").groupBy(name.alias("filename")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("severity"))


def history_rows(spark: SparkSession, d: str) -> DataFrame:
    """The history of all dumps with all columns; times as text."""
    rows = assembled(_stored(spark, d), _files(spark, d), _cached(spark, d), _insights(spark, d))
    return rows.withColumn("dump_created", F.date_format("dump_created", "yyyy-MM-dd"))


def analysis_name(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("id", shown_name(F.col("filename"), F.col("server_name"), F.col("analyzed_at")).alias("name"))


_END = lambda k: f"CASE {k} % 4 WHEN 0 THEN '.hprof' WHEN 1 THEN '.bin' WHEN 2 THEN '.hprof.gz' ELSE '' END"
_SHORT = lambda n: f"CASE WHEN coalesce({n}, 0) <= 0 THEN '-' WHEN {n} < 1000 THEN {n} || 'ms' WHEN {n} < 60000 THEN {n} // 1000 || 's' ELSE {n} // 60000 || 'm ' || {n} // 1000 % 60 || 's' END"
_TWO = lambda n: f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN printf('%.2f', round({n} / 1024.0, 2)) || ' KB' WHEN {n} < 1073741824 THEN printf('%.2f', round({n} / 1048576.0, 2)) || ' MB' ELSE printf('%.2f', round({n} / 1073741824.0, 2)) || ' GB' END"
_ONE = lambda n: f"CASE WHEN coalesce({n}, 0) <= 0 THEN '0 B' WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN printf('%.1f', round({n} / 1024.0, 1)) || ' KB' WHEN {n} < 1073741824 THEN printf('%.2f', round({n} / 1048576.0, 2)) || ' MB' ELSE regexp_replace(printf('%.2f', round({n} / 1073741824.0, 2)), '\\.?0+$', '') || ' GB' END"
_NAME = lambda file, server, at: f"'[' || coalesce(nullif(upper(regexp_extract(regexp_replace(lower({file}), '\\.gz$', ''), '\\.([^.]+)$', 1)), ''), 'DUMP') || ']' || CASE WHEN trim(coalesce({server}, '')) = '' THEN 'local' ELSE lower({server}) END || '_' || {file} || '_' || strftime({at}, '%Y%m%d')"
_ROWS_SQL = f"""WITH {HISTORY_SQL}, s AS (SELECT filename, id, status, CASE WHEN id % 6 <> 0 THEN CAST(id % 5 AS INTEGER) END AS suspect_count, CASE WHEN id % 11 <> 0 THEN id * 37 END AS ms, CASE WHEN id % 13 <> 0 THEN used_heap END AS used, server_name, CASE WHEN id % 2 = 0 THEN analyzed_at END AS created, analyzed_at AS seen, CASE WHEN id % 17 <> 0 THEN id * 1500 END AS fs, CASE WHEN id % 3 = 0 THEN id * 2500 END AS os FROM history WHERE owner NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)),
 l AS (SELECT l_orderkey AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, max(l_shipdate) AS modified FROM lineitem GROUP BY 1),
 f AS (SELECT 'dump_' || id || {_END("id")} AS filename, q * id * 16 AS size, modified, id % 4 = 2 AS packed, CASE WHEN id % 8 = 2 THEN q * id * 64 ELSE 0 END AS os, CASE WHEN id % 16 = 2 THEN 0 ELSE q * id * 16 END AS cs FROM l),
 c AS (SELECT 'dump_' || c_custkey * 3 || CASE WHEN c_custkey * 3 % 4 = 3 AND c_custkey % 2 = 0 THEN '.old' ELSE {_END("c_custkey * 3")} END AS filename, CASE WHEN c_custkey % 4 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status, CAST(c_custkey % 3 AS INTEGER) AS suspects, c_custkey * 91 AS ms, c_custkey * 70000 AS used, c_custkey * 9000 AS fs, TIMESTAMP '2023-11-14 22:13:20' + to_seconds(c_custkey * 60) AS modified FROM customer),
 i AS (SELECT 'dump_' || event_id % 2000 * 4 || '.hprof' AS filename, max_by(event_type, (ts, event_id)) AS severity FROM events GROUP BY 1),
 n AS (SELECT filename FROM s UNION SELECT filename FROM f UNION SELECT filename FROM c),
 j AS (SELECT n.filename, s.filename IS NOT NULL AS hs, f.filename IS NOT NULL AS hf, c.filename IS NOT NULL AS hc, s.id, s.status AS ss, c.status AS cst, suspect_count, suspects, s.ms AS sms, c.ms AS cms, s.used AS su, c.used AS cu, server_name, created, seen, s.fs AS sfs, s.os AS sos, f.size AS z, f.modified AS fm, coalesce(packed, false) AS packed, f.os AS fos, f.cs AS cs, c.fs AS cfs, c.modified AS cm, severity, i.filename IS NOT NULL AS has,
  CASE WHEN s.filename IS NOT NULL THEN coalesce(s.ms, 0) ELSE coalesce(c.ms, 0) END AS ms, CASE WHEN f.filename IS NOT NULL THEN f.modified WHEN s.filename IS NOT NULL THEN seen ELSE c.modified END AS m FROM n LEFT JOIN s USING (filename) LEFT JOIN f USING (filename) LEFT JOIN c USING (filename) LEFT JOIN i USING (filename))
 SELECT id, filename, CASE WHEN hs THEN 'stored' WHEN hf THEN 'file' ELSE 'cache' END AS origin, CASE WHEN hs THEN ss WHEN hf THEN coalesce(cst, 'NOT_ANALYZED') ELSE cst END AS status, CASE WHEN hs THEN coalesce(suspect_count, 0) ELSE coalesce(suspects, 0) END AS suspect_count, ms AS analysis_ms, CASE WHEN hs OR hc THEN {_SHORT("ms")} END AS analysis_time,
 CASE WHEN hs THEN CASE WHEN su IS NULL THEN '-' ELSE {_ONE("su")} END WHEN hc THEN {_ONE("cu")} END AS heap_used, CASE WHEN hs THEN coalesce(su, 0) ELSE 0 END AS heap_used_bytes, server_name, strftime(created, '%Y-%m-%d') AS dump_created, coalesce(epoch_ms(seen), 0) AS analyzed_epoch, NOT hf AS file_deleted,
 CASE WHEN hf THEN {_TWO("z")} WHEN hs THEN CASE WHEN sfs IS NULL THEN '-' ELSE {_ONE("sfs")} END ELSE {_ONE("cfs")} END AS size, CASE WHEN hf THEN z WHEN hs THEN coalesce(sfs, 0) ELSE 0 END AS size_bytes, CASE WHEN packed THEN CASE WHEN fos > 0 THEN {_TWO("fos")} ELSE {_TWO("z")} END END AS original_size, CASE WHEN packed THEN CASE WHEN cs > 0 THEN {_TWO("cs")} ELSE '-' END END AS compressed_size,
 CASE WHEN hf THEN CASE WHEN packed AND fos > 0 THEN fos ELSE z END WHEN hs THEN coalesce(sos, sfs, 0) ELSE 0 END AS original_bytes, CASE WHEN packed THEN cs ELSE 0 END AS compressed_bytes, coalesce(strftime(m, '%Y-%m-%d %H:%M'), '-') AS date, coalesce(epoch_ms(m), 0) AS last_modified, packed AS compressed, has AS has_insight, CASE WHEN has THEN severity END AS insight_severity, {_NAME("filename", "server_name", "CASE WHEN hs AND seen IS NOT NULL THEN seen ELSE m END")} AS analysis_name FROM j"""
QUERIES = {
    "history_rows": (history_rows, _ROWS_SQL),
    "analysis_name": (analysis_name, f"WITH {HISTORY_SQL} SELECT id, {_NAME('filename', 'server_name', 'analyzed_at')} AS name FROM history"),
}
