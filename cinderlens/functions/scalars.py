"""Formatting and parsing of sizes, counts, durations and names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlens.functions.html import ENTITIES, decoded
from cinderlens.plans.views import history
from cinderlens.sources.tables import load

#: Units of sizes; fixed values.
UNITS = {"TB": 1 << 40, "GB": 1 << 30, "MB": 1 << 20, "KB": 1 << 10, "B": 1}


def format_bytes(n: Column, rounded=F.round) -> Column:
    """0 B for nothing; one decimal for KB, two for MB and GB, GB without trailing zeros. Halves are rounded up, or as
    ``rounded`` says."""
    fixed = lambda x, digits: F.format_string(f"%.{digits}f", rounded(x, digits))
    gb = F.regexp_replace(fixed(n / float(1 << 30), 2), r"\.?0+$", "")
    text = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(fixed(n / 1024.0, 1), F.lit(" KB")))
    return F.when(n.isNull() | (n <= 0), "0 B").otherwise(text.when(n < 1 << 30, F.concat(fixed(n / float(1 << 20), 2), F.lit(" MB"))).otherwise(F.concat(gb, F.lit(" GB"))))


def format_duration(ms: Column) -> Column:
    """Milliseconds, seconds, or minutes and seconds; a dash for nothing."""
    s = F.floor(ms / 1000)
    text = F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
    return F.when(ms.isNull() | (ms <= 0), "-").otherwise(text.otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(" m "), (s % 60).cast("string"), F.lit(" s"))))


def parse_size(text: Column) -> Column:
    """A number with a unit in bytes, truncated; a plain number without one; 0 for what is neither."""
    clean = F.regexp_replace(F.upper(F.trim(text)), ",", "")
    number = F.regexp_extract(clean, r"([0-9]+(?:\.[0-9]+)?)\s*(TB|GB|MB|KB|B)\b", 1).try_cast("double")
    unit = F.regexp_extract(clean, r"([0-9]+(?:\.[0-9]+)?)\s*(TB|GB|MB|KB|B)\b", 2)
    factor = F.coalesce(*(F.when(unit == u, F.lit(float(f))) for u, f in UNITS.items()))
    return F.coalesce((number * factor).cast("long"), F.regexp_extract(clean, r"([0-9]+)", 1).try_cast("long"), F.lit(0))


def parse_count(text: Column) -> Column:
    """Counts such as 2.4k and 1.5m."""
    clean = F.lower(F.regexp_replace(F.trim(text), ",", ""))
    number = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)[km]?$", 1).try_cast("double")
    return F.coalesce((number * F.when(clean.endswith("k"), 1000.0).when(clean.endswith("m"), 1000000.0).otherwise(1.0)).cast("long"), F.lit(0))


def html_to_text(html: Column) -> Column:
    """Tags to spaces, entities decoded, white space squeezed."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\w+>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(decoded(out), r"[ \t\n\r]+", " "))


def fmt_bytes_query(spark: SparkSession, d: str) -> DataFrame:
    rows = history(spark, d)
    scaled = F.when(F.col("id") % 5 == 0, F.col("id") % 1024).when(F.col("id") % 5 == 1, (F.col("id") % 1000) * 1024).when(F.col("id") % 5 == 2, (F.col("id") % 500) * (1 << 20)).when(F.col("id") % 5 == 3, (F.col("id") % 40) * (1 << 30)).otherwise(F.lit(0))
    return rows.select("id", format_bytes(scaled.cast("long")).alias("text"))


def fmt_duration_query(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", format_duration(F.floor(F.col("value") * 1000) * (F.col("event_id") % 3)).alias("text"))


def parse_size_query(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.format_string("%,d", F.col("o_orderkey")), F.when(F.col("o_orderkey") % 4 == 0, " KB").when(F.col("o_orderkey") % 4 == 1, ".5 MB").when(F.col("o_orderkey") % 4 == 2, "").otherwise(" B"))
    return load(spark, d, "orders").select("o_orderkey", parse_size(text).alias("bytes"))


def parse_count_query(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".5k").when(F.col("o_orderkey") % 3 == 1, "m").otherwise("x"))
    return load(spark, d, "orders").select("o_orderkey", parse_count(text).alias("n"))


def html_list_items(spark: SparkSession, d: str) -> DataFrame:
    """List items of pages, in order."""
    items = F.regexp_extract_all("html", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))
    return load(spark, d, "pages").select("page_id", F.posexplode(items).alias("pos", "item")).select("page_id", "pos", F.trim(F.regexp_replace("item", r"<[^>]*>", "")).alias("item"))


def html_text_query(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.sha2(html_to_text(F.col("html")), 256).alias("text_hash"))


def partial_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of at most the first 64 KiB."""
    return load(spark, d, "pages").select("page_id", F.sha2(F.substring(F.col("html").cast("binary"), 1, 65536), 256).alias("hash"))


_ENT = "regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</\\w+>', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
for _e, _c in ENTITIES:
    _ENT = f"replace({_ENT}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
QUERIES = {
    "fmt_bytes": (
        fmt_bytes_query,
        """WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 1024 WHEN 1 THEN (o_orderkey % 1000) * 1024 WHEN 2 THEN (o_orderkey % 500) * 1048576 WHEN 3 THEN (o_orderkey % 40) * 1073741824 ELSE 0 END AS n FROM orders)
 SELECT id, CASE WHEN n <= 0 THEN '0 B' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n // 1024) || '.0 KB' WHEN n < 1073741824 THEN (n // 1048576) || '.00 MB' ELSE regexp_replace((n // 1073741824) || '.00', '\\.?0+$', '') || ' GB' END AS text FROM s""",
    ),
    "fmt_duration": (fmt_duration_query, "WITH s AS (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) * (event_id % 3) AS ms FROM events) SELECT event_id, CASE WHEN ms <= 0 THEN '-' WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN ms // 1000 || ' s' ELSE ms // 60000 || ' m ' || (ms // 1000) % 60 || ' s' END AS text FROM s"),
    "parse_size": (parse_size_query, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1024 WHEN 1 THEN o_orderkey * 1048576 + 524288 ELSE o_orderkey END AS bytes FROM orders"),
    "parse_count": (parse_count_query, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 1000 + 500 WHEN 1 THEN o_orderkey * 1000000 ELSE 0 END AS n FROM orders"),
    "html_list_items": (html_list_items, "SELECT page_id, CAST(generate_subscripts(i, 1) - 1 AS INTEGER) AS pos, trim(regexp_replace(unnest(i), '<[^>]*>', '', 'g')) AS item FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS i FROM pages)"),
    "html_to_text": (html_text_query, f"SELECT page_id, sha256(trim(regexp_replace({_ENT}, '[ \\t\\n\\r]+', ' ', 'g'))) AS text_hash FROM pages"),
    "partial_hash": (partial_hash, "SELECT page_id, sha256(CASE WHEN strlen(html) <= 65536 THEN encode(html) ELSE array_slice(encode(html), 1, 65536) END) AS hash FROM pages"),
}
