"""Comparison of two snapshots: class histograms, findings and key figures, by full outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlens.sources.tables import load

TOP_CLASSES = 50
TOP_HISTOGRAM = 30


def histogram(spark: SparkSession, d: str, year: int) -> DataFrame:
    """``class_name, objects, retained`` of the snapshot of one year; money is summed as integer cents."""
    items = load(spark, d, "lineitem").where((F.col("l_shipdate") >= f"{year}-01-01") & (F.col("l_shipdate") < f"{year + 1}-01-01"))
    part = load(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("."), "p_type").alias("class_name"))
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("class_name").agg(F.count("*").alias("objects"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("retained"))


def paired(spark: SparkSession, d: str) -> DataFrame:
    """Both snapshots side by side; what one lacks is 0."""
    base = histogram(spark, d, 1996).select("class_name", F.col("objects").alias("bo"), F.col("retained").alias("br"))
    target = histogram(spark, d, 1997).select("class_name", F.col("objects").alias("to"), F.col("retained").alias("tr"))
    return base.join(target, "class_name", "full").na.fill(0, ["bo", "br", "to", "tr"])


def class_diff(spark: SparkSession, d: str) -> DataFrame:
    """Classes with the largest change of retained size."""
    delta = F.col("tr") - F.col("br")
    return paired(spark, d).withColumn("delta", delta).where("delta <> 0").orderBy(F.desc(F.abs("delta")), "class_name").limit(TOP_CLASSES).select("class_name", F.col("br").alias("base_size"), F.col("tr").alias("target_size"), "delta")


def histogram_diff(spark: SparkSession, d: str) -> DataFrame:
    """Histogram rows that changed in either figure."""
    rows = paired(spark, d).withColumn("object_delta", F.col("to") - F.col("bo")).withColumn("retained_delta", F.col("tr") - F.col("br"))
    return rows.where("object_delta <> 0 OR retained_delta <> 0").orderBy(F.desc(F.abs("retained_delta")), "class_name").limit(TOP_HISTOGRAM).select("class_name", "object_delta", "retained_delta")


def titles(spark: SparkSession, d: str, year: int) -> DataFrame:
    """Findings of the snapshot of one year by title (lower-cased, white space squeezed); of equal titles the last one, in
    order of line items, counts."""
    rows = load(spark, d, "lineitem").where((F.col("l_shipdate") >= f"{year}-01-01") & (F.col("l_shipdate") < f"{year + 1}-01-01"))
    title = F.trim(F.regexp_replace(F.lower(F.concat(F.lit(" Suspect  #"), F.col("l_suppkey").cast("string"), F.lit(" in "), F.col("l_returnflag"))), r"\s+", " "))
    level = F.when(F.col("l_quantity") >= 49, "critical").when(F.col("l_quantity") >= 45, "high").when(F.col("l_quantity") >= 10, "medium")
    return rows.groupBy(title.alias("title")).agg(F.max(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", level.alias("level"))).alias("last")).select("title", F.col("last.level").alias("level"))


#: Order of states in a comparison; fixed values.
STATES = ("NEW", "SEVERITY_CHANGED", "PERSIST", "GONE")


def suspect_diff(spark: SparkSession, d: str) -> DataFrame:
    """New, changed, persisting and gone findings, by ``place`` in that order."""
    b = titles(spark, d, 1996).select("title", F.col("level").alias("base_level"), F.lit(True).alias("b"))
    t = titles(spark, d, 1997).select("title", F.col("level").alias("target_level"), F.lit(True).alias("t"))
    state = F.when(F.col("b").isNull(), "NEW").when(F.col("t").isNull(), "GONE").when(~F.col("base_level").eqNullSafe(F.col("target_level")), "SEVERITY_CHANGED").otherwise("PERSIST")
    rows = b.join(t, "title", "full").select("title", state.alias("state"), "base_level", "target_level")
    place = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")).cast("int")
    return rows.withColumn("place", place).orderBy("place", "title")


def kpi_diff(spark: SparkSession, d: str) -> DataFrame:
    """Nine differences, target minus base, with signs and thousands: objects, retained size, classes, the largest class,
    the mean of a class, findings, critical ones, suppliers and parts."""
    out = paired(spark, d).agg(F.sum(F.col("to") - F.col("bo")).alias("objects"), F.sum(F.col("tr") - F.col("br")).alias("retained"), (F.count_if(F.col("to") > 0) - F.count_if(F.col("bo") > 0)).alias("classes"), (F.max("tr") - F.max("br")).alias("largest"), (F.floor(F.sum("tr") / F.count_if(F.col("to") > 0)) - F.floor(F.sum("br") / F.count_if(F.col("bo") > 0))).cast("long").alias("mean"))
    year = F.year("l_shipdate")
    per = lambda c: (c(F.when(year == 1997, 1)) - c(F.when(year == 1996, 1)))
    more = load(spark, d, "lineitem").where(year.isin(1996, 1997)).agg(per(F.count).alias("findings"), (F.count_if((year == 1997) & (F.col("l_quantity") >= 49)) - F.count_if((year == 1996) & (F.col("l_quantity") >= 49))).alias("critical"), (F.count_distinct(F.when(year == 1997, F.col("l_suppkey"))) - F.count_distinct(F.when(year == 1996, F.col("l_suppkey")))).alias("suppliers"), (F.count_distinct(F.when(year == 1997, F.col("l_partkey"))) - F.count_distinct(F.when(year == 1996, F.col("l_partkey")))).alias("parts"))
    names = ("objects", "retained", "classes", "largest", "mean", "findings", "critical", "suppliers", "parts")
    signed = lambda c: F.concat(F.when(F.col(c) > 0, "+").otherwise(""), F.format_string("%,d", F.col(c)))
    # one row each
    return out.crossJoin(F.broadcast(more)).select(*names, F.concat_ws(" ", *map(signed, names)).alias("text"))


def top_plus_others(spark: SparkSession, d: str) -> DataFrame:
    """The eight classes with most retained size, and the rest as one row."""
    rows = histogram(spark, d, 1996).select("class_name", "retained")
    all_ = rows.agg(F.sum("retained").alias("all_retained"), F.count("*").alias("classes"))
    top = rows.orderBy(F.desc("retained"), "class_name").limit(8)
    shown = top.agg(F.sum("retained").alias("shown"))
    # one row each
    rest = all_.crossJoin(F.broadcast(shown)).where("classes > 8").select(F.lit("Others").alias("label"), (F.col("all_retained") - F.col("shown")).alias("retained"), "all_retained")
    return top.crossJoin(F.broadcast(all_)).select(F.col("class_name").alias("label"), "retained", "all_retained").unionByName(rest)


def dominator_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bar widths in percent of the largest value, at least 2 for what is not 0, and colour bands."""
    rows = histogram(spark, d, 1996).select("class_name", "retained")
    # one row
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("retained").alias("most"))))
    ratio = F.col("retained") / F.col("most")
    width = F.when(F.col("retained") > 0, F.greatest(F.floor(ratio * 100), F.lit(2))).otherwise(0)
    return rows.select("class_name", width.cast("long").alias("width"), F.when(ratio > 0.6, "high").when(ratio > 0.3, "middle").otherwise("low").alias("band"))


_HIST = """h AS (SELECT p_brand || '.' || p_type AS class_name, count(*) FILTER (year(l_shipdate) = 1996) AS bo, coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (year(l_shipdate) = 1996), 0)::BIGINT AS br,
 count(*) FILTER (year(l_shipdate) = 1997) AS "to", coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (year(l_shipdate) = 1997), 0)::BIGINT AS tr FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) IN (1996, 1997) GROUP BY 1)"""

QUERIES = {
    "class_diff": (class_diff, f"WITH {_HIST} SELECT class_name, br AS base_size, tr AS target_size, tr - br AS delta FROM h WHERE tr <> br ORDER BY abs(tr - br) DESC, class_name LIMIT {TOP_CLASSES}"),
    "histogram_diff": (histogram_diff, f'WITH {_HIST} SELECT class_name, "to" - bo AS object_delta, tr - br AS retained_delta FROM h WHERE "to" <> bo OR tr <> br ORDER BY abs(tr - br) DESC, class_name LIMIT {TOP_HISTOGRAM}'),
    "suspect_diff": (
        suspect_diff,
        """WITH s AS (SELECT year(l_shipdate) AS y, 'suspect #' || l_suppkey || ' in ' || lower(l_returnflag) AS title, arg_max(CASE WHEN l_quantity >= 49 THEN 'critical' WHEN l_quantity >= 45 THEN 'high' WHEN l_quantity >= 10 THEN 'medium' ELSE '' END, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS level FROM lineitem WHERE year(l_shipdate) IN (1996, 1997) GROUP BY 1, 2),
 b AS (SELECT title, level FROM s WHERE y = 1996), t AS (SELECT title, level FROM s WHERE y = 1997),
 j AS (SELECT title, CASE WHEN b.level IS NULL THEN 'NEW' WHEN t.level IS NULL THEN 'GONE' WHEN b.level <> t.level THEN 'SEVERITY_CHANGED' ELSE 'PERSIST' END AS state, nullif(b.level, '') AS base_level, nullif(t.level, '') AS target_level FROM b FULL JOIN t USING (title))
 SELECT *, CAST(list_position(['NEW', 'SEVERITY_CHANGED', 'PERSIST', 'GONE'], state) AS INTEGER) AS place FROM j""",
    ),
    "kpi_diff": (kpi_diff, f"""WITH {_HIST}, a AS (SELECT CAST(sum("to" - bo) AS BIGINT) AS objects, CAST(sum(tr - br) AS BIGINT) AS retained, count(*) FILTER ("to" > 0) - count(*) FILTER (bo > 0) AS classes, max(tr) - max(br) AS largest, CAST(floor(sum(tr) / count(*) FILTER ("to" > 0)) - floor(sum(br) / count(*) FILTER (bo > 0)) AS BIGINT) AS mean FROM h),
 m AS (SELECT count(*) FILTER (year(l_shipdate) = 1997) - count(*) FILTER (year(l_shipdate) = 1996) AS findings, count(*) FILTER (year(l_shipdate) = 1997 AND l_quantity >= 49) - count(*) FILTER (year(l_shipdate) = 1996 AND l_quantity >= 49) AS critical, count(DISTINCT l_suppkey) FILTER (year(l_shipdate) = 1997) - count(DISTINCT l_suppkey) FILTER (year(l_shipdate) = 1996) AS suppliers, count(DISTINCT l_partkey) FILTER (year(l_shipdate) = 1997) - count(DISTINCT l_partkey) FILTER (year(l_shipdate) = 1996) AS parts FROM lineitem)
 SELECT *, concat_ws(' ', {', '.join(f"CASE WHEN {c} > 0 THEN '+' ELSE '' END || format('{{:,}}', {c})" for c in ('objects', 'retained', 'classes', 'largest', 'mean', 'findings', 'critical', 'suppliers', 'parts'))}) AS text FROM a, m"""),
    "top_plus_others": (top_plus_others, f"WITH {_HIST}, r AS (SELECT class_name, br, row_number() OVER (ORDER BY br DESC, class_name) AS rn, sum(br) OVER () AS a FROM h WHERE bo > 0) SELECT CASE WHEN rn <= 8 THEN class_name ELSE 'Others' END AS label, CAST(sum(br) AS BIGINT) AS retained, CAST(max(a) AS BIGINT) AS all_retained FROM r GROUP BY 1"),
    "dominator_bars": (dominator_bars, f"WITH {_HIST}, r AS (SELECT class_name, br, br / (max(br) OVER ()) AS ratio FROM h WHERE bo > 0) SELECT class_name, CAST(CASE WHEN br > 0 THEN greatest(floor(ratio * 100), 2) ELSE 0 END AS BIGINT) AS width, CASE WHEN ratio > 0.6 THEN 'high' WHEN ratio > 0.3 THEN 'middle' ELSE 'low' END AS band FROM r"),
}
