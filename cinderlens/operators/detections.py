"""Detection series: days, servers and severities of dumps with findings, inside a window that ends at the last day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.plans.views import HISTORY_SQL, SUSPECTS_SQL, history, suspects, weight
from cinderlens.sources.tables import load

DAYS = 90
TOP_SERVERS = 5
RECENT = 30


def severity_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Findings per dump by severity, with the worst one (the first of equals) and its number."""
    s = suspects(spark, d)
    n = lambda level: F.count_if(F.col("severity") == level)
    top = F.max(F.struct(weight(F.col("severity")).alias("w"), (-F.col("ordinal")).alias("o"), F.col("severity").alias("s")))
    return s.groupBy("id").agg(n("critical").alias("critical"), n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"), F.count("*").alias("total"), top.alias("top")).select(
        "id", "critical", "high", "medium", "low", "total", F.col("top.s").alias("max_severity"), (-F.col("top.o")).alias("max_ordinal")
    )


def detected(spark: SparkSession, d: str) -> DataFrame:
    """Analysed dumps that have findings."""
    return history(spark, d).where(F.col("status") == "SUCCESS").join(severity_by_file(spark, d), "id").withColumn("day", F.to_date("analyzed_at"))


def with_findings(spark: SparkSession, d: str) -> DataFrame:
    """Analysed dumps that have findings, without looking at these."""
    found = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return history(spark, d).where(F.col("status") == "SUCCESS").join(found, "id", "left_semi").withColumn("day", F.to_date("analyzed_at"))


def windowed(spark: SparkSession, d: str, days: int = DAYS, dumps=detected) -> tuple[DataFrame, DataFrame]:
    """The dumps of the window, and its days."""
    end = history(spark, d).agg(F.max(F.to_date("analyzed_at")).alias("end"))
    days_of = end.select(F.explode(F.sequence(F.date_sub("end", days - 1), F.col("end"))).alias("day"))
    # the window is one row
    found = dumps(spark, d).join(F.broadcast(end), F.col("day").between(F.date_sub("end", days - 1), F.col("end"))).drop("end")
    return found, days_of


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Dumps with findings on each day, with days without any."""
    found, days = windowed(spark, d, dumps=with_findings)
    return days.join(found.groupBy("day").agg(F.count("*").alias("n")), "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("detections"))


def by_server(spark: SparkSession, d: str) -> DataFrame:
    """Days by server; servers beyond the first ones count as others."""
    found, days = windowed(spark, d, dumps=with_findings)
    named = found.withColumn("server", F.coalesce(F.nullif(F.trim("server_name"), F.lit("")), F.lit("Local")))
    counts = named.groupBy("server", "day").agg(F.count("*").alias("n"))
    # the first servers are a few rows; the others are those that are not among them
    first = counts.groupBy("server").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "server").limit(TOP_SERVERS).select("server", F.col("server").alias("shown"))
    series = counts.join(F.broadcast(first), "server", "left").withColumn("series", F.coalesce("shown", F.lit("others")))
    got = series.groupBy("series", "day").agg(F.sum("n").alias("n"))
    grid = got.select("series").distinct().crossJoin(F.broadcast(days))
    return grid.join(got, ["series", "day"], "left").select("series", F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("detections"))


def by_severity(spark: SparkSession, d: str) -> DataFrame:
    """Days by the worst severity of each dump."""
    found, _ = windowed(spark, d)
    return found.groupBy(F.col("day").cast("string").alias("day"), "max_severity").agg(F.count("*").alias("detections"))


def kpi(spark: SparkSession, d: str) -> DataFrame:
    """All detections of the window, the last seven days, the seven before, the change in percent, and the peak day."""
    found, days = windowed(spark, d, dumps=with_findings)
    series = days.join(found.groupBy("day").agg(F.count("*").alias("n")), "day", "left").na.fill(0, ["n"]).withColumn("end", F.max("day").over(Window.partitionBy()))
    age = F.datediff("end", "day")
    out = series.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(age < 7, F.col("n")).otherwise(0)).alias("last7"),
        F.sum(F.when((age >= 7) & (age < 14), F.col("n")).otherwise(0)).alias("prev7"),
        F.max(F.struct("n", (-F.unix_date("day")).alias("d"), F.col("day").alias("day"))).alias("peak"),
    )
    change = F.when(F.col("prev7") > 0, F.floor(F.try_divide((F.col("last7") - F.col("prev7")) * 100.0, "prev7") + 0.5))
    return out.select("total", "last7", "prev7", change.alias("delta_percent"), F.when(F.col("peak.n") > 0, F.col("peak.day").cast("string")).alias("peak_day"), F.col("peak.n").alias("peak"))


def recent(spark: SparkSession, d: str) -> DataFrame:
    """The worst and newest detections of the window."""
    found, _ = windowed(spark, d)
    return found.orderBy(F.desc(weight(F.col("max_severity"))), F.desc("analyzed_at"), "id").limit(RECENT).select("id", "filename", "server_name", "max_severity", "max_ordinal", "total")


def day_files(spark: SparkSession, d: str) -> DataFrame:
    """Dumps of the last day of the window that have findings."""
    found, _ = windowed(spark, d, 30)
    return found.where(F.col("critical") + F.col("high") + F.col("medium") + F.col("low") > 0).select("id", F.col("day").cast("string").alias("day"), "critical", "high", F.col("total").alias("findings")).orderBy(F.desc("critical"), F.desc("high"), F.desc("findings"), "id")


def severity_totals(spark: SparkSession, d: str) -> DataFrame:
    """Findings by severity over all detections, whatever their day."""
    found = detected(spark, d)
    return found.agg(*(F.sum(c).alias(c) for c in ("critical", "high", "medium", "low")))


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, analysed dumps and findings in all."""
    found = suspects(spark, d).groupBy("id").agg(F.count("*").alias("n"))
    return history(spark, d).join(found, "id", "left").agg(
        F.count("*").alias("files"), F.sum("used_heap").alias("bytes"), F.count_if(F.col("status") == "SUCCESS").alias("analysed"), F.sum(F.when(F.col("status") == "SUCCESS", F.coalesce("n", F.lit(0))).otherwise(0)).alias("findings")
    )


_BY_FILE = """by_file AS (SELECT id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total,
 arg_max(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * 1000000 - ordinal) AS max_severity, arg_max(ordinal, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * 1000000 - ordinal) AS max_ordinal FROM suspects GROUP BY id)"""
_DETECTED = f"WITH {HISTORY_SQL}, {SUSPECTS_SQL}, {_BY_FILE}, detected AS (SELECT h.*, b.* EXCLUDE (id), CAST(analyzed_at AS DATE) AS day FROM history h JOIN by_file b USING (id) WHERE status = 'SUCCESS'), e AS (SELECT CAST(max(analyzed_at) AS DATE) AS e FROM history)"
_FOUND = f"{_DETECTED}, found AS (SELECT * FROM detected, e WHERE day BETWEEN e - {DAYS - 1} AND e), days AS (SELECT CAST(unnest(generate_series(e - {DAYS - 1}, e, INTERVAL 1 DAY)) AS DATE) AS day FROM e)"

QUERIES = {
    "severity_by_file": (severity_by_file, f"WITH {SUSPECTS_SQL}, {_BY_FILE} SELECT * FROM by_file"),
    "detections_daily": (daily, f"{_FOUND} SELECT CAST(days.day AS VARCHAR) AS day, count(id) AS detections FROM days LEFT JOIN found USING (day) GROUP BY 1"),
    "detections_by_server": (
        by_server,
        f"""{_FOUND}, c AS (SELECT coalesce(nullif(trim(server_name), ''), 'Local') AS server, day, count(*) AS n FROM found GROUP BY 1, 2),
 r AS (SELECT server, row_number() OVER (ORDER BY sum(n) DESC, server) AS rn FROM c GROUP BY server),
 g AS (SELECT CASE WHEN rn <= {TOP_SERVERS} THEN server ELSE 'others' END AS series, day, sum(n) AS n FROM c JOIN r USING (server) GROUP BY 1, 2)
 SELECT s.series, CAST(days.day AS VARCHAR) AS day, CAST(coalesce(g.n, 0) AS BIGINT) AS detections FROM (SELECT DISTINCT series FROM g) s CROSS JOIN days LEFT JOIN g ON g.series = s.series AND g.day = days.day""",
    ),
    "detections_by_severity": (by_severity, f"{_FOUND} SELECT CAST(day AS VARCHAR) AS day, max_severity, count(*) AS detections FROM found GROUP BY 1, 2"),
    "detections_kpi": (
        kpi,
        f"""{_FOUND}, s AS (SELECT days.day, count(id) AS n FROM days LEFT JOIN found USING (day) GROUP BY 1),
 a AS (SELECT sum(n) AS total, coalesce(sum(n) FILTER ((SELECT e FROM e) - day < 7), 0) AS last7, coalesce(sum(n) FILTER ((SELECT e FROM e) - day BETWEEN 7 AND 13), 0) AS prev7, max(n) AS peak FROM s)
 SELECT CAST(total AS BIGINT) AS total, CAST(last7 AS BIGINT) AS last7, CAST(prev7 AS BIGINT) AS prev7, CASE WHEN prev7 > 0 THEN CAST(floor((last7 - prev7) * 100.0 / prev7 + 0.5) AS BIGINT) END AS delta_percent,
 CASE WHEN peak > 0 THEN (SELECT CAST(min(day) AS VARCHAR) FROM s WHERE n = peak) END AS peak_day, peak FROM a""",
    ),
    "detections_recent": (recent, f"{_FOUND} SELECT id, filename, server_name, max_severity, max_ordinal, total FROM found ORDER BY CASE max_severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, analyzed_at DESC, id LIMIT {RECENT}"),
    "detections_day": (day_files, f"{_DETECTED} SELECT id, CAST(day AS VARCHAR) AS day, critical, high, total AS findings FROM detected, e WHERE day BETWEEN e - 29 AND e"),
    "severity_totals": (severity_totals, f"{_DETECTED} SELECT CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low FROM detected"),
    "dashboard": (dashboard, f"WITH {HISTORY_SQL}, {SUSPECTS_SQL}, n AS (SELECT id, count(*) AS n FROM suspects GROUP BY id) SELECT count(*) AS files, CAST(sum(used_heap) AS BIGINT) AS bytes, count(*) FILTER (status = 'SUCCESS') AS analysed, CAST(sum(CASE WHEN status = 'SUCCESS' THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS findings FROM history LEFT JOIN n USING (id)"),
}
