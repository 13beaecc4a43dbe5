"""Time-driven state: limiter, transfer states, progress, duplicates and windows, in batch and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.sources.tables import load

LIMIT, WINDOW_SECONDS = 2, 24 * 3600
#: Lines of a progress log that are kept.
LOG_LINES = 500


def accepted(calls: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The accepted ones of ``key, t, id`` (t in microseconds): at most ``limit`` of a key within the window, both ends of
    which count. Rejected ones do not count, so what is accepted depends on earlier decisions. Keys are sorted inside
    partitions and a task only holds the last accepted times of the key that it is at, however many calls a key has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = object(), deque(maxlen=limit)
        for batch in batches:
            keep = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != at:
                    at, taken = key, deque(maxlen=limit)
                keep.append(len(taken) < limit or taken[0] < t - window_seconds * 1_000_000)
                if keep[-1]:
                    taken.append(t)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = calls.select("key", "t", "id")
    return rows.repartition("key").sortWithinPartitions("key", "t", "id").mapInArrow(run, rows.schema)


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Accepted events of each user: at most two within a day."""
    calls = load(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("t"), F.col("event_id").alias("id"))
    return accepted(calls).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"))


def transfer_states(rows: DataFrame) -> DataFrame:
    """The state of each transfer after ``key, at, state`` in order: it begins with the first IN_PROGRESS and ends with the
    first SUCCESS or FAILED after that; everything else changes nothing."""
    w = Window.partitionBy("key")
    begun = F.min(F.when(F.col("state") == "IN_PROGRESS", F.col("at"))).over(w)
    own = rows.withColumn("begun", begun).where(F.col("at") >= F.col("begun"))
    ends = F.col("state").isin("SUCCESS", "FAILED")
    return own.groupBy("key").agg(F.coalesce(F.min_by("state", F.when(ends, F.col("at"))), F.lit("IN_PROGRESS")).alias("state"), F.min("begun").alias("begun"), F.min(F.when(ends, F.col("at"))).alias("ended"))


def transfer_state(spark: SparkSession, d: str) -> DataFrame:
    """States of transfers, one per user and day, from their events."""
    state = F.when(F.col("event_id") % 7 == 0, "SUCCESS").when(F.col("event_type") == "error", "FAILED").otherwise("IN_PROGRESS")
    key = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyyMMdd"))
    return transfer_states(load(spark, d, "events").select(key.alias("key"), F.unix_micros("ts").alias("at"), state.alias("state")))


def progress_monotone(spark: SparkSession, d: str) -> DataFrame:
    """Progress that never goes back: the highest phase so far, and the highest percent within it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = load(spark, d, "events").withColumn("best", F.max(F.struct((F.col("event_id") % 100 / 25).cast("int").alias("phase"), F.col("value"))).over(w))
    return rows.select("event_id", "user_id", F.col("best.phase").alias("phase"), F.col("best.value").alias("progress"))


def progress_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest state of each user and how many of its last 500 lines are errors."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = load(spark, d, "events").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= LOG_LINES)
    return rows.groupBy("user_id").agg(F.min_by("event_id", "rn").alias("event_id"), F.count("*").alias("lines"), F.count_if(F.col("event_type") == "error").alias("errors"))


def sessions_open(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last event, with the time that a session lasts, reaches beyond the end of the stream."""
    rows = load(spark, d, "events")
    end = rows.agg(F.max("ts").alias("now"))
    last = rows.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.crossJoin(F.broadcast(end)).where(F.unix_micros("last") + F.lit(6 * 3600 * 1_000_000) > F.unix_micros("now")).select("user_id")


def scan_pending(spark: SparkSession, d: str) -> DataFrame:
    """Parts of line items of 1995, as scanned files, that no line item of 1996, as transfers, has brought."""
    items = load(spark, d, "lineitem")
    of = lambda year: items.where(F.year("l_shipdate") == year).select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("server")).distinct()
    return of(1995).join(of(1996), ["file", "server"], "left_anti")


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Extra: events by hour and type."""
    rows = load(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return rows.select(F.col("w.start").cast("string").alias("hour"), "event_type", "n", "cents")


def tumbling_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same over a stream with late events up to ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def dedup_stream(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First row of each key within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def append_new(rows: DataFrame, target: str, keys: list[str], part: str) -> None:
    """Append rows whose key the table at ``target`` does not hold yet. The table is partitioned by ``part``, which a key
    determines, so only the partitions of these rows are read."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    if _exists(spark, target):
        known = spark.read.parquet(target)
        touched = fresh.select(part).distinct()
        fresh = fresh.join(known.join(touched, part, "left_semi").select(*keys), keys, "left_anti")
    fresh.write.mode("append").partitionBy(part).parquet(target)


def ingest(source: DataFrame, target: str, keys: list[str], part: str, checkpoint: str, every: str | None = None):
    """Append the new rows of a stream to a table; returns the started query. With ``every`` it goes on at that interval,
    else it ends when all that is there has been taken."""
    writer = source.writeStream.foreachBatch(lambda rows, _: append_new(rows, target, keys, part)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


QUERIES = {
    "rate_limit": (
        rate_limit,
        f"""WITH c AS (SELECT user_id, list({{'t': epoch_us(ts), 'e': event_id}} ORDER BY ts, event_id) AS calls FROM events GROUP BY user_id),
 f AS (SELECT user_id, list_reduce(list_prepend(CAST([] AS STRUCT(t BIGINT, e BIGINT)[]), list_transform(calls, lambda x: [x])), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.t >= x[1].t - {WINDOW_SECONDS * 1000000})) < {LIMIT} THEN list_concat(a, x) ELSE a END) AS a FROM c)
 SELECT user_id, unnest(a).e AS event_id FROM f""",
    ),
    "transfer_state": (
        transfer_state,
        """WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y%m%d') AS key, epoch_us(ts) AS us, CASE WHEN event_id % 7 = 0 THEN 'SUCCESS' WHEN event_type = 'error' THEN 'FAILED' ELSE 'IN_PROGRESS' END AS state FROM events),
 b AS (SELECT key, min(us) AS begun FROM e WHERE state = 'IN_PROGRESS' GROUP BY 1) SELECT e.key, coalesce(min_by(state, us) FILTER (state <> 'IN_PROGRESS'), 'IN_PROGRESS') AS state, min(begun) AS begun, min(us) FILTER (state <> 'IN_PROGRESS') AS ended FROM e JOIN b ON e.key = b.key AND us >= begun GROUP BY 1""",
    ),
    "progress_monotone": (progress_monotone, "WITH e AS (SELECT event_id, user_id, ts, value, CAST(floor(event_id % 100 / 25) AS INTEGER) AS p, max(CAST(floor(event_id % 100 / 25) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS phase FROM events) SELECT event_id, user_id, phase, max(CASE WHEN p = phase THEN value END) OVER (PARTITION BY user_id, phase ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM e"),
    "progress_latest": (progress_latest, f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, min_by(event_id, rn) AS event_id, count(*) AS lines, count(*) FILTER (event_type = 'error') AS errors FROM r WHERE rn <= {LOG_LINES} GROUP BY 1"),
    "sessions_open": (sessions_open, "SELECT user_id FROM events GROUP BY 1 HAVING epoch_us(max(ts)) + 21600000000 > epoch_us((SELECT max(ts) FROM events))"),
    "scan_pending": (scan_pending, "SELECT DISTINCT l_partkey AS file, l_suppkey AS server FROM lineitem WHERE year(l_shipdate) = 1995 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate) = 1996"),
    "events_tumbling": (events_tumbling, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2"),
}
