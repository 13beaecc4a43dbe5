"""Stored records: history pages, transfers, logins, sessions and chats, with search, counts and latest rows."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.functions.scalars import format_bytes
from cinderlens.plans.views import HISTORY_SQL, TRANSFERS_SQL, history, transfers
from cinderlens.sources.tables import load


#: Characters of a chat that are sent; fixed value.
CHAT_CHARS = 24_000


def matching(rows: DataFrame, criteria: list[Column | None]) -> DataFrame:
    """Rows that meet every criterion that is given."""
    return rows.where(reduce(lambda a, b: a & b, [c for c in criteria if c is not None], F.lit(True)))


def contains_any(query: str, *fields: str) -> Column | None:
    """A pattern search in any field; ``%`` and ``_`` in the query stay wildcards. A blank query is no criterion."""
    if not query.strip():
        return None
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).like(f"%{query.strip().lower()}%") for f in fields])


def in_days(field: str, first: str | None, last: str | None) -> Column | None:
    """From the start of the first day to the end of the last one; a day that is blank or no date is no criterion."""

    def day(x: str | None) -> date | None:
        try:
            return date.fromisoformat((x or "").strip())
        except ValueError:
            return None

    since, until = day(first), day(last)
    bounds = [F.col(field) >= F.lit(since).cast("timestamp")] if since else []
    bounds += [F.col(field) < F.lit(until + timedelta(days=1)).cast("timestamp")] if until else []
    return reduce(lambda a, b: a & b, bounds) if bounds else None


def is_state(field: str, state: str | None, known: tuple[str, ...]) -> Column | None:
    """One of the known states, in any case; anything else is no criterion."""
    wanted = (state or "").strip().upper()
    return F.col(field) == wanted if wanted in known else None


#: States of transfers and of logins; fixed values.
TRANSFER_STATES, LOGIN_STATES = ("IN_PROGRESS", "SUCCESS", "FAILED"), ("SUCCESS", "FAILURE")


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page with the number of all rows; sizes are kept within 1 to 100."""
    size = min(max(size, 1), 100)
    total = rows.agg(F.count("*").alias("total_rows"))
    # total is one row
    return rows.orderBy(*order).offset(max(number, 0) * size).limit(size).crossJoin(F.broadcast(total))


def history_page(spark: SparkSession, d: str) -> DataFrame:
    """Third page of finished analyses whose file is still there, newest first."""
    rows = history(spark, d).where(F.col("status").isin("SUCCESS", "ERROR") & ~F.col("file_deleted"))
    return page(rows, 2, 20, F.desc("analyzed_at"), F.col("id")).select("id", "filename", "status", "server_name", "total_rows")


def history_counts(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "SUCCESS").alias("success"), F.count_if(F.col("status") == "ERROR").alias("error"), F.count_if("file_deleted").alias("deleted"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("server_name").where("server_name IS NOT NULL").distinct().orderBy("server_name")


def history_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows joined in full with the files on disk (dumps with line items): provenance and sizes of both."""
    files = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("file_size"))
    # customers with a debt have lost their records
    stored = history(spark, d).join(load(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("owner")), "owner", "left_anti")
    rows = stored.join(files, F.col("id") == F.col("file_id"), "full")
    origin = F.when(F.col("id").isNull(), "file").when(F.col("file_id").isNull(), "stored").otherwise("both")
    return rows.select(F.coalesce("id", "file_id").alias("id"), origin.alias("origin"), F.coalesce("status", F.lit("NOT_ANALYZED")).alias("status"), F.coalesce("file_size", F.lit(0)).alias("file_size"), F.coalesce("used_heap", F.lit(0)).alias("used_heap"))


def transfer_search(spark: SparkSession, d: str, query: str = "dump_1", state: str = "failed", first: str = "2024-01-05", last: str = "2024-01-19") -> DataFrame:
    """Transfers of a state in a range of days whose name holds the pattern."""
    rows = matching(transfers(spark, d), [contains_any(query, "filename"), is_state("status", state, TRANSFER_STATES), in_days("started_at", first, last)])
    return rows.select("id", "server_id", "filename", "status", "file_size")


def transfer_stats(spark: SparkSession, d: str) -> DataFrame:
    return transfers(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "SUCCESS").alias("success"), F.count_if(F.col("status") == "FAILED").alias("failed"))


def transfer_page(spark: SparkSession, d: str) -> DataFrame:
    return page(transfers(spark, d), 1, 50, F.desc("started_at"), F.col("id")).select("id", "filename", "status", "total_rows")


def transfer_items(spark: SparkSession, d: str) -> DataFrame:
    """Transfers with server names and durations; the servers of users beyond the last nation are gone and get a label."""
    nation = load(spark, d, "nation")
    # a user's server by its number, of which only some are left
    rows = transfers(spark, d).withColumn("server_id", F.col("username") % 40).join(nation, F.col("server_id") == F.col("n_nationkey"), "left")
    ms = F.expr("(unix_micros(completed_at) - unix_micros(started_at)) div 1000")
    return rows.select("id", F.coalesce("n_name", F.concat(F.lit("(deleted server "), F.col("server_id").cast("string"), F.lit(")"))).alias("server"), ms.alias("duration_ms"))


def latest_transfer(spark: SparkSession, d: str) -> DataFrame:
    """The newest successful transfer of each file."""
    w = Window.partitionBy("filename").orderBy(F.desc("started_at"), F.desc("id"))
    return transfers(spark, d).where(F.col("status") == "SUCCESS").withColumn("at", F.row_number().over(w)).where("at = 1").select("filename", "id", "server_id", "file_size")


def server_detail(spark: SparkSession, d: str) -> DataFrame:
    """Counts over the newest hundred transfers of each server."""
    w = Window.partitionBy("server_id").orderBy(F.desc("started_at"), F.desc("id"))
    rows = transfers(spark, d).withColumn("at", F.row_number().over(w)).where("at <= 100")
    return rows.groupBy("server_id").agg(F.count("*").alias("transfers"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.sum("file_size").alias("bytes"))


def history_server_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Servers of stored rows without one, from the newest successful transfer of the row's file."""
    named = latest_transfer(spark, d).join(F.broadcast(load(spark, d, "nation")), F.col("server_id") == F.col("n_nationkey")).select(F.col("filename").alias("file"), F.col("n_name").alias("from_transfer"))
    rows = history(spark, d).join(named, F.concat(F.lit("dump_"), (F.col("id") % 500).cast("string"), F.lit(".hprof")) == F.col("file"), "left")
    return rows.select("id", F.coalesce("server_name", "from_transfer").alias("server_name"))


def login_search(spark: SparkSession, d: str, query: str = "1", state: str = "FAILURE") -> DataFrame:
    rows = load(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS"))
    return matching(rows, [contains_any(query, "user_id"), is_state("status", state, LOGIN_STATES)]).select("event_id", "user_id", "status")


#: Percent of a disk in use from which on it is a warning; fixed value.
DISK_WARNING = 90


def disk_usage(disks: DataFrame, warning: float = DISK_WARNING) -> DataFrame:
    """``id, usage_percent, total, usable, usable_bytes, warning`` of ``id, total, usable``: percent in use with one decimal;
    the warning goes by the exact share. A disk without a size is not in use."""
    used = F.when(F.col("total") > 0, (F.col("total") - F.col("usable")) / F.col("total") * 100).otherwise(F.lit(0.0))
    return disks.select("id", (F.floor(used * 10 + 0.5) / 10.0).alias("usage_percent"), format_bytes(F.col("total")).alias("total"), format_bytes(F.col("usable")).alias("usable"), F.col("usable").alias("usable_bytes"), (used >= warning).alias("warning"))


def session_rows(sessions: DataFrame, users: DataFrame, logins: DataFrame, now: Column, current: str) -> DataFrame:
    """Open sessions with their users and last successful logins: ``session_id, username, display_name, role, ip, login_at,
    idle_seconds, is_current``. ``sessions``: ``session_id, username, last_access, expiry``; ``logins``: ``session_id, status, ip,
    login_at``; ``users``: ``username, display_name, role``. A user who is gone leaves name and role empty."""
    last = logins.where("status = 'SUCCESS'").groupBy("session_id").agg(F.max_by(F.struct("ip", "login_at"), "login_at").alias("l"))
    rows = sessions.where(F.col("username").isNotNull() & (F.col("expiry") > now)).join(users, "username", "left").join(last, "session_id", "left")
    idle = F.greatest(F.floor((F.unix_micros(now) - F.unix_micros("last_access")) / 1_000_000), F.lit(0))
    return rows.select("session_id", "username", "display_name", "role", F.col("l.ip").alias("ip"), F.date_format("l.login_at", "yyyy-MM-dd HH:mm:ss").alias("login_at"), idle.cast("long").alias("idle_seconds"), F.coalesce(F.col("session_id") == current, F.lit(False)).alias("is_current"))


def session_query(spark: SparkSession, d: str) -> DataFrame:
    """A session per user and day that lasts a day after its last event; users of customers by number, of whom every third
    is gone."""
    rows = load(spark, d, "events").withColumn("session_id", F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), F.dayofyear("ts").cast("string")))
    end = load(spark, d, "events").agg(F.max("ts").alias("now"))
    # one row
    sessions = rows.groupBy("session_id", F.col("user_id").alias("username")).agg(F.max("ts").alias("last_access")).withColumn("expiry", F.col("last_access") + F.expr("INTERVAL 1 DAY")).crossJoin(F.broadcast(end))
    users = load(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("username"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("role"))
    logins = rows.select("session_id", F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("status"), F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string")).alias("ip"), F.col("ts").alias("login_at"))
    return session_rows(sessions, users, logins, F.col("now"), "s7-30")


def disk_query(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return disk_usage(load(spark, d, "supplier").select(k.alias("id"), F.when(k % 9 == 0, 0).otherwise(k * 1_000_003).alias("total"), F.when(k % 9 == 0, 0).otherwise(k * 10_007 * (k % 100)).alias("usable")))


def active_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The latest successful event of each user with the idle time to the end of the stream, and whether a failure is newer."""
    rows = load(spark, d, "events")
    ok = F.col("event_type") != "error"
    per = rows.groupBy("user_id").agg(F.max(F.when(ok, F.struct("ts", "event_id", "event_type"))).alias("last"), F.max(F.when(~ok, F.col("ts"))).alias("failed"))
    end = rows.agg(F.max("ts").alias("now"))
    idle = F.greatest(F.unix_seconds("now") - F.unix_seconds("last.ts"), F.lit(0))
    return per.where("last IS NOT NULL").crossJoin(F.broadcast(end)).select("user_id", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"), idle.alias("idle_seconds"), F.coalesce(F.col("failed") > F.col("last.ts"), F.lit(False)).alias("failure_is_newer"))


def chat_search(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose title or any message holds the text; wildcards in it are plain characters."""
    turns = load(spark, d, "conversations")
    pattern = "%" + "100%".replace("|", "||").replace("%", "|%").replace("_", "|_") + "%"
    hit = F.expr(f"lower(text) LIKE '%the a%' OR text LIKE '{pattern}' ESCAPE '|'")
    return turns.groupBy("conv_id").agg(F.max(hit).alias("hit"), F.count("*").alias("messages")).where("hit").select("conv_id", "messages")


def chat_titles(spark: SparkSession, d: str) -> DataFrame:
    """The first user message's first forty characters."""
    first = load(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("..."))).otherwise(F.col("text")).alias("title"))


def chat_trim(spark: SparkSession, d: str) -> DataFrame:
    """The last messages of each session that fit the limit together; always the last one."""
    after = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    rows = load(spark, d, "conversations").withColumn("held", F.sum(F.length("text")).over(after)).withColumn("back", F.count("*").over(after))
    return rows.where((F.col("held") <= CHAT_CHARS) | (F.col("back") == 1)).select("conv_id", "turn", "held")


def append_last_user(spark: SparkSession, d: str) -> DataFrame:
    """A note appended to the last user message of each session."""
    w = Window.partitionBy("conv_id")
    rows = load(spark, d, "conversations").withColumn("last", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w))
    return rows.select("conv_id", "turn", F.when(F.col("turn") == F.col("last"), F.concat("text", F.lit("\n\nNote."))).otherwise(F.col("text")).alias("text"))


def compare_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys of comparisons of neighbouring dumps."""
    rows = history(spark, d)
    other = F.concat(F.lit("dump_"), (F.col("id") + 1).cast("string"))
    return rows.select("id", F.concat(F.lit("__compare__:"), F.substring(F.sha2(F.concat("filename", F.lit("|"), other), 256), 1, 40)).alias("key"))


_H, _T = f"WITH {HISTORY_SQL}", f"WITH {TRANSFERS_SQL}"
_LATEST = "latest AS (SELECT filename, id, server_id, file_size FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY started_at DESC, id DESC) AS rn FROM transfers WHERE status = 'SUCCESS') WHERE rn = 1)"
QUERIES = {
    "history_page": (history_page, f"{_H}, r AS (SELECT * FROM history WHERE status IN ('SUCCESS', 'ERROR') AND NOT file_deleted) SELECT id, filename, status, server_name, (SELECT count(*) FROM r) AS total_rows FROM r ORDER BY analyzed_at DESC, id LIMIT 20 OFFSET 40"),
    "history_counts": (history_counts, f"{_H} SELECT count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'ERROR') AS error, count(*) FILTER (file_deleted) AS deleted FROM history"),
    "status_counts": (status_counts, f"{_H} SELECT status, count(*) AS n FROM history GROUP BY status"),
    "distinct_users": (distinct_users, f"{_H} SELECT DISTINCT server_name FROM history WHERE server_name IS NOT NULL"),
    "history_assembly": (
        history_assembly,
        f"""{_H}, f AS (SELECT l_orderkey AS file_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS file_size FROM lineitem GROUP BY 1), s AS (SELECT * FROM history WHERE owner NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
 SELECT coalesce(id, file_id) AS id, CASE WHEN id IS NULL THEN 'file' WHEN file_id IS NULL THEN 'stored' ELSE 'both' END AS origin, coalesce(status, 'NOT_ANALYZED') AS status, coalesce(file_size, 0) AS file_size, coalesce(used_heap, 0) AS used_heap FROM s FULL JOIN f ON id = file_id""",
    ),
    "session_rows": (
        session_query,
        """WITH r AS (SELECT *, 's' || user_id || '-' || dayofyear(ts) AS sid FROM events), n AS (SELECT max(ts) AS now FROM events), s AS (SELECT sid, user_id, max(ts) AS last FROM r GROUP BY 1, 2), l AS (SELECT sid, max_by(event_id, ts) AS e, max(ts) AS at_ FROM r WHERE event_type <> 'error' GROUP BY 1)
 SELECT s.sid AS session_id, user_id AS username, c_name AS display_name, c_mktsegment AS role, '10.0.0.' || e % 250 AS ip, strftime(at_, '%Y-%m-%d %H:%M:%S') AS login_at, greatest((epoch_us(now) - epoch_us(last)) // 1000000, 0) AS idle_seconds, s.sid = 's7-30' AS is_current
 FROM s JOIN n ON last + INTERVAL 1 DAY > now LEFT JOIN l ON l.sid = s.sid LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 3 <> 0""",
    ),
    "disk_usage": (
        disk_query,
        "WITH d AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE s_suppkey * 1000003 END AS t, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE s_suppkey * 10007 * (s_suppkey % 100) END AS u FROM supplier), p AS (SELECT *, CASE WHEN t > 0 THEN (t - u) / t * 100 ELSE 0 END AS p FROM d) SELECT id, floor(p * 10 + 0.5) / 10.0 AS usage_percent, "
        + ", ".join(f"CASE WHEN {c} <= 0 THEN '0 B' WHEN {c} < 1024 THEN {c} || ' B' WHEN {c} < 1048576 THEN printf('%.1f', round({c} / 1024.0, 1)) || ' KB' WHEN {c} < 1073741824 THEN printf('%.2f', round({c} / 1048576.0, 2)) || ' MB' ELSE regexp_replace(printf('%.2f', round({c} / 1073741824.0, 2)), '\\.?0+$', '') || ' GB' END AS {n}" for c, n in (("t", "total"), ("u", "usable")))
        + f", u AS usable_bytes, p >= {DISK_WARNING} AS warning FROM p",
    ),
    "transfer_search": (transfer_search, f"{_T} SELECT id, server_id, filename, status, file_size FROM transfers WHERE lower(filename) LIKE '%dump_1%' AND status = 'FAILED' AND started_at >= '2024-01-05' AND started_at < '2024-01-20'"),
    "transfer_stats": (transfer_stats, f"{_T} SELECT count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed FROM transfers"),
    "transfer_page": (transfer_page, f"{_T} SELECT id, filename, status, (SELECT count(*) FROM transfers) AS total_rows FROM transfers ORDER BY started_at DESC, id LIMIT 50 OFFSET 50"),
    "transfer_items": (transfer_items, f"{_T} SELECT id, coalesce(n_name, '(deleted server ' || username % 40 || ')') AS server, (epoch_us(completed_at) - epoch_us(started_at)) // 1000 AS duration_ms FROM transfers LEFT JOIN nation ON username % 40 = n_nationkey"),
    "latest_transfer": (latest_transfer, f"{_T}, {_LATEST} SELECT * FROM latest"),
    "server_detail": (server_detail, f"{_T} SELECT server_id, count(*) AS transfers, count(*) FILTER (status = 'FAILED') AS failed, CAST(sum(file_size) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY started_at DESC, id DESC) AS rn FROM transfers) WHERE rn <= 100 GROUP BY server_id"),
    "history_server_backfill": (history_server_backfill, f"{_H}, {TRANSFERS_SQL}, {_LATEST}, n AS (SELECT filename AS file, n_name AS from_transfer FROM latest JOIN nation ON server_id = n_nationkey) SELECT id, coalesce(server_name, from_transfer) AS server_name FROM history LEFT JOIN n ON file = 'dump_' || id % 500 || '.hprof'"),
    "login_search": (login_search, "SELECT event_id, user_id, 'FAILURE' AS status FROM events WHERE event_type = 'error' AND CAST(user_id AS VARCHAR) LIKE '%1%'"),
    "active_sessions": (active_sessions, """SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (event_type <> 'error') AS event_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'error') AS event_type,
 greatest(epoch_us((SELECT max(ts) FROM events)) // 1000000 - epoch_us(max(ts) FILTER (event_type <> 'error')) // 1000000, 0) AS idle_seconds, coalesce(max(ts) FILTER (event_type = 'error') > max(ts) FILTER (event_type <> 'error'), false) AS failure_is_newer FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'error') > 0"""),
    "chat_search": (chat_search, "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id HAVING bool_or(lower(text) LIKE '%the a%' OR contains(text, '100%'))"),
    "chat_titles": (chat_titles, "SELECT conv_id, CASE WHEN length(t) > 40 THEN t[:40] || '...' ELSE t END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)"),
    "chat_trim": (chat_trim, "SELECT conv_id, turn, CAST(held AS BIGINT) AS held FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS held, count(*) OVER w AS back FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE held <= 24000 OR back = 1"),
    "append_last_user": (append_last_user, "SELECT conv_id, turn, CASE WHEN turn = max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) THEN text || chr(10) || chr(10) || 'Note.' ELSE text END AS text FROM conversations"),
    "compare_key": (compare_key, f"{_H} SELECT id, '__compare__:' || sha256(filename || '|' || 'dump_' || (id + 1))[:40] AS key FROM history"),
}
