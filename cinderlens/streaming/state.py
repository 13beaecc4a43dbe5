"""Streams with state and timers, and the batch results that they equal.

The limiter keeps the accepted times of a key and drops the key's state when the last of them has left the window. A transfer
keeps when it began; a timer fails it when its end has not come in time. Both run on event time, so a late or repeated event
changes nothing and the stream gives what the batch query gives for the same events.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from cinderlens.sources.tables import load

#: Seconds that a transfer may take; fixed value.
TRANSFER_SECONDS = 600
DONE = ("SUCCESS", "FAILED")
#: Streams with timers keep their state in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def use_state_store(spark: SparkSession) -> None:
    """The settings of streams with timers; to be set before they start."""
    for key, value in STORE.items():
        spark.conf.set(key, value)


class Limiter(StatefulProcessor):
    """At most ``limit`` accepted calls of a key within the window, both of its ends counted; rejected calls do not count."""

    def __init__(self, limit: int, window_micros: int):
        self.limit, self.window = limit, window_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getListState("taken", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        taken = deque(t for (t,) in self.taken.get())
        known = bool(taken)
        out = []
        for r in sorted(rows, key=lambda r: (r["t"], r["id"])):
            while taken and taken[0] < r["t"] - self.window:
                taken.popleft()
            if len(taken) < self.limit:
                taken.append(r["t"])
                out.append(Row(key=key[0], t=r["t"], id=r["id"]))
        if taken:
            self.taken.put([(t,) for t in taken])
            if out or not known:
                self._wake_after(taken[-1])
        yield from out

    def _wake_after(self, last: int) -> None:
        # one timer a key, for the time when its last call has left the window
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.window) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.taken.clear()
        return iter(())

    def close(self) -> None:
        pass


def accepted_stream(calls: DataFrame, limit: int, window_seconds: int, delay: str = "1 minute") -> DataFrame:
    """The accepted calls of a stream ``key, t, id, ts`` (t in microseconds, ts the same as a timestamp). A key without calls
    in its window has no state."""
    return calls.withWatermark("ts", delay).groupBy("key").transformWithState(Limiter(limit, window_seconds * 1_000_000), "key string, t long, id long", "Append", "EventTime")


class Transfers(StatefulProcessor):
    """The states of transfers by key: one row when it begins and one when it ends or is out of time."""

    def __init__(self, limit_micros: int):
        self.limit = limit_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "at long")
        self.over = handle.getValueState("over", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        if self.over.exists():
            return
        begun = self.begun.get()[0] if self.begun.exists() else None
        for r in sorted(rows, key=lambda r: (r["at"], r["state"])):
            if begun is None:
                if r["state"] == "IN_PROGRESS":
                    begun = r["at"]
                    self.begun.update((begun,))
                    self.handle.registerTimer((begun + self.limit) // 1000 + 1)
                    yield Row(key=key[0], state="IN_PROGRESS", begun=begun, ended=None, timed_out=False)
            elif r["state"] in DONE and r["at"] >= begun:
                if r["at"] - begun <= self.limit:
                    self.over.update((r["at"],))
                    yield Row(key=key[0], state=r["state"], begun=begun, ended=r["at"], timed_out=False)
                return

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.over.exists() and self.begun.exists():
            begun = self.begun.get()[0]
            self.over.update((begun + self.limit,))
            yield Row(key=key[0], state="FAILED", begun=begun, ended=begun + self.limit, timed_out=True)

    def close(self) -> None:
        pass


_TRANSFER = "key string, state string, begun long, ended long, timed_out boolean"


def transfer_stream(events: DataFrame, limit_seconds: int = TRANSFER_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Changes of transfers of a stream ``key, at, state, ts``. What is over stays as two numbers of state, so that events
    that come again change nothing."""
    return events.withWatermark("ts", delay).groupBy("key").transformWithState(Transfers(limit_seconds * 1_000_000), _TRANSFER, "Update", "EventTime")


def transfer_ends(rows: DataFrame, limit_seconds: int = TRANSFER_SECONDS, now: int | None = None) -> DataFrame:
    """The state of each transfer after ``key, at, state``: it begins with the first IN_PROGRESS, and ends with the first
    SUCCESS or FAILED after that, in order of time, or as FAILED when ``limit_seconds`` are over before that and before
    ``now`` (the last event unless given)."""
    limit = limit_seconds * 1_000_000
    begun = rows.where("state = 'IN_PROGRESS'").groupBy("key").agg(F.min("at").alias("begun"))
    after = rows.join(begun, "key").where((F.col("at") >= F.col("begun")) & F.col("state").isin(*DONE) & (F.col("at") - F.col("begun") <= limit))
    ends = after.groupBy("key").agg(F.min_by("state", F.struct("at", "state")).alias("end"), F.min("at").alias("at"))
    clock = rows.agg(F.max("at").alias("now")) if now is None else rows.sparkSession.range(1).select(F.lit(now).alias("now"))
    # one row
    out = begun.join(ends, "key", "left").crossJoin(F.broadcast(clock))
    late = F.col("end").isNull() & (F.col("now") > F.col("begun") + limit)
    return out.select("key", F.when(late, "FAILED").otherwise(F.coalesce("end", F.lit("IN_PROGRESS"))).alias("state"), "begun", F.when(late, F.col("begun") + limit).otherwise(F.col("at")).alias("ended"), late.alias("timed_out"))


def last_states(changes: DataFrame) -> DataFrame:
    """The last change of each transfer."""
    w = Window.partitionBy("key").orderBy(F.col("ended").desc_nulls_last())
    return changes.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def transfer_events(spark: SparkSession, d: str) -> DataFrame:
    """Transfers, one per user and two days, from their events: ``key, at, state, ts``."""
    state = F.when(F.col("event_id") % 7 == 0, "SUCCESS").when(F.col("event_type") == "error", "FAILED").otherwise("IN_PROGRESS")
    key = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.floor(F.dayofyear("ts") / 2).cast("string"))
    return load(spark, d, "events").select(key.alias("key"), F.unix_micros("ts").alias("at"), state.alias("state"), "ts")


#: In the query transfers are given longer, as events are hours apart.
QUERY_SECONDS = 8 * 3600
QUERIES = {
    "transfer_ends": (
        lambda s, d: transfer_ends(transfer_events(s, d), QUERY_SECONDS),
        f"""WITH e AS (SELECT user_id || '/' || CAST(floor(dayofyear(ts) / 2) AS BIGINT) AS key, epoch_us(ts) AS us, CASE WHEN event_id % 7 = 0 THEN 'SUCCESS' WHEN event_type = 'error' THEN 'FAILED' ELSE 'IN_PROGRESS' END AS state FROM events),
 b AS (SELECT key, min(us) AS begun FROM e WHERE state = 'IN_PROGRESS' GROUP BY 1), n AS (SELECT max(us) AS now FROM e),
 f AS (SELECT e.key, arg_min(state, (us, state)) AS state, min(us) AS ended FROM e JOIN b ON e.key = b.key AND us BETWEEN begun AND begun + {QUERY_SECONDS * 1000000} AND state <> 'IN_PROGRESS' GROUP BY 1)
 SELECT b.key, CASE WHEN f.key IS NULL AND now > begun + {QUERY_SECONDS * 1000000} THEN 'FAILED' ELSE coalesce(state, 'IN_PROGRESS') END AS state, begun, CASE WHEN f.key IS NULL AND now > begun + {QUERY_SECONDS * 1000000} THEN begun + {QUERY_SECONDS * 1000000} ELSE ended END AS ended, f.key IS NULL AND now > begun + {QUERY_SECONDS * 1000000} AS timed_out FROM b LEFT JOIN f ON f.key = b.key, n""",
    ),
}
