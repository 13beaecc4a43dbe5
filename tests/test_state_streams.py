"""Streams with state against the batch results, over late and repeated events, and restarts."""

from datetime import UTC, datetime

import pytest

from cinderlens.streaming import ingest, polling, state

CALLS = "key string, t long, id long, ts timestamp"
EVENTS = "key string, at long, state string, ts timestamp"


def moment(seconds):
    return datetime.fromtimestamp(seconds, UTC)


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def run(spark, frame, tmp_path, name, mode):
    """All batches that are there, into one folder."""
    state.use_state_store(spark)
    write = lambda rows, _: rows.write.mode("append").parquet(str(tmp_path / name))
    query = frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.fixture
def calls():
    at = [("a", 0), ("a", 10), ("a", 20), ("a", 60), ("a", 61), ("b", 5), ("a", 70), ("a", 71), ("a", 131), ("a", 132), ("c", 400), ("a", 500), ("a", 501), ("a", 502), ("b", 503)]
    return [(k, (1000 + t) * 1_000_000, i, moment(1000 + t)) for i, (k, t) in enumerate(at)]


def test_limiter_equals_batch_and_forgets_idle_keys(spark, tmp_path, calls):
    folder = str(tmp_path / "in")
    for part in (calls[:6], calls[6:10], calls[10:]):
        add(spark, folder, part, CALLS)
        stream = state.accepted_stream(spark.readStream.schema(CALLS).json(folder), 2, 60, "1 second")
        run(spark, stream, tmp_path, "taken", "append")
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "taken")).collect())
    batch = sorted(r["id"] for r in ingest.accepted(spark.createDataFrame(calls, CALLS).select("key", "t", "id"), 2, 60).collect())
    # 60 is still within the window of 0, 61 is not
    assert got == batch and 3 not in got and 4 in got
    # a stream's state tells which keys are left: c has gone with its timer
    held = spark.read.format("statestore").option("path", str(tmp_path / "taken-checkpoint")).option("stateVarName", "taken").load()
    keys = {r["key"]["key"] for r in held.select("key").collect()}
    assert "a" in keys and "c" not in keys


def test_transfers_with_late_and_repeated_events(spark, tmp_path):
    at = [("a", 0.5, "SUCCESS"), ("a", 1, "IN_PROGRESS"), ("b", 2, "IN_PROGRESS"), ("a", 50, "FAILED"), ("a", 50, "FAILED"), ("a", 60, "SUCCESS"), ("c", 90, "IN_PROGRESS"), ("d", 95, "IN_PROGRESS"), ("c", 690, "SUCCESS"), ("d", 696, "SUCCESS"), ("b", 700, "SUCCESS"), ("e", 1500, "IN_PROGRESS"), ("f", 1600, "FAILED")]
    rows = [(k, int(t * 1_000_000), s, moment(t)) for k, t, s in at]  # a stream begins after time 0
    folder = str(tmp_path / "in")
    for part in (rows[:3], rows[3:8], rows[3:4], rows[8:11], rows[11:], [("z", 1_700_000_000, "IN_PROGRESS", moment(1700))]):
        add(spark, folder, part, EVENTS)
        run(spark, state.transfer_stream(spark.readStream.schema(EVENTS).json(folder), 600, "30 seconds"), tmp_path, "states", "update")
    got = {tuple(r) for r in state.last_states(spark.read.parquet(str(tmp_path / "states"))).collect()}
    batch = {tuple(r) for r in state.transfer_ends(spark.createDataFrame([*rows, ("z", 1_700_000_000, "IN_PROGRESS", moment(1700))], EVENTS), 600).collect()}
    s = 1_000_000
    assert batch == {("a", "FAILED", s, 50 * s, False), ("b", "FAILED", 2 * s, 602 * s, True), ("c", "SUCCESS", 90 * s, 690 * s, False), ("d", "FAILED", 95 * s, 695 * s, True), ("e", "IN_PROGRESS", 1500 * s, None, False), ("z", "IN_PROGRESS", 1700 * s, None, False)}
    assert got == batch


def test_only_due_servers_are_listed(spark, tmp_path):
    servers, listing, clock = (str(tmp_path / x) for x in ("servers", "listing", "clock"))
    spark.createDataFrame([(1, 10, True, True), (2, 60, True, True), (3, 10, False, True), (4, 10, True, False), (5, None, True, True)], "server_id long, interval long, enabled boolean, auto_detect boolean").write.parquet(servers)
    spark.createDataFrame([(s, f"f{s}", s, f"/x/f{s}") for s in range(1, 6)], "server_id long, name string, size long, path string").write.partitionBy("server_id").parquet(listing)
    seen = lambda: sorted((r["server_id"], r["turn"]) for r in spark.read.parquet(str(tmp_path / "found")).collect())
    told = []
    for now in (120, 125, 131, 139, 180, 180):
        spark.createDataFrame([(now,)], "now long").write.mode("overwrite").parquet(clock)
        # each run is a restart from the checkpoint
        run(spark, polling.polled(spark, servers, listing, clock=clock), tmp_path, "found", "append")
        told.append(seen())
    first = [(1, 120), (2, 120), (5, 120)]
    assert told[0] == told[1] == first
    assert told[2] == told[3] == sorted([*first, (1, 130)])
    assert told[4] == told[5] == sorted([*first, (1, 130), (1, 180), (2, 180), (5, 180)])
    found = spark.read.parquet(str(tmp_path / "found"))
    done = spark.createDataFrame([(1, "f1", 1, "SUCCESS"), (2, "f2", 2, "FAILED"), (5, "f5", 4, "SUCCESS")], "server_id long, name string, size long, state string")
    assert {r["server_id"] for r in polling.fresh(found, done).collect()} == {2, 5}
