"""Files, sinks and streams on small folders."""

import csv
import json
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from cinderlens.sources import files, sinks
from cinderlens.sources.versioned import VersionedTable
from cinderlens.streaming import ingest


def test_dump_listing(spark, tmp_path):
    for name in ("a.hprof", "a.hprof.gz", "b.BIN", ".hidden.hprof", "notes.txt", "c.dump.gz"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    rows = files.dump_files(files.listing(spark, str(tmp_path))).collect()
    assert {(r["shown"], r["packed"], r["size"]) for r in rows} == {("a.hprof", False, 7), ("b.BIN", False, 5), ("c.dump", True, 9)}
    assert sorted(r["place"] for r in rows) == [1, 2, 3]


def test_archives_and_their_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d1_System_Overview.zip", "w") as z:
        z.writestr("pages/Class_Histogram1.html", "<p>h</p>")
        z.writestr("Class_Histogram0.html", "<p>other</p>")
        z.writestr("style.css", "x")
        z.writestr("index.html", "<p>é index</p>")
    with zipfile.ZipFile(tmp_path / "d1_Top_Components.zip", "w") as z:
        z.writestr("x.html", "<p>" + "long" * 99 + "</p>")
        z.writestr("pages/Top_Consumers2.html", "<p>2</p>")
        z.writestr("pages/Top_Consumers10.html", "<p>large</p>")
    (tmp_path / "broken_Leak_Suspects.zip").write_bytes(b"no archive")
    entries = files.pages(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1))
    assert {(r["path"], r["entry"]) for r in files.main_page(entries).collect()} == {("d1_System_Overview.zip", "index.html"), ("d1_Top_Components.zip", "pages/Top_Consumers10.html")}
    assert [(r["entry"], r["html"]) for r in files.named_page(entries, "class_histogram").collect()] == [("pages/Class_Histogram1.html", "<p>h</p>")]
    assert {r["entry"] for r in files.first_page(entries).collect()} == {"pages/Class_Histogram1.html", "x.html"}
    found = files.archives(files.listing(spark, str(tmp_path)).withColumn("base", F.lit("d1"))).collect()
    assert {(r["kind"], r["path"].rsplit("/", 1)[1]) for r in found} == {("overview", "d1_System_Overview.zip"), ("components", "d1_Top_Components.zip")}


def test_lines_around_a_place(spark, tmp_path):
    (tmp_path / "a.c").write_text("\n".join(f"line {k}" for k in range(1, 21)))
    places = spark.createDataFrame([(1, "a.c", 2), (2, "a.c", 20), (3, "b.c", 1)], "id int, file string, number int")
    got = files.context_lines(files.numbered_lines(spark, str(tmp_path)), places, 2).collect()
    assert {(r["id"], r["number"], r["line"], r["marked"]) for r in got} == {(1, k, f"line {k}", k == 2) for k in (1, 2, 3, 4)} | {(2, k, f"line {k}", k == 20) for k in (18, 19, 20)}


SCHEMA = "filename string, status string, analyzed_at int, log string"


def test_upsert_keeps_the_first_time_of_what_went_well(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "filename", buckets=4)
    table.merge(spark.createDataFrame([("a", "SUCCESS", 1, "x"), ("b", "ERROR", 2, "y"), ("c", "SUCCESS", 3, "z")], SCHEMA))
    sinks.upsert_into(table, spark.createDataFrame([("a", "SUCCESS", 9, "n"), ("b", "SUCCESS", 9, "n"), ("d", "ERROR", 9, "n")], SCHEMA))
    assert {tuple(r) for r in table.read().collect()} == {("a", "SUCCESS", 1, "n"), ("b", "SUCCESS", 9, "n"), ("c", "SUCCESS", 3, "z"), ("d", "ERROR", 9, "n")}
    assert sinks.insert_missing(table.read(), spark.createDataFrame([("a", "", 0, ""), ("e", "", 0, ""), ("e", "", 0, "")], SCHEMA)).count() == 1


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "x", y'), (2, "two\nlines"), (3, None)], "id int, text string")
    assert sinks.export_csv(rows, str(tmp_path / "csv"), ["id"]) is False
    assert sinks.export_csv(rows, str(tmp_path / "cut"), ["id"], 2) is True
    (part,) = (tmp_path / "csv").glob("*.csv")
    with part.open(newline="") as f:
        assert list(csv.reader(f)) == [["id", "text"], ["1", 'say "x", y'], ["2", "two\nlines"], ["3", ""]]
    sinks.export_json(rows, str(tmp_path / "json"), ["id"])
    (part,) = (tmp_path / "json").glob("*.json")
    assert [json.loads(x)["id"] for x in part.read_text().splitlines()] == [1, 2, 3]


def test_sidecars_and_results(spark, tmp_path):
    rows = spark.createDataFrame([("a", [], []), ("b", [], [1]), ("c", None, [])], "filename string, x array<int>, y array<int>")
    assert sinks.write_sidecar(rows.where("filename <> 'b'"), str(tmp_path / "s"), ["x", "y"]) == 0 and not (tmp_path / "s").exists()
    assert sinks.write_sidecar(rows, str(tmp_path / "s"), ["x", "y"]) == 1
    assert [r["filename"] for r in sinks.results(spark, str(tmp_path / "s")).read().collect()] == ["b"]
    sinks.write_results(spark.createDataFrame([(f"d{i}", "SUCCESS", i, "long log") for i in range(100)], SCHEMA), str(tmp_path / "r"))
    sinks.write_results(spark.createDataFrame([("d7", "ERROR", 8, "log")], SCHEMA), str(tmp_path / "r"))
    table = sinks.results(spark, str(tmp_path / "r"))
    assert table.read().count() == 100 and "log" not in table.read().columns
    assert [r["status"] for r in table.get("d7").collect()] == ["ERROR"]
    # buckets, not a folder for each dump
    assert len({p.parent for p in (tmp_path / "r" / "data").rglob("*.json.gz")}) <= 17


def test_deletes_and_fills(spark):
    chats = spark.createDataFrame([(1, "a"), (2, "b")], "chat_id int, filename string")
    messages = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "chat_id int, text string")
    left = sinks.deleted({"chats": chats, "messages": messages, "history": chats}, spark.createDataFrame([("b",)], "filename string"))
    assert {k: v.count() for k, v in left.items()} == {"chats": 1, "messages": 1, "history": 1}
    assert [r["b"] for r in sinks.filled(spark.createDataFrame([("x", None), ("x", "y")], "a string, b string"), "b", "a").collect()] == ["x", "y"]


EVENTS = "id long, key string, event_type string, ts timestamp, day string"


def _write(spark, folder, rows):
    spark.createDataFrame([(i, k, "view", datetime(2024, 1, 1, h), "d1") for i, k, h in rows], EVENTS).coalesce(1).write.mode("append").json(folder)


def test_ingest_takes_each_key_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "a", 1), (2, "b", 1), (3, "a", 2)], [(4, "a", 3), (5, "c", 3)]):
        _write(spark, source, rows)
        stream = spark.readStream.schema(EVENTS).json(source)
        ingest.ingest(stream, target, ["key"], "day", str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_streams_drop_duplicates_and_count_by_hour(spark, tmp_path):
    source = str(tmp_path / "in")
    _write(spark, source, [(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "b", 2)])
    stream = spark.readStream.schema(EVENTS).json(source)
    for name, df, mode in (("once", ingest.dedup_stream(stream, ["key"]), "append"), ("hours", ingest.tumbling_stream(stream), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert sorted(r["key"] for r in spark.table("once").collect()) == ["a", "b"]
    assert sorted(r["n"] for r in spark.table("hours").collect()) == [1, 3]


def test_a_limiter_forgets_rejected_calls(spark):
    calls = spark.createDataFrame([("a", t * 1_000_000, t) for t in (0, 1, 2, 59, 60, 61, 62)] + [("b", 5, 9), (None, 5, 10)], "key string, t long, id long")
    got = sorted(r["id"] for r in ingest.accepted(calls, 2, 60).collect())
    # a call that is as old as the window still counts
    assert got == [0, 1, 9, 10, 61, 62]


def test_transfer_states(spark):
    rows = [("a", 1, "SUCCESS"), ("a", 2, "IN_PROGRESS"), ("a", 3, "FAILED"), ("a", 4, "SUCCESS"), ("b", 1, "IN_PROGRESS"), ("c", 1, "FAILED")]
    got = {tuple(r) for r in ingest.transfer_states(spark.createDataFrame(rows, "key string, at long, state string")).collect()}
    assert got == {("a", "FAILED", 2, 3), ("b", "IN_PROGRESS", 1, None)}


