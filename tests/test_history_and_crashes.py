"""History rows, search criteria, sessions, disks, crash warnings and local variables, with cases that the tables lack."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from cinderlens.operators import classify, extract, history, records


def at(hour):
    return datetime(2024, 5, 6, hour, 30, tzinfo=UTC)


def test_each_dump_has_one_row_from_the_first_place_that_knows_it(spark):
    stored = [("a.hprof.gz", 1, "SUCCESS", 2, 61_000, 2048, "WEB", at(1), at(2), 10, 20), ("gone.bin", 2, "ERROR", None, None, None, " ", None, None, None, None)]
    files = [("a.hprof.gz", 1500, at(3), True, 3000, 1500), ("a.hprof.gz", 1, at(1), True, 1, 1), ("new", 5, at(4), False, 0, 0), ("done.hprof", 7, at(5), False, 0, 0)]
    cached = [("a.hprof.gz", "ERROR", 9, 9, 9, 9, at(9)), ("done.hprof", "SUCCESS", 3, 500, 1 << 31, 7, at(5)), ("lost.hprof", "SUCCESS", 1, 0, 0, 1 << 20, at(6)), (None, "SUCCESS", 1, 1, 1, 1, at(7))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = history.assembled(frame(stored, history.STORED), frame(files, history.FILES), frame(cached, history.CACHED), frame([("new", "high")], history.INSIGHTS))
    got = {r["filename"]: r for r in rows.collect()}
    assert {k: (r["origin"], r["status"], r["file_deleted"]) for k, r in got.items()} == {"a.hprof.gz": ("stored", "SUCCESS", False), "gone.bin": ("stored", "ERROR", True), "new": ("file", "NOT_ANALYZED", False), "done.hprof": ("file", "SUCCESS", False), "lost.hprof": ("cache", "SUCCESS", True)}
    a = got["a.hprof.gz"]
    assert (a["size"], a["original_size"], a["compressed_size"], a["original_bytes"], a["analysis_time"], a["heap_used"], a["date"], a["analysis_name"]) == ("1.46 KB", "2.93 KB", "1.46 KB", 3000, "1m 1s", "2.0 KB", "2024-05-06 03:30", "[HPROF]web_a.hprof.gz_20240506")
    gone = got["gone.bin"]
    assert (gone["size"], gone["size_bytes"], gone["date"], gone["last_modified"], gone["heap_used"], gone["analysis_time"], gone["suspect_count"]) == ("-", 0, "-", 0, "-", "-", 0)
    assert (got["new"]["analysis_time"], got["new"]["heap_used"], got["new"]["has_insight"], got["new"]["insight_severity"]) == (None, None, True, "high")
    assert (got["done.hprof"]["analysis_time"], got["done.hprof"]["heap_used"], got["done.hprof"]["suspect_count"]) == ("500ms", "2 GB", 3)
    assert (got["lost.hprof"]["size"], got["lost.hprof"]["date"]) == ("1.00 MB", "2024-05-06 06:30")


def test_criteria_that_say_nothing_are_none(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0), "FAILED"), (2, datetime(2024, 1, 2, 23, 59), "SUCCESS"), (3, datetime(2024, 1, 3, 0, 0), "FAILED")], "id int, t timestamp, s string")
    ids = lambda *c: [r["id"] for r in records.matching(rows, list(c)).orderBy("id").collect()]
    assert ids(records.in_days("t", "2024-01-01", "2024-01-02")) == [1, 2]
    assert ids(records.in_days("t", "no date", "2024-01-01")) == [1]
    assert records.in_days("t", "", "2024-13-01") is None and records.in_days("t", None, None) is None
    assert ids(records.is_state("s", " failed ", records.TRANSFER_STATES)) == [1, 3]
    assert records.is_state("s", "odd", records.TRANSFER_STATES) is None and records.is_state("s", None, records.LOGIN_STATES) is None


def test_sessions_and_disks(spark):
    frame = spark.createDataFrame
    sessions = frame([("x", "ann", at(1), at(9)), ("y", "bob", at(8), at(9)), ("z", None, at(1), at(9)), ("old", "ann", at(1), at(2))], "session_id string, username string, last_access timestamp, expiry timestamp")
    users = frame([("ann", "Ann", "ADMIN")], "username string, display_name string, role string")
    logins = frame([("x", "SUCCESS", "1.1.1.1", at(1)), ("x", "SUCCESS", "2.2.2.2", at(2)), ("x", "FAILURE", "3.3.3.3", at(3))], "session_id string, status string, ip string, login_at timestamp")
    got = {r["session_id"]: tuple(r)[1:] for r in records.session_rows(sessions, users, logins, F.lit(at(7)), "x").collect()}
    assert got == {"x": ("ann", "Ann", "ADMIN", "2.2.2.2", "2024-05-06 02:30:00", 6 * 3600, True), "y": ("bob", None, None, None, None, 0, False)}
    disks = frame([(1, 1000, 101), (2, 1000, 100), (3, 0, 0)], "id int, total long, usable long")
    assert [(r["usage_percent"], r["warning"]) for r in records.disk_usage(disks).orderBy("id").collect()] == [(89.9, False), (90.0, True), (0.0, False)]


def test_damaged_stacks_and_words_on_several_lines(spark):
    lines = spark.createDataFrame([(1, 0, "x .reg-xstate y"), (1, 1, "is too small"), (1, 2, "No shared libraries loaded at this time."), (2, 0, "fine")], "report_id int, pos int, line string")
    framed = spark.createDataFrame([(1, "GARBAGE") for _ in range(60)] + [(1, "RESOLVED") for _ in range(60)] + [(2, "RESOLVED")], "report_id int, quality string")
    libraries = spark.createDataFrame([(1, "/l"), (2, "/l")], "report_id int, path string")
    got = {r["report_id"]: r["warnings"] for r in extract.quality_warnings(lines, framed, libraries).collect()}
    assert got[2] == []
    assert got[1] == [extract.QUALITY_WARNINGS[0], extract.QUALITY_WARNINGS[3], "60/120".join(extract.DAMAGED_STACK)]


def test_first_error_of_an_output_decides(spark):
    lines = [(1, 0, "688 /f.c: No such file or directory."), (1, 1, "x is not a core dump: file format not recognized"), (2, 0, "x is not a core dump"), (3, 0, "a: No such file or directory."), (3, 1, "is not a core dump"), (4, 0, "x: not a core file"), (5, 0, "fine")]
    names = [(1, "core.1"), (2, "VMCORE-2"), (3, "vmcore"), (4, "vmcore.4"), (5, "core.5")]
    got = extract.gdb_errors(spark.createDataFrame(lines, "report_id int, pos int, line string"), spark.createDataFrame(names, "report_id int, name string")).collect()
    assert {r["report_id"]: r["kind"] for r in got} == {1: "format", 2: "kernel", 3: "missing", 4: "no core file"}


def test_local_tables_without_a_thread_and_without_a_table(spark):
    table = '<table class="big result"><tbody><tr class="totals selected"><td>Total</td></tr><tr class="selected"><td>at a.B.c(B.java:1)</td><td></td><td></td><td></td><td>1,024</td></tr><tr><td>|\\ &lt;Java Local&gt; x</td></tr><tr class="selected"><td>java.lang.Thread</td></tr></tbody></table>'
    got = extract.local_rows(spark.createDataFrame([(1, table), (2, "<table><tr><td>at a.B.c()</td></tr></table>")], "report_id int, html string")).orderBy("nth").collect()
    assert [(r["report_id"], r["kind"], r["local_heap"], r["significant"]) for r in got] == [(1, "user", 1024, True), (1, "local", None, False)]


def test_what_threads_have_thrown(spark):
    oom, prone = "java.lang.OutOfMemoryError", "at java.nio.Bits.reserveMemory(Bits.java:1)"
    thread = lambda at, stack, *ids: f"Thread 0x{at} w\n  {stack}\n\n  locals:\n" + "".join(f"    objectId=0x{i}, line=1\n" for i in ids)
    dumps = [
        # two messages as often thrown: the one that stands first on the page; instance 3 is held by two threads and counts once
        (1, "head\n" + thread("A", oom, "3", "3") + thread("B", prone, "3", "2") + thread("C", prone) + thread("D", "at x.Y.z()", "3") + thread("A", oom + ": Metaspace", "4")),
        # nothing thrown: what the stack says; an address that is none
        (2, thread("1", oom + ": odd", "9") + thread("zz", oom) + thread("2", prone, "7")),
        (3, "no threads"),
        (4, None),
    ]
    instances = [(1, "3", "late", 5), (1, "2", "soon", 1), (1, "8", "unheld", 0), (1, "4", None, 7), (2, "8", "unheld", 0), (5, "3", "alone", 0)]
    got = classify.oom_exact(spark.createDataFrame(dumps, "report_id long, text string"), spark.createDataFrame(instances, "report_id long, address string, message string, pos int"))
    assert got.columns == ["report_id", "address", "seen", "type"]
    assert sorted(map(tuple, got.collect())) == [(1, "0xa", True, "soon"), (1, "0xa", True, "soon"), (1, "0xb", False, "soon"), (2, "", True, "Java heap space (inferred)"), (2, "0x1", True, "odd")]
