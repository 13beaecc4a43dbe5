"""Rules without SQL, or with cases that the tables lack."""

from pyspark.sql import functions as F

from cinderlens.functions import texts as T
from cinderlens.operators.tools import heap_check, upload_status


def two_hashes(data):
    a, b = 0x811C9DC5, 0x01000193
    for byte in data:
        a = (a ^ byte) * b & 0xFFFFFFFF
        b = (b ^ byte) * 0x01000193 & 0xFFFFFFFF
    return f"{a:08x}{b:08x}"


def test_two_hashes(spark):
    words = ["", "a", "dump.hprof", "é漢" * 50, "\x00\x01"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.two_hashes(F.col("w")).alias("h")).collect()
    assert {r["w"]: r["h"] for r in got} == {w: two_hashes(w.encode()) for w in words}


def test_a_free_name_is_the_first_gap(spark):
    files = spark.createDataFrame([(n, 1, "x") for n in ("a.hprof", "a_2.hprof", "a_3.hprof", "a_5.hprof", "b.bin", "b_3.bin", "c.bin")], "name string, size long, hash string")
    uploads = spark.createDataFrame([(1, "a.hprof", 9, "y"), (2, "b.bin", 9, "y"), (3, "c.bin", 1, "x"), (4, "new.bin", 1, "y"), (5, "c.bin", 2, "x")], "id int, name string, size long, hash string")
    got = {r["id"]: (r["status"], r["existing"], r["suggested"]) for r in upload_status(uploads, files).collect()}
    assert got == {1: ("DUPLICATE_NAME", "a.hprof", "a_4.hprof"), 2: ("DUPLICATE_NAME", "b.bin", "b_2.bin"), 3: ("DUPLICATE_CONTENT", "a.hprof", None), 4: ("OK", None, None), 5: ("DUPLICATE_NAME", "c.bin", "c_2.bin")}


def test_halves_of_recommended_heaps_go_to_the_even_digit(spark):
    sizes = [203904, 441984, 38043648, 52224]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, working long").selectExpr("*", *(f"CAST(NULL AS BIGINT) AS {c}" for c in ("plain", "packed", "recorded", "trailer")))
    assert [r.recommended for r in heap_check(rows, 1).orderBy("id").collect()] == ["398.2 KB", "863.2 KB", "72.56 MB", "102.0 KB"]
