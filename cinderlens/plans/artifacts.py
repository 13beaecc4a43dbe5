"""Report pages, debugger output and uploads made from the driver's tables, for the extractors to read.

``objects`` are the rows that pages are made of; ``OBJECTS_SQL`` is the same for the oracles, which compare what the
extractors find in a page with the figures that it was made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.sources.tables import load

#: What a class cell looks like, by part % 6.
KINDS = 6


def objects(spark: SparkSession, d: str) -> DataFrame:
    """``report_id, owner, ordinal, part, supp, shallow, retained, percent``: a report per order, a row per line."""
    # numbered by the name that the key is used by later, so that rows of a report need not move again
    w = Window.partitionBy("report_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    return load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "report_id").select(
        "report_id",
        F.row_number().over(w).alias("ordinal"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        (F.col("l_quantity").cast("long") * 8).alias("shallow"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("retained"),
        F.round(F.col("l_discount") * 100).cast("long").alias("percent"),
    )


OBJECTS_SQL = """objects AS (SELECT l_orderkey AS report_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS INTEGER) AS ordinal,
 l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS BIGINT) * 8 AS shallow, CAST(round(l_extendedprice * 100) AS BIGINT) AS retained, CAST(round(l_discount * 100) AS BIGINT) AS percent FROM lineitem)"""


def joined(rows: DataFrame, key: str, part: Column, name: str = "html", head: str = "", tail: str = "", order: str = "ordinal") -> DataFrame:
    """``key, name``: the parts of each key in order, between head and tail. Keys have as many rows as an order has lines, and
    no two rows of a key have the same place in the order."""
    # lines of a report lie together; a window leaves them so, where a group by would sort them for each half of it
    page = Window.partitionBy(key)
    parts = F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))).over(page)
    whole = rows.select(key, F.col(order).alias("at"), parts.alias("parts"), F.min(order).over(page).alias("start")).where(F.col("at") == F.col("start"))
    return whole.select(key, F.concat(F.lit(head), F.array_join(F.sort_array("parts").getField("p"), ""), F.lit(tail)).alias(name))


def text(*parts) -> Column:
    """The parts, strings as they are, joined."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def grouped(n: Column) -> Column:
    return F.format_string("%,d", n)


def hex_address(rows_part: str = "part", rows_supp: str = "supp") -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(F.col(rows_part) * 4096 + F.col(rows_supp))))


HEX_SQL = "'0x' || printf('%x', part * 4096 + supp)"


def class_cell() -> Column:
    """The cell of an object in its report, in six forms."""
    at, s = hex_address(), F.col("supp")
    k = F.col("part") % KINDS
    return (
        F.when(k == 0, text("<a href='p'>com.acme.m", s, ".Cache @ ", at, " &raquo;</a>"))
        .when(k == 1, text("class java.util.m", s, ".Map @ ", at, " System Class"))
        .when(k == 2, text("&lt;system class loader&gt; ", s))
        .when(k == 3, text("byte[", s, "] @ ", at, " ....x..Y"))
        .when(k == 4, text("<b>org.apache.catalina.loader.L", s, "</b> @ ", at, " First 10 of 1,200 objects"))
        .otherwise(text("Total: ", s, " of 9 entries"))
    )


CLASS_SQL = "CASE part % 6 WHEN 0 THEN 'com.acme.m' || supp || '.Cache' WHEN 1 THEN 'java.util.m' || supp || '.Map' WHEN 2 THEN '<system class loader> ' || supp WHEN 3 THEN 'byte[' || supp || ']' WHEN 4 THEN 'org.apache.catalina.loader.L' || supp END"


def object_table(spark: SparkSession, d: str) -> DataFrame:
    """``report_id, html``: a table of class, shallow and retained size and percent."""
    cell = lambda c: F.concat(F.lit('<td align="right">'), c, F.lit("</td>"))
    percent = F.when(F.col("part") % 7 == 0, F.lit("n/a")).otherwise(text(F.col("percent"), "%"))
    row = F.concat(F.lit("<tr class='x'>\n<td>"), class_cell(), F.lit("</td>"), cell(grouped(F.col("shallow"))), cell(F.concat(F.lit(" "), grouped(F.col("retained")))), F.when(F.col("part") % 11 != 0, cell(percent)).otherwise(F.lit("")), F.lit("</tr>\n"))
    return joined(objects(spark, d), "report_id", row, head="<table><TR><th>Class Name</th><th>Shallow Heap</th><th>Retained Heap</th><th>Percentage</th></TR>\n", tail="</table>")


#: Error instances stand at this unsigned address plus a number; as a signed one it is negative.
INSTANCES_AT = 18446744073709000000


def thread_address() -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(F.col("report_id") * 64 + F.col("ordinal"))))


THREAD_SQL = "'0x' || printf('%x', report_id * 64 + ordinal)"


def thread_stack() -> Column:
    """The frames of an object's thread, in eight forms."""
    k, own = F.col("part") % 8, text("at app.M", F.col("part"), ".run(M.java:", F.col("ordinal"), ")")
    init = "at java.lang.OutOfMemoryError.<init>()V\n  "
    return (
        # an error without a message, and in some stacks a later one with a message, which does not count
        F.when(k == 0, F.concat(F.lit(init + "at java.lang.Thread.start0(Native Method)\n  "), own, F.when(F.col("part") % 16 == 8, "\n  Caused by: java.lang.OutOfMemoryError: Metaspace").otherwise("")))
        .when(k == 1, F.concat(F.lit("at java.nio.Bits.reserveMemory(Bits.java:1)\n  "), own))
        .when(k == 2, F.concat(F.lit("java.lang.OutOfMemoryError: GC overhead limit exceeded\n  "), own))
        .when(k == 3, F.concat(F.lit(init), own))
        .when(k == 4, F.concat(F.lit("at my.OutOfMemoryError.x()V\n  "), own))
        .when(k == 5, F.concat(F.lit(init + "at java.lang.ClassLoader.defineClass1(Native Method)\n  "), own))
        .when(k == 6, F.concat(F.lit("java.lang.OutOfMemoryError: something odd\n  "), own))
        .otherwise(own)
    )


def thread_dump(spark: SparkSession, d: str) -> DataFrame:
    """``report_id, text``: blocks of threads with upper-case addresses, frames and locals. The local of a thread whose
    part is no multiple of 3 is the error instance with the line's supplier as its number."""
    local = F.when(F.col("part") % 3 == 0, F.hex(F.col("part"))).otherwise(F.hex(F.col("supp") + F.lit(INSTANCES_AT - (1 << 64))))
    block = F.concat(F.lit("Thread 0x"), F.upper(F.substring(thread_address(), 3, 99)), text(" worker-", F.col("supp")), F.lit("\n  "), thread_stack(), F.lit("\n\n  locals:\n    objectId=0x"), local, F.lit(", line=1\n    objectId=0x"), F.lower(local), F.lit(", line=2\n\n"))
    return joined(objects(spark, d), "report_id", block, "text", head="header\n")


#: What a debugger says about an output in passing, by report.
GDB_NOTES = ("warning: Cannot access memory at address 0x10", "No symbol table info available.", "warning: Section `.reg-xstate/1' in core file too small.", "warning: Can't open file (null) during file-backed mapping note processing", "")


def core_names(spark: SparkSession, d: str) -> DataFrame:
    """``report_id, name`` of the cores; some are of a kernel."""
    k = F.col("report_id")
    return objects(spark, d).select("report_id").distinct().withColumn("name", text(F.when(k % 22 == 0, "vmcore.").otherwise("core."), k))


def gdb_lines(spark: SparkSession, d: str) -> DataFrame:
    """``report_id, pos, line``: a debugger's output by lines. ``pos`` is 1,000 times the section, plus ten times the
    ordinal of the object that the line is made of."""
    n, part, supp = F.col("ordinal"), F.col("part"), F.col("supp")
    k = part % 6
    at, nth = F.concat(F.lit("0x00007f"), F.lpad(F.lower(F.hex(part * 4096 + supp)), 10, "0")), (n - 1).cast("string")
    frame = (
        F.when(k == 0, text("#", nth, "  ", at, " in fn", supp, " (a=1, b=2) at f", part, ".c:10"))
        .when(k == 1, text("#", nth, "  fn", supp, " () from /lib/l", supp, ".so"))
        .when(k == 2, text("#", nth, "  0x4142434445464748 in ?? ()"))
        .when(k == 3, text("#", nth, "  ", at, " in ?? ()"))
        .when(k == 4, text("#", nth, "  <signal handler called>"))
        .otherwise(text("  #", nth, "  operator new (sz=", part, ")"))
    )
    line = lambda section, add, c: F.struct((F.lit(section * 1000 + add) + n * 10).alias("pos"), c.alias("line"))
    mark = lambda section, name: F.struct(F.lit(section * 1000).alias("pos"), F.lit(f"===SECTION:{name}===").alias("line"))
    lines = F.array(
        line(1, 0, frame),
        line(2, 0, frame),
        line(2, 1, text("        x = ", part)),
        line(3, 0, text(F.when(n % 3 == 0, "rax").when(n % 3 == 1, "rip").otherwise("r8"), "           0x", F.lower(F.hex(part)), "   ", part)),
        line(4, 0, F.when(part % 3 == 0, F.lit("No linux-gate")).otherwise(text(at, "  0x00007fffffffffff  ", F.when(part % 3 == 1, "Yes (*)").otherwise("No"), "     /lib/l", supp, ".so"))),
        line(5, 0, text(F.when(n == 2, "* ").otherwise("  "), n, "    Thread 0x7f", part, " (LWP ", supp, ") fn", supp, " ()")),
    )
    first = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("GNU gdb (GDB) 12.1-x").alias("line")),
        F.struct(F.lit(1).alias("pos"), text("Core was generated by `app", F.col("report_id"), " -x'.").alias("line")),
        F.struct(F.lit(2).alias("pos"), F.when(F.col("report_id") % 5 == 0, text("/c/", F.col("report_id"), ": No such file or directory.")).when(F.col("report_id") % 5 == 1, F.lit("688\t/src/f.c: No such file or directory.")).otherwise("Program terminated with signal SIGSEGV, Segmentation fault.").alias("line")),
        F.struct(F.lit(3).alias("pos"), F.get(F.array(*(F.lit(x) for x in GDB_NOTES)), F.col("report_id") % len(GDB_NOTES)).alias("line")),
        F.struct(F.lit(4).alias("pos"), F.when(F.col("report_id") % 11 == 0, text("\"/c/", F.col("report_id"), "\" is not a core dump: file format not recognized")).when(F.col("report_id") % 11 == 1, text("/c/", F.col("report_id"), ": not a core file")).otherwise("").alias("line")),
        *(mark(i, name) for i, name in enumerate(("bt", "bt_full", "registers", "sharedlibrary", "threads"), 1)),
    )
    every = F.concat(lines, F.when(n == 1, first).otherwise(F.array().cast("array<struct<pos: int, line: string>>")))
    return objects(spark, d).select("report_id", F.explode(every).alias("l")).select("report_id", "l.pos", "l.line")
