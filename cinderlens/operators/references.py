"""References of objects by address: lists that were worked out beforehand are kept in a side table, the others are worked out
from the objects' pages when they are asked for.

The side table is dealt to folders by a hash of the address, its files are sorted by address and written with bloom filters on
it, so that a lookup reads the folders and row groups that can hold its addresses. It has the lists of each report's largest objects, cut
to a number of entries. A report whose lists are all empty is not kept: its pages could not be read, and empty lists would
hide what can still be worked out.

All joins are by report, and addresses are looked for in lists of the report's: pages that are dealt by report are worked out
where they stand, and neither they nor their lists move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.functions.steps import worked_out
from cinderlens.operators.reports import REF_CAP, reference_entries
from cinderlens.plans import artifacts as A
from cinderlens.plans.artifacts import CLASS_SQL, HEX_SQL, OBJECTS_SQL
from cinderlens.sources.stored import new_folder, stored

#: Objects of a report whose lists are worked out beforehand; fixed value.
LARGEST = 30
FOLDERS = 16
KINDS = ("incoming", "outgoing")


def _folder(address: Column) -> Column:
    return F.pmod(F.xxhash64(address), F.lit(FOLDERS)).cast("int")


def _addresses(rows: DataFrame, name: str) -> DataFrame:
    """``of``, a report, and the list ``name`` of the addresses of ``rows`` in it, to be held by tasks."""
    return rows.groupBy(F.col("report_id").alias("of")).agg(F.collect_set("address").alias(name)).hint("shuffle_hash")


def _among(name: str) -> Column:
    return (F.col("report_id") == F.col("of")) & F.array_contains(name, F.col("address"))


def reference_lists(pages: DataFrame, cap: int = REF_CAP) -> DataFrame:
    """``report_id, address, incoming, outgoing`` from ``report_id, address, kind, html``; a page without rows gives an empty
    list."""
    lists = pages.select("report_id", "address", "kind", reference_entries(F.col("html"), cap).alias("refs"))
    none = F.array().cast(lists.schema["refs"].dataType)
    of = lambda kind: F.coalesce(F.max_by("refs", F.when(F.col("kind") == kind, 1)), none).alias(kind)
    return lists.groupBy("report_id", "address").agg(*(of(k) for k in KINDS))


def precompute(objects: DataFrame, pages: DataFrame, folder: str, largest: int = LARGEST, cap: int = REF_CAP) -> DataFrame:
    """Write the lists of the ``largest`` objects of each report (``report_id, address, retained``) under ``folder``."""
    w = Window.partitionBy("report_id").orderBy(F.desc("retained"), "address")
    top = objects.where(F.col("address").rlike("^0x[0-9a-fA-F]+$")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= largest)
    lists = reference_lists(pages.join(_addresses(top, "top"), _among("top"), "left_semi"), cap)
    filled = (F.size("incoming") > 0) | (F.size("outgoing") > 0)
    known = lists.withColumn("any", F.max(filled).over(Window.partitionBy("report_id"))).where("any").drop("any")
    # each task writes its part of the folders, so that lists do not move; filters are as large as a file's addresses need
    rows = known.withColumn("folder", _folder(F.col("address"))).sortWithinPartitions("folder", "address", "report_id")
    return stored(rows, folder, ("folder",), **{"parquet.bloom.filter.enabled#address": "true", "parquet.bloom.filter.adaptive.enabled": "true"})


def looked_up(asked: DataFrame, side: DataFrame, pages: DataFrame, cap: int = REF_CAP) -> DataFrame:
    """``report_id, address, source, incoming, outgoing`` of what is asked for (``report_id, address``): from the side table,
    else worked out from the pages (only those of objects that the table does not have are read for it), else nothing."""
    keys = ["report_id", "address"]
    asked = asked.select(*keys).repartition("report_id").distinct()
    wanted, known = _addresses(asked, "wanted"), _addresses(side, "known")
    hits = side.join(wanted, _among("wanted"), "left_semi").select(*keys, F.lit("stored").alias("source"), *KINDS)
    rest = asked.join(known, _among("known"), "left_anti")
    made = reference_lists(pages.join(known, _among("known"), "left_anti").join(wanted, _among("wanted"), "left_semi"), cap)
    # a key of two columns would move what is dealt by one
    made = made.withColumnRenamed("report_id", "of").withColumn("at", F.array("address")).drop("address")
    computed = rest.hint("shuffle_hash").join(made, _among("at"), "left").select(*keys, F.when(F.col("incoming").isNull(), "none").otherwise("computed").alias("source"), *KINDS)
    return hits.unionByName(computed)


# ---- queries: each object of a report is referred to by those before it and refers to those after it


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each address of a report."""
    rows = A.objects(spark, d).groupBy("report_id", "part", "supp").agg(F.min_by(F.struct("ordinal", "shallow", "retained"), "ordinal").alias("o")).select("report_id", "part", "supp", "o.*")
    return rows.withColumn("address", A.hex_address())


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per object and direction; objects of every thirteenth part have none."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(A.class_cell()), cell(A.grouped(F.col("shallow"))), cell(A.grouped(F.col("retained"))), F.lit("</tr>"))
    # an order's lines; its rows are made once and the pages of its objects from them, without pairs of objects
    every = _objects(spark, d).groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "address", "part", row.alias("row")))).alias("every"))
    objects = every.select("report_id", "every", F.explode("every").alias("of")).where("of.part % 13 <> 0")
    # objects of one address share its pages, which stand with the first of them
    own = F.filter("every", lambda x: (x["address"] == F.col("of.address")) & (x["part"] % 13 != 0))
    objects = worked_out(objects, own=own).where(F.get("own", F.lit(0))["ordinal"] == F.col("of.ordinal"))
    shown = lambda test: F.array_sort(F.flatten(F.transform("own", lambda a: F.filter("every", lambda x: test(x["ordinal"], a["ordinal"])))))
    kinds = F.array(F.struct(F.lit(KINDS[0]).alias("kind"), shown(lambda x, a: x < a).alias("shown")), F.struct(F.lit(KINDS[1]).alias("kind"), shown(lambda x, a: x > a).alias("shown")))
    pages = objects.select("report_id", "of.address", F.inline(kinds)).where("size(shown) > 0")
    body = F.array_join(F.transform("shown", lambda x: x["row"]), "")
    return pages.select("report_id", "address", "kind", F.concat(F.lit("<table><tr><th>Class Name</th></tr>"), body, F.lit("</table>")).alias("html"))


#: In the query two objects of a report and lists of three are kept, as reports are short.
QUERY_LARGEST, QUERY_CAP = 2, 3


def object_references(spark: SparkSession, d: str) -> DataFrame:
    """Where the lists of every object come from, how long they are, and their entries."""
    # pages are made anew for each of both, as making them takes less than keeping them
    pages = _pages(spark, d)
    side = precompute(_objects(spark, d), pages, new_folder(spark, "references"), QUERY_LARGEST, QUERY_CAP)
    rows = looked_up(A.objects(spark, d).withColumn("address", A.hex_address()), side, pages, QUERY_CAP)
    shown = lambda k: F.array_join(F.transform(k, lambda x: F.concat(x["class_name"], F.lit("@"), F.coalesce(x["address"], F.lit("-")), F.lit(":"), x["retained"].cast("string"))), ",").alias(k)
    return rows.select("report_id", "address", "source", *(F.size(k).alias(f"n_{k}") for k in KINDS), *(shown(k) for k in KINDS))


_LIST = lambda side: f"SELECT a.report_id, a.address, {{'n': row_number() OVER (PARTITION BY a.report_id, a.address ORDER BY b.ordinal), 't': b.class_name || '@' || CASE WHEN b.part % 6 <> 2 THEN b.address ELSE '-' END || ':' || b.retained}} AS x FROM u a JOIN u b ON a.report_id = b.report_id AND a.part % 13 <> 0 AND b.ordinal {side} a.ordinal AND b.class_name IS NOT NULL"
_JOINED = lambda side: f"SELECT report_id, address, count(*) AS n, string_agg(x.t, ',' ORDER BY x.n) AS t FROM ({_LIST(side)}) WHERE x.n <= {QUERY_CAP} GROUP BY 1, 2"
QUERIES = {
    "object_references": (
        object_references,
        f"""WITH {OBJECTS_SQL}, v AS (SELECT report_id, part, supp, min(ordinal) AS ordinal, min_by(retained, ordinal) AS retained FROM objects GROUP BY 1, 2, 3), u AS (SELECT *, {HEX_SQL} AS address, {CLASS_SQL} AS class_name FROM v),
 i AS ({_JOINED("<")}), o AS ({_JOINED(">")}), p AS (SELECT a.report_id, a.address FROM u a WHERE a.part % 13 <> 0 AND EXISTS (SELECT 1 FROM u b WHERE b.report_id = a.report_id AND b.ordinal <> a.ordinal)),
 t AS (SELECT report_id, address FROM u QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY retained DESC, address) <= {QUERY_LARGEST}),
 k AS (SELECT t.report_id, t.address, (i.n IS NOT NULL OR o.n IS NOT NULL) AS filled FROM t JOIN p USING (report_id, address) LEFT JOIN i USING (report_id, address) LEFT JOIN o USING (report_id, address)),
 s AS (SELECT report_id, address FROM k QUALIFY bool_or(filled) OVER (PARTITION BY report_id))
 SELECT u.report_id, u.address, CASE WHEN s.address IS NOT NULL THEN 'stored' WHEN p.address IS NOT NULL THEN 'computed' ELSE 'none' END AS source, CASE WHEN p.address IS NULL THEN NULL ELSE CAST(coalesce(i.n, 0) AS INTEGER) END AS n_incoming, CASE WHEN p.address IS NULL THEN NULL ELSE CAST(coalesce(o.n, 0) AS INTEGER) END AS n_outgoing,
 CASE WHEN p.address IS NOT NULL THEN coalesce(i.t, '') END AS incoming, CASE WHEN p.address IS NOT NULL THEN coalesce(o.t, '') END AS outgoing
 FROM u LEFT JOIN s ON s.report_id = u.report_id AND s.address = u.address LEFT JOIN p ON p.report_id = u.report_id AND p.address = u.address LEFT JOIN i ON i.report_id = u.report_id AND i.address = u.address LEFT JOIN o ON o.report_id = u.report_id AND o.address = u.address""",
    ),
}
