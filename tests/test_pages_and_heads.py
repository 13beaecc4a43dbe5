"""Cleaned pages, hashes of the heads of files, reference lists and sections, with cases that the tables lack."""

import gzip
import hashlib
import random
import re

import duckdb
import pytest
from oracle import difference
from pyspark.sql import functions as F

from cinderlens.functions import sanitize
from cinderlens.operators import references, reports
from cinderlens.sources import heads


@pytest.mark.parametrize(
    ("page", "left"),
    [
        (None, None),
        ("", ""),
        ("a < b & c", "a &lt; b &amp; c"),
        ('<html><body onload="x()"><p class=\'a\' onclick="bad()">Hi<script>if (a < b) evil("</p>")</script></p></body></html>', '<p class="a">Hi</p>'),
        ('<!DOCTYPE html><body bgcolor="red">x<!-- c --></BODY>', "x"),
        ("<html>no body<b>x", "no body<b>x</b>"),
        ('<a href="https://x/?a=1&amp;b=2" title="t">l</a><a href="mat://object/0x1">m</a><a href="#">n</a><a name="k">o</a>', '<a href="https://x/?a=1&amp;b=2" title="t" rel="nofollow">l</a><a href="javascript:void(0)" rel="nofollow">m</a><a href="javascript:void(0)" rel="nofollow">n</a><a>o</a>'),
        ("<table width=5 onclick=x><tr><td nowrap align=right colspan=2>1<td>2</table>", '<table width="5"><tr><td nowrap="" align="right" colspan="2">1</td><td>2</td></tr></table>'),
        ("<b><i>x</b>y</i>z", "<b><i>x</i></b>yz"),
        ("<form><p>a</p></form><img src=x onerror=y>b<br>c<hr/>", "<p>a</p>b<br />c<hr />"),
        ('<p title="a&quot;&gt;<script>">x</p>', '<p title="a&quot;&gt;&lt;script&gt;">x</p>'),
        ("<scr<script>x</script>ipt>alert(1)", "xipt&gt;alert(1)"),
        ("<iframe><p>gone</p></iframe><style>p{}</style>kept</p>", "kept"),
    ],
)
def test_clean(page, left):
    assert sanitize.clean(page) == left


def test_what_is_left_is_clean_again():
    rng = random.Random(8)
    pieces = ["<p>", "</p>", "<b>", "</b>", "<script>", "</script>", "<a href='x'>", '<a href="https://e/">', "</a>", "text", " & ", "<!--", "-->", "<td onclick=a>", "<", ">", '"', "<style>", "</style>", "<ul><li>", "é"]
    for _ in range(400):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        once = sanitize.clean(page)
        assert sanitize.clean(once) == once and not re.search("(?i)<script|<[^>]*onclick", once)


def test_cleaned_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "<nav>x</nav>", 5.0), (2, None, None)], "id int, page string, n double")
    assert [tuple(r) for r in sanitize.cleaned(rows, "page").orderBy("id").collect()] == [(1, "x", 5.0), (2, None, None)]


def test_heads_of_packed_and_plain_files(spark, tmp_path):
    rng = random.Random(2)
    large = rng.randbytes(3_000_000)
    content = {"a.hprof": b"small", "b.hprof": large, "d.hprof": large[:65_536]}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data))
    (tmp_path / "two.hprof.gz").write_bytes(gzip.compress(b"abc") + gzip.compress(large))
    (tmp_path / "two.hprof").write_bytes(b"abc" + large)
    (tmp_path / "broken.hprof.gz").write_bytes(b"no packed file")
    (tmp_path / "cut.hprof.gz").write_bytes(gzip.compress(large)[:20_000])
    (tmp_path / "notes.txt.gz").write_bytes(gzip.compress(b"x"))
    got = {r["name"]: r for r in heads.file_hashes(spark, str(tmp_path)).collect()}
    for name in [*content, "two.hprof"]:
        wanted = hashlib.sha256((content.get(name) if name in content else b"abc" + large)[:65_536]).hexdigest()
        assert got[name]["hash"] == got[f"{name}.gz"]["hash"] == wanted
    assert got["broken.hprof.gz"]["hash"] is None and got["cut.hprof.gz"]["hash"] is None
    # what is no dump is not unpacked
    assert got["notes.txt.gz"]["hash"] == hashlib.sha256(gzip.compress(b"x")).hexdigest() or got["notes.txt.gz"]["size"] > 0
    # of a large file only its head is read
    assert got["b.hprof"]["bytes_read"] == 65_536 and got["b.hprof.gz"]["bytes_read"] < 100_000


def row(name, n=1):
    return f"<tr><td>{name}</td><td>{n}</td><td>{n * 2}</td></tr>"


PAGES = "report_id long, address string, kind string, html string"


def test_reference_lists_stored_and_computed(spark, tmp_path):
    pages = [(1, "0x1", "incoming", "<table>" + "".join(row(f"a.C{i} @ 0x{i:x}", i) for i in range(9)) + "</table>"), (1, "0x1", "outgoing", "<table></table>"), (1, "0x2", "incoming", row("b.D @ 0xb")), (2, "0x1", "incoming", "<p>broken</p>"), (2, "0x1", "outgoing", ""), (3, "0x9", "outgoing", row("Total: 3 entries") + row("class e.F @ 0xe System Class"))]
    frame = spark.createDataFrame(pages, PAGES)
    objects = spark.createDataFrame([(1, "0x1", 90), (1, "0x2", 10), (1, "odd", 99), (2, "0x1", 5), (3, "0x9", 1), (3, None, 2)], "report_id long, address string, retained long")
    side = references.precompute(objects, frame, str(tmp_path / "side"), largest=1, cap=4)
    # a report whose lists are all empty is not kept
    assert {(r["report_id"], r["address"]) for r in side.collect()} == {(1, "0x1"), (3, "0x9")}
    asked = spark.createDataFrame([(1, "0x1"), (1, "0x2"), (2, "0x1"), (3, "0x9"), (4, "0x1")], "report_id long, address string")
    got = {(r["report_id"], r["address"]): r for r in references.looked_up(asked, side, frame, cap=4).collect()}
    assert {k: r["source"] for k, r in got.items()} == {(1, "0x1"): "stored", (1, "0x2"): "computed", (2, "0x1"): "computed", (3, "0x9"): "stored", (4, "0x1"): "none"}
    assert [tuple(x) for x in got[1, "0x1"]["incoming"]] == [(i + 1, f"a.C{i}", f"0x{i:x}", i, 2 * i) for i in range(4)]
    assert [x["class_name"] for x in got[3, "0x9"]["outgoing"]] == ["e.F"] and got[2, "0x1"]["incoming"] == [] and got[4, "0x1"]["incoming"] is None


def test_caps_of_references_and_classes(spark):
    page = spark.createDataFrame([(1, "<table>" + "".join(row(f"a.C{i}", i) for i in range(700)) + "</table>")], "report_id int, html string")
    assert reports.reference_rows(page).count() == 50
    assert reports.loaded_classes(page).agg(F.count("*"), F.max("nth")).first()[:] == (500, 500)


def test_sections_by_level_and_pruning_at_the_top_only(spark):
    html = '<h2 id="i0">Page</h2><h2 id="i1">A</h2>text<h3 id="i2">B</h3><h4 id="i3">C</h4><h3 id="i4"> </h3>more<h2 id="i5">D</h2><h3 id="i6">E</h3><h2 id="i7">F</h4> f</h2><p>x</p>'
    got = {r["section"]: r for r in reports.sections(spark.createDataFrame([(1, html)], "report_id int, html string")).collect()}
    assert set(got) == {"i1", "i2", "i3", "i5", "i6", "i7"}
    assert got["i7"]["title"] == "F f" and got["i7"]["description"] == "x" and got["i3"]["description"] == "more"
    kept = {r["section"] for r in reports.prune(reports.sections(spark.createDataFrame([(1, html.replace("more", ""))], "report_id int, html string"))).collect()}
    # B lies below A and stays without anything in it, D does not
    assert kept == {"i1", "i2", "i7"}


@pytest.mark.parametrize(
    ("page", "left"),
    [
        ("<p>a&amp b &am", "<p>a&amp b &am</p>"),
        ("a &amp; b &lt;c&gt; &copy; & d &#60;", "a &amp; b &lt;c&gt; © &amp; d &lt;"),
        ("&nosuch; &ampx;", "&nosuch; &ampx;"),
        ("a&amp;& b", "a&amp;& b"),
        # what was cut apart does not become a reference
        ("&am<x>p;", "&amp;amp;"),
        ('<a href="http://h/?a=1&amp;b=2&c=3">x</a>', '<a href="http://h/?a=1&amp;b=2&amp;c=3" rel="nofollow">x</a>'),
    ],
)
def test_references_that_are_not_whole_stay(page, left):
    assert sanitize.clean(page) == left
    assert sanitize.clean(left) == left


def test_findings_are_cut_as_by_plain_patterns(spark):
    parts = ["Problem", "sUSPECT", "Suspect 1", "problem\n22", " Problem 3</h2>", "<p>", "<", ">", "</p>", "x" * 31, "a b  c", "\n", "Keywords", "keywordsx", "<b>Key</b>words", "Details »", "DETAILS\n &raquo;", "details", "Table  of\tContents", "created by eclipse", "speed and cuts", "K", "9", "\r\n"]
    draw = random.Random(7)
    pages = ["".join(draw.choices(parts, k=draw.randint(1, 40))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(pages)), "report_id int, html string")
    footer = r"(?is)\s*(?:Keywords\b|Details\s*(?:»|&raquo;|&#187;)|Table\s+Of\s+Contents|Created\s+by\s+Eclipse).*$"
    numbered = r"(?is)(?:Problem|Suspect)\s*\d+[^<]*<.*?>(.*?)(?=(?:Problem|Suspect)\s*\d+|$)"
    text = lambda c: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")), footer, ""))
    plainly = F.slice(F.filter(F.transform(F.regexp_extract_all("html", F.lit(numbered), F.lit(1)), text), lambda x: F.length(x) > 30), 1, reports.FINDINGS)
    want = {(r["report_id"], i): x for r in rows.select("report_id", plainly.alias("t")).collect() for i, x in enumerate(r["t"])}
    got = {(r["report_id"], r["pos"]): r["description"] for r in reports.findings(rows, unnumbered=False).collect()}
    assert len(want) > 300 and got == want
    every = {(r["report_id"], r["pos"]): r["description"] for r in reports.findings(rows).where("title <> 'Leak Analysis'").collect()}
    assert every == want
    whole = {r["report_id"]: r["t"] for r in rows.select("report_id", text(F.col("html")).alias("t")).collect()}
    rest = {r["report_id"]: r["description"] for r in reports.findings(rows).where("title = 'Leak Analysis'").collect()}
    assert rest == {i: t for i, t in whole.items() if (i, 0) not in want and len(t) > 100}


@pytest.mark.parametrize(("page", "left"), [("<h1>token = &</h1>", "<h1>token = &</h1>"), ("<p>&</p>", "<p>&</p>"), ("<p>a & b &</p>", "<p>a &amp; b &</p>"), ("a &<x>amp;", "a &amp;amp;")])
def test_an_ampersand_at_the_end_of_a_text_stays(page, left):
    assert sanitize.clean(page) == left
    assert sanitize.clean(left) == left


def test_cleaned_pages_with_cut_titles_and_nulls_are_those_of_the_sql(spark, tmp_path):
    titles = [f"token = {'&quot;'[:n]}" for n in range(7)] + [f"a{'&amp;'[:n]}" for n in range(6)]
    pages = [(i, f"<html><body><nav>x</nav><h1>{t}</h1><p>&copy; y</p></body></html>") for i, t in enumerate(titles)] + [(98, ""), (99, None)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert difference(sanitize.html_sanitize(spark, str(tmp_path)), con, sanitize.ORACLE_SQL) is None


def test_suspects_of_pages_without_numbers_are_in_the_query(spark):
    pages = reports._finding_page(spark, "/root/testdata/sf0.001")
    unnumbered = {r[0] for r in reports.findings(pages).where("title = 'Leak Analysis'").select("report_id").collect()}
    got = reports.QUERIES["suspect_split"][0](spark, "/root/testdata/sf0.001").where("title = 'Leak Analysis'")
    assert unnumbered and {r[0] for r in got.select("report_id").collect()} == unnumbered


def test_sections_have_result_tables_with_headers_and_items_of_lists(spark):
    table = '<table id="t" class="result"><tr><th>N</th></tr><tr><td>1</td></tr></table>'
    bare = '<table class="result"><tr><td>1</td></tr></table>'
    html = (
        '<h2 id="i0">Page</h2><h3 id="i1">A</h3><p>before</p>' + table + "<p>after</p>" + bare + '<h3 id="i2">B</h3>so' + bare + '<h3 id="i3">C</h3><table><tr><td>5</td></tr></table>'
        '<h3 id="i4">D</h3>see <ul><li>x  <b>y</b></li><li> </li><LI>z</LI></ul><h3 id="i5">E</h3><ul><li>x</li></ul><h4 id="i6">F</h4>'
    )
    rows = reports.sections(spark.createDataFrame([(1, html)], "report_id int, html string"))
    got = {r["section"]: (r["kind"], r["description"], len(r["tables"])) for r in rows.collect()}
    # an item is in the text and below it, but not where a deeper heading follows; a table that is no result is not read
    assert got == {"i1": ("TABLE", "before", 1), "i2": ("TABLE", "so", 0), "i3": ("TEXT", "", 0), "i4": ("TEXT", "see x y z\n- x y\n- z", 0), "i5": ("TEXT", "x", 0), "i6": ("TEXT", "", 0)}
    # what stands before a table without headers does not keep a section
    assert {r["section"] for r in reports.prune(rows).collect()} == {"i1", "i4", "i5"}


def test_reference_pages_and_lists_do_not_move_from_their_reports(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 7 AS report_id", "concat('0x', hex(id)) AS address", "id AS retained", "explode(array('incoming', 'outgoing')) AS kind").repartition("report_id")
    pages = rows.withColumn("html", F.lit("<table>" + row("a.B") + row("c.D", 2) + "</table>"))
    side = references.precompute(rows.select("report_id", "address", "retained").distinct(), pages, str(tmp_path / "side"), largest=2)
    # a filter of each file takes what its addresses need, not a megabyte
    files = [*(tmp_path / "side").rglob("*.parquet")]
    assert files and max(f.stat().st_size for f in files) < 100_000
    got = references.looked_up(rows.select("report_id", "address").unionAll(spark.createDataFrame([(1, "0xfff"), (9, "0x1"), (1, None)], "report_id long, address string")), side, pages)
    assert {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"stored": 14, "computed": 26, "none": 3}
    moved = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in x or "- Exchange" in x]
    # each exchange is by report alone; what is dealt by an address too would move pages or their lists again
    assert moved and not [x for x in moved if re.search(r"hashpartitioning\([^)]*(address|folder)", x)]
