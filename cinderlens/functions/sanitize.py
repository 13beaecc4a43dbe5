"""Cleaning of report pages by an allow-list of elements and attributes.

A page goes through an HTML tokenizer in an Arrow stage. Allowed elements are written anew with their allowed attributes,
everything written is balanced by a stack of open elements, other elements are left out but for their text, and those whose
content is no text go with it. Links to anything but the allowed protocols do nothing. In texts whole character references
are written anew; one that is cut short, be it to its ampersand behind a word or at a text's end, stays as it was written, as
it reads the same.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlens.sources.tables import load

#: Elements and attributes of report pages, protocols of links, what a dead link does, elements without an end, and elements
#: whose content is no text; fixed values.
ELEMENTS = frozenset(
    "div span p br hr h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr th td caption colgroup col b i u strong em small sub sup code pre ul ol li dl dt dd a".split()
)
EVERYWHERE = frozenset("class id title style".split())
IN_TABLES = frozenset("width height border cellpadding cellspacing align valign bgcolor colspan rowspan scope".split())
TABLE_PARTS = frozenset("table th td tr col colgroup".split())
PROTOCOLS = ("http://", "https://", "javascript:")
DEAD_LINK = "javascript:void(0)"
VOID = frozenset("br hr col".split())
NO_TEXT = frozenset("script style iframe object embed noscript template textarea title select".split())
#: Elements that end an open one of the same kind.
SELF_ENDING = frozenset("p li dt dd tr td th".split())
BODY = re.compile(r"(?is)<body[^>]*>(.*)</body>")
WHOLE = re.compile(r"(?i)<!DOCTYPE|<html")
#: Whole references and characters that are written as ones, and what a text behind it could make a reference.
WRITTEN_ANEW = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|(?<!\S)&(?![#A-Za-z0-9]|\Z)|[<>]")
UNFINISHED = re.compile(r"&(?=#?[A-Za-z0-9]*\Z)")


def _allowed(tag: str, name: str) -> bool:
    return name in EVERYWHERE or (name == "href" and tag == "a") or (name in IN_TABLES and tag in TABLE_PARTS) or (name == "nowrap" and tag in ("td", "th"))


def _reference(hit: re.Match) -> str:
    found = hit.group()
    return found if found[1:2].isalpha() and found[1:] not in html5 else html.escape(html.unescape(found), quote=False)


class Cleaner(HTMLParser):
    """Writes what is allowed of one page, whose references are told to it as they are written."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in NO_TEXT:
            self.hidden.append(tag)
        if self.hidden or tag not in ELEMENTS:
            return
        if tag in SELF_ENDING and self.open and self.open[-1] == tag:
            self.handle_endtag(tag)
        shown = []
        for name, value in attrs:
            if _allowed(tag, name) and not any(name == n for n, _ in shown):
                value = html.unescape(value or "")
                if name == "href" and not value.strip().lower().startswith(PROTOCOLS):
                    value = DEAD_LINK
                shown.append((name, value))
        if tag == "a" and any(n == "href" for n, _ in shown):
            shown.append(("rel", "nofollow"))
        self.out.append(f"<{tag}" + "".join(f' {n}="{html.escape(v)}"' for n, v in shown) + (" />" if tag in VOID else ">"))
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in NO_TEXT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            if self.out:
                self.out[-1] = UNFINISHED.sub("&amp;", self.out[-1])
            self.out.append(WRITTEN_ANEW.sub(_reference, data))

    def feed(self, data: str) -> None:
        super().feed(data.replace("&", "&amp;"))

    def result(self) -> str:
        self.close()
        return ("".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))).strip()


def clean(page: str | None) -> str | None:
    """The allowed part of a page's body; null and empty pages stay as they are."""
    if not page:
        return page
    if WHOLE.search(page) and (hit := BODY.search(page)):
        page = hit.group(1)
    cleaner = Cleaner()
    cleaner.feed(page)
    return cleaner.result()


def cleaned(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``column`` cleaned."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    at = pages.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return pages.mapInArrow(run, kinds)


def html_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """Of every page: hashes of the text and the elements that are left, its links by whether they work, and whether anything
    that is not allowed is left."""
    rows = cleaned(load(spark, d, "pages").select("page_id", "html"))
    tags = F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return rows.select(
        "page_id",
        F.sha2(text, 256).alias("text_hash"),
        F.sha2(F.array_join(tags, " "), 256).alias("elements_hash"),
        F.regexp_count("html", F.lit('href="javascript:void\\(0\\)" rel="nofollow"')).cast("long").alias("dead_links"),
        F.regexp_count("html", F.lit('href="https?://')).cast("long").alias("live_links"),
        F.coalesce(F.col("html").rlike("(?i)<script|<style|<nav|<article|<img|<!--|onclick="), F.lit(False)).alias("unsafe"),
    )


# the tables' pages hold no angle brackets in texts and attributes, so plain patterns find the same text and elements
_LISTED = ", ".join(f"'{x}'" for x in sorted(ELEMENTS))
ORACLE_SQL = f"""WITH b AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) ELSE html END, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<title.*?</title>', '', 'g') AS b FROM pages),
 t AS (SELECT page_id, b, replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"') AS t FROM b)
 SELECT page_id, sha256(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS text_hash, sha256(array_to_string(list_filter(regexp_extract_all(b, '<([a-z][a-z0-9]*)', 1), lambda x: x IN ({_LISTED})), ' ')) AS elements_hash,
 len(regexp_extract_all(b, '<a href="/')) AS dead_links, len(regexp_extract_all(b, '<a href="https?://')) AS live_links, false AS unsafe FROM t"""
QUERIES = {"html_sanitize": (html_sanitize, ORACLE_SQL)}
