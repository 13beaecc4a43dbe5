"""HTML fragments as Column expressions: rows and cells of tables, plain text, numbers and class names in cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities in the order in which they are replaced; fixed values. What "&amp;" gives is not decoded again.
ENTITIES = (("&raquo;", "»"), ("&laquo;", "«"), ("&rsaquo;", "›"), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&nbsp;", " "), ("&quot;", '"'), ("&#187;", "»"), ("&#171;", "«"))
#: What follows a class name in a cell and is no part of it, in the order of removal; fixed values.
CLASS_NOTES = (
    (r"@?\s*0x[0-9a-fA-F]+", ""),
    (r"»\s*", " "),
    (r"[»›‹«]", ""),
    (r"(?i)\bOnly\s+object\b.*", ""),
    (r"(?i)\bFirst\s+[\d,]+\s+of\s+[\d,]+\s+objects?\b.*", ""),
    (r"(?i)\bAll\s+[\d,]+\s+objects?\b.*", ""),
    (r"(?i)\bOnly\s+[\d,]+\s+objects?\b.*", ""),
    (r"(?s)\s*\.{2,}.*$", ""),
)
#: Names of class loaders: parts, ends and starts; fixed values.
LOADER_PARTS = ("classloader",)
LOADER_ENDS = ("contextloader",)
LOADER_STARTS = ("sun.misc.launcher", "jeus.servlet.loader.", "weblogic.utils.classloaders.", "org.apache.catalina.loader.", "org.springframework.boot.loader.")


def decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain(html: Column) -> Column:
    """Tags to spaces, white space squeezed."""
    return squeezed(F.regexp_replace(html, "<[^>]+>", " "))


def upto(tag: str) -> str:
    """A pattern of what stands before the next such tag, and the tag. Text without tags is passed over at once."""
    return f"((?:[^<]++|(?!{tag})<)*+){tag}"


def table_rows(html: Column) -> Column:
    """The inner HTML of the rows that are no header rows, in order."""
    return F.filter(F.regexp_extract_all(html, F.lit(f"(?is)<tr[^>]*>{upto('</tr>')}"), F.lit(1)), lambda row: ~row.contains("<th"))


def header_cells(html: Column) -> Column:
    """Plain text of header cells."""
    return F.transform(F.regexp_extract_all(html, F.lit(f"(?is)<th[^>]*>{upto('</th>')}"), F.lit(1)), plain)


def cells(row: Column) -> Column:
    """The inner HTML of a row's cells."""
    return F.regexp_extract_all(row, F.lit(f"(?is)<td[^>]*>{upto('</td>')}"), F.lit(1))


def lenient(text: Column) -> Column:
    """A whole number with commas and blanks in it; 0 for anything else."""
    return F.coalesce(F.regexp_replace(text, r"[,\s]", "").try_cast("long"), F.lit(0))


def digits(text: Column) -> Column:
    """The number that a text's digits make; 0 without any."""
    return F.coalesce(F.regexp_replace(text, r"[^\d]", "").try_cast("long"), F.lit(0))


def class_name(cell: Column) -> Column:
    """The class named in a cell's plain text."""
    out = decoded(cell)
    for pattern, by in CLASS_NOTES:
        out = F.regexp_replace(out, pattern, by)
    return squeezed(out)


def object_class(cell: Column) -> Column:
    """As ``class_name``, without a leading "class" and the mark of system classes."""
    return F.trim(F.replace(F.regexp_replace(class_name(cell), "^class ", ""), F.lit("System Class"), F.lit("")))


def address(cell: Column) -> Column:
    """The first hexadecimal address, or null."""
    hit = F.regexp_extract(cell, "(0x[0-9a-fA-F]+)", 1)
    return F.when(hit != "", hit)


def is_loader(name: Column) -> Column:
    low = F.lower(name)
    parts, ends, starts = ("|".join(x.replace(".", r"\.") for x in texts) for texts in (LOADER_PARTS, LOADER_ENDS, LOADER_STARTS))
    return low.rlike(rf"(?s)^(?:{starts})|{parts}|(?:{ends})\z")
