"""What stands before a closing tag is read without a step per character, and is what a lazy pattern finds."""

import re

from pyspark.sql import functions as F

from cinderlens.functions import html as H

ODD = ["<td>a</td><TD x='1'>b<b>c</b></Td>", "<td>open<td>in</td>", "<td></td", "<td>a<</td>", "<td>\n<</tr></td><td>é</td>", "</td><td", ""]


def test_upto_finds_what_a_lazy_pattern_finds():
    for text in ODD:
        assert re.findall(f"(?is)<td[^>]*>{H.upto('</td>')}", text) == re.findall("(?is)<td[^>]*>(.*?)</td>", text)


def test_long_cells(spark):
    row = spark.range(1).select(F.concat(F.lit("<td>"), F.repeat(F.lit("<b>x</b>"), 200_000), F.lit("</td>")).alias("h"))
    assert [len(x) for x in row.select(H.cells(F.col("h")).alias("c")).first()["c"]] == [1_600_000]
