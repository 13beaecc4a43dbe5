"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources are ordered by code point (null last) and weighted by a repeating list. Together they are to give ``share`` of
all words, each at most ``max_copies`` times its own size; what a source cannot give is reshared by weight among the
others. A source that must give e.g. 1.3 times its size takes one whole copy of every document for certain, and the
remaining 0.3 of its words by Pareto order sampling: every document has a fixed random number u, its inclusion chance is
c * size ** ``tilt``, at most 1, with the source's c such that the expected words of the sample are the wanted ones, and
documents are taken in order of (u / (1 - u)) / (chance / (1 - chance)) until the words are nearest to the target. A
document whose chance is 1 is taken for certain. Longer documents are more likely; ``tilt=0`` gives all of a source the
same chance.

The order is not made with one sort per source: ranks are put into ``bins`` equal ranges, words are summed by source and
bin, and only the documents of the one bin at the border are ordered by a window. A source with any share of all rows is
thus aggregated before its shuffle, the window sees 1 / bins of it, and what is known by source is joined by source and
one of ``SALTS`` numbers, which splits the rows of a large source.

Defined results: null text has no words and is never taken; a null source is a source of its own; a repeated document
id draws the same random number and is ordered by its text's hash; a source without words has target 0; an empty table
gives no rows. Reruns agree, as u comes from a hash of the id. ``take`` tells rows apart by all their columns; of rows
that are equal in all of them it returns as many as all of them together are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlens.llm.rows import ROW, anti_join, semi_join, with_row_key
from cinderlens.llm.scratch import durable

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words wanted in all, as a share of all words there are.
SHARE = 1.5
#: No source and no document is taken more often than this.
MAX_COPIES = 2.0
#: Ranges of the rank in which words are summed.
BINS = 4096
#: Power of a document's size in its inclusion chance.
TILT = 0.5
#: Parts that the rows of a source are split into for joins.
SALTS = 64


def word_count(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    cut = F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +")
    return F.coalesce(F.size(F.array_remove(cut, "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_copies: float = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``. One row per source goes through the windows.

    With sources in order of cap / weight, the level left for the rest after the first ones took their caps is
    (wanted - their caps) / (all weights - theirs); a source gets the smaller of its cap and its weight times the level
    of the first source that stays below its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("at", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights)).cast("int") + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_copies))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("wanted", F.sum("source_size").over(every) * F.lit(share)).withColumn("weights", F.sum("weight").over(every))
    per = per.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    below = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("at"), F.col("level")))).over(every)
    per = per.withColumn("final", below["level"])
    target = F.when(F.col("final").isNull() | (F.col("cap") <= F.col("final") * F.col("weight")), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def _attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per key; rows of one key are split by a salt."""
    salted = table.withColumnRenamed(key, "__key").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS)) == F.col("__salt")
    return rows.join(salted, (F.col(key) == F.col("__key")) & own, "left").drop("__key", "__salt")


def chances(rows: DataFrame, tilt: float) -> DataFrame:
    """``group, scale, certain_from`` of each group of ``rows`` (``group, size, want``): a document's chance is
    scale * size ** tilt, and 1 from that size on. The window sees one row per group and distinct size."""
    sizes = rows.where("size > 0").groupBy("group", "size").agg(F.count("*").alias("n"), F.first("want").alias("want"))
    falling = Window.partitionBy("group").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rising = Window.partitionBy("group").orderBy(F.col("size").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sizes = sizes.withColumn("certain", F.coalesce(F.sum(F.col("size") * F.col("n")).over(falling), F.lit(0)))
    sizes = sizes.withColumn("scale", (F.col("want") - F.col("certain")) / F.sum(F.col("n") * F.pow(F.col("size").cast("double"), F.lit(1 + tilt))).over(rising))
    # the largest size, with all above it certain, whose own chance stays below 1
    open_ = F.col("scale") * F.pow(F.col("size").cast("double"), F.lit(tilt)) < 1
    return sizes.groupBy("group").agg(F.max(F.when(open_, F.col("size"))).alias("largest_open"), F.max_by("scale", F.when(open_, F.col("size"))).alias("scale"))


def _draw(rows: DataFrame, bins: int, last: bool) -> DataFrame:
    """``rows`` with ``drawn`` raised for those that this pass draws: of the documents that are not drawn yet, have words
    and, in the last pass, are no longer than what is wanted, in rank order until ``want`` is reached. The document that
    crosses the target is drawn in the last pass, if that comes nearer to it."""
    left = rows.groupBy("group").agg((F.first("want") - F.sum(F.col("drawn") * F.col("size"))).alias("left"))
    rows = _attach(rows, left, "group")
    free = (F.col("drawn") == 0) & F.col("odds").isNotNull() & (F.col("size") > 0) & (F.col("left") > 0)
    free = free & (F.col("size") <= F.col("left")) if last else free
    rows = rows.withColumn("bin", F.when(free, F.floor(F.col("odds") / (1 + F.col("odds")) * bins).cast("int")))
    by_bin = rows.where("bin IS NOT NULL").groupBy("group", "bin").agg(F.sum("size").alias("bin_size"), F.first("left").alias("left"))
    w = Window.partitionBy("group").orderBy("bin")
    borders = by_bin.withColumn("upto", F.sum("bin_size").over(w))
    borders = borders.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("bin_size") < F.col("left")))
    borders = borders.select("group", F.col("bin").alias("border"), (F.col("left") - F.col("upto") + F.col("bin_size")).alias("room"))
    marked = _attach(rows, borders, "group")
    inside = F.coalesce(F.col("bin") == F.col("border"), F.lit(False))
    # without a border all that is free fits
    below = F.coalesce((F.col("bin") < F.col("border")) | (F.col("bin").isNotNull() & F.col("border").isNull()), F.lit(False))
    fixed = marked.where(~inside).withColumn("take", below)
    ranked = Window.partitionBy("group").orderBy("odds", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    at_border = marked.where(inside).withColumn("upto", F.sum("size").over(ranked))
    over, short = F.col("upto") - F.col("room"), F.col("room") - (F.col("upto") - F.col("size"))
    at_border = at_border.withColumn("take", (over <= short) if last else (over <= 0)).drop("upto")
    out = fixed.unionByName(at_border)
    return out.withColumn("drawn", F.when(F.col("take"), 1).otherwise(F.col("drawn"))).drop("take", "bin", "border", "room", "left")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_copies: float = MAX_COPIES, seed: int = 7, tilt: float = TILT, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row, doc_id, source, size, source_size, target, chance, copies, taken`` of every document; ``row`` is the key of
    the whole row, ``chance`` that of the copy beside the whole ones, and ``taken = copies * size``."""
    rows = with_row_key(docs).select(F.col(ROW).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"))
    group = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = durable(rows, "mix").withColumn("group", group)
    targets = durable(source_targets(rows, weights, share, max_copies), "targets").select(group.alias("group"), "source_size", "target")
    joined = _attach(rows, targets, "group")
    expected = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    joined = joined.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    joined = joined.withColumn("want", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)) * F.col("source_size")).drop("expected")
    joined = _attach(joined, chances(joined, tilt), "group")
    chance = F.when((F.col("size") <= 0) | (F.col("want") <= 0), F.lit(0.0)).when(F.col("size") <= F.col("largest_open"), F.col("scale") * F.pow(F.col("size").cast("double"), F.lit(tilt))).otherwise(F.lit(1.0))
    joined = joined.withColumn("chance", chance).drop("largest_open", "scale")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    c = F.least(F.col("chance"), F.lit(1 - 1e-9))
    joined = joined.withColumn("odds", F.when(c > 0, (u / (1 - u)) / (c / (1 - c)))).withColumn("drawn", F.lit(0))
    # the second pass fills the gap that a long document at the border leaves
    first = durable(_draw(joined, bins, last=False), "draw")
    out = _draw(first, bins, last=True)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("drawn")).otherwise(F.lit(0)).cast("long")
    return out.withColumn("copies", copies).select("row", "doc_id", "source", "size", "source_size", "target", "chance", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    copies = mix(docs, **parameters).groupBy(F.col("row").alias(ROW)).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__times"))
    copies = durable(copies.where("__copies > 0 OR __times > 1"), "copies")
    rows = with_row_key(docs)
    again = copies.where("__times > 1").select(ROW)
    once = anti_join(rows, again, ROW).unionByName(semi_join(rows, again, ROW).dropDuplicates([ROW]))
    # a merge join at any size, as texts are moved
    taken = once.join(copies.where("__copies > 0").select(ROW, "__copies").hint("merge"), ROW)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
