"""Order MinHash fingerprints of whole texts, in DataFrame operations only.

A text's k-mers are its runs of ``k`` words (runs of characters other than 0x20 and 0x09-0x0D); each is numbered by its
occurrence, so that repeats count. ``2**POINT_BITS`` hash functions order them: the hashes of (k-mer, occurrence) are laid
on a circle, and function j goes round it from point j on, so its smallest k-mers are the next ones behind that point. For
each function the ``tuple_len`` smallest k-mers are taken, put back into text order and hashed together. A value thus
changes both when its k-mers change and when they change order, which makes the share of equal values follow the edit
distance, in short texts as well.

All per-text work is done on arrays of packed integers (hash in the upper, word position in the lower 26 bits): one sort
brings equal k-mers together in text order, which gives occurrence numbers; one more sort orders them on the circle, with
the points among them. Nothing is exploded, so a text never meets a shuffle as words.

Texts move once, to range parts of the order of documents: parts are made from ids and hashes, and the first document
of the next part visits each part as its last row, so that a window finds every document's next one in place.

Defined results: null is the empty text; a text without words has an empty fingerprint, and two empty ones have
likeness 1; a text of fewer than ``k`` words is one k-mer; a text of fewer k-mers than ``tuple_len`` has tuples of all of
them; equal texts have equal fingerprints; repeated rows get equal results and are one document in the order; rows with
equal ids are ordered by a hash of the text; null ids come last in descending order; a document that is alone is its own
next one; positions wrap after 2**26 - 1 words, which affects order inside a tuple only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlens.llm.rows import anti_join, semi_join
from cinderlens.llm.scratch import durable

K = 3
TUPLE_LEN = 2
POINT_BITS = 6
#: The largest position marks the points of the circle.
_POSITION = (1 << 26) - 1
#: Range parts for each shuffle partition.
PARTS = 4


def _pack(value: Column, position: Column) -> Column:
    return value.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(position % _POSITION)


def _indices(n: Column) -> Column:
    """0, ..., n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, tuple_len: int = TUPLE_LEN, point_bits: int = POINT_BITS) -> DataFrame:
    """``df`` with ``out``, an array of one integer per hash function: its number in the top bits, the tuple's hash below;
    empty for a text without words."""
    made = [f"__{out}_{x}" for x in ("words", "kmers", "again", "starts", "circle", "round", "points")]
    w, s, again, at, t, ring, points = made
    get = lambda name, i: F.get(F.col(name), i)
    plain = F.coalesce(F.col(text), F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    df = df.withColumn(w, F.array_remove(F.split(plain, " "), ""))
    n_kmers = F.when(F.size(w) > 0, F.greatest(F.size(w) - (k - 1), F.lit(1))).otherwise(F.lit(0))
    kmers = F.transform(_indices(n_kmers), lambda i: _pack(F.xxhash64(*(get(w, i + j) if j else get(w, i) for j in range(k))), i.cast("long")))
    df = df.withColumn(s, F.sort_array(kmers))
    key = lambda x: F.shiftright(x, 26)
    # a k-mer's first place keeps its hash; each further one hashes it with the occurrence's number
    df = df.withColumn(again, F.filter(F.col(s), lambda x, i: key(x) == key(get(s, i - 1))))
    df = df.withColumn(at, F.filter(_indices(F.size(again)), lambda i: (i == 0) | (key(get(again, i)) != key(get(again, i - 1)))))
    number = lambda x, nth: _pack(F.xxhash64(key(x), nth), x.bitwiseAND(F.lit(_POSITION)))
    length = lambda j: F.coalesce(get(at, j + 1), F.size(again)) - get(at, j)
    others = F.flatten(F.transform(_indices(F.size(at)), lambda j: F.transform(F.slice(F.col(again), get(at, j) + 1, length(j)), lambda x, nth: number(x, nth + 1))))
    df = df.withColumn(t, F.when(F.size(again) == 0, F.col(s)).otherwise(F.concat(F.array_except(s, again), others)))
    marks = F.array(*(F.lit(((j << (64 - point_bits)) | _POSITION) - (1 << 64 if j >> (point_bits - 1) else 0)) for j in range(1 << point_bits)))
    df = df.withColumn(ring, F.sort_array(F.concat(t, marks)))
    is_point = lambda x: x.bitwiseAND(F.lit(_POSITION)) == _POSITION
    df = df.withColumn(points, F.filter(_indices(F.size(ring)), lambda i: is_point(get(ring, i))))
    n = F.size(t)
    # the k-mers alone, in order, and the first ones once more behind the last
    df = df.withColumn(t, F.filter(F.col(ring), lambda x: ~is_point(x)))
    df = df.withColumn(ring, F.concat(F.col(t), F.slice(F.col(t), 1, tuple_len - 1)))

    def value(point: Column, j: Column) -> Column:
        own = F.slice(F.col(ring), (point - j) % n + 1, F.least(n, F.lit(tuple_len)))
        in_text_order = F.sort_array(F.transform(own, lambda x: F.shiftleft(x, 38).bitwiseOR(F.shiftrightunsigned(x, 26))))
        hashed = F.xxhash64(F.transform(in_text_order, lambda x: x.bitwiseAND(F.lit((1 << 38) - 1))))
        return F.shiftleft(j.cast("long"), 32 - point_bits).bitwiseOR(F.shiftrightunsigned(hashed, 32 + point_bits))

    return df.withColumn(out, F.when(n > 0, F.transform(F.col(points), value)).otherwise(F.array().cast("array<long>"))).drop(*made)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal values; 1 for two empty fingerprints, 0 for an empty one and another."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1)))


def as_string(fingerprint: Column) -> Column:
    """Eight hexadecimal digits per bin."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v), 8, "0")), "")


def ordered_parts(keys: DataFrame, parts: int) -> list[tuple]:
    """The first (id, tie) of each range part of the distinct keys, in order: at most ``parts`` rows."""
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    placed = keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    first = F.struct(F.col("id").isNull().alias("none"), (-F.col("id")).alias("back"), F.col("tie"), F.col("id"))
    heads = placed.groupBy("part").agg(F.min(first).alias("head")).orderBy("head").collect()
    return [(r["head"]["id"], r["head"]["tie"]) for r in heads]


def with_part(rows: DataFrame, heads: list[tuple]) -> DataFrame:
    """``rows`` (``id, tie``) with ``part``: how many heads come before or at the row, less one. The heads are searched in
    two steps, of the square root of their number each."""
    step = math.isqrt(len(heads) - 1) + 1
    kind = "array<struct<id: long, tie: long>>"
    # one row
    bounds = rows.sparkSession.createDataFrame([(heads[::step], heads)], f"coarse {kind}, fine {kind}")
    upto = lambda h: F.when(F.col("id").isNull(), h["id"].isNotNull() | (h["tie"] <= F.col("tie"))).otherwise((h["id"] > F.col("id")) | ((h["id"] == F.col("id")) & (h["tie"] <= F.col("tie"))))
    rows = rows.crossJoin(F.broadcast(bounds)).withColumn("at", F.greatest(F.size(F.filter("coarse", upto)) - 1, F.lit(0)) * step)
    inside = F.size(F.filter(F.slice("fine", F.col("at") + 1, F.lit(step)), upto))
    return rows.withColumn("part", F.greatest(F.col("at") + inside - 1, F.lit(0))).drop("coarse", "fine", "at")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "tie", F.col("id").isNull()))
    keys = durable(rows.groupBy("id", "tie", "key").agg(F.count("*").alias("times")), "keys")
    again = durable(keys.where("times > 1").select("key", "times"), "again")
    heads = ordered_parts(keys.select("id", "tie"), PARTS * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if not heads:
        heads = [(None, 0)]
    single = anti_join(rows, again, "key").unionByName(semi_join(rows, again, "key").dropDuplicates(["key"]))
    placed = with_part(single, heads).withColumn("guest", F.lit(False))
    # the first document of each part visits the part before it; that of the first part visits the last one
    starts = docs.sparkSession.createDataFrame([(i, t, (k - 1) % len(heads)) for k, (i, t) in enumerate(heads)], "hid long, htie long, part int")
    guests = single.join(F.broadcast(starts), F.col("id").eqNullSafe(F.col("hid")) & (F.col("tie") == F.col("htie"))).drop("hid", "htie")
    everyone = placed.select("id", "tie", "key", "text", "part", "guest").unionByName(guests.withColumn("guest", F.lit(True)).select("id", "tie", "key", "text", "part", "guest"))
    # as many partitions as parts, so that parts that meet in one partition are a small share
    everyone = everyone.repartition(len(heads), "part")
    order = Window.partitionBy("part").orderBy("guest", F.col("id").desc_nulls_last(), "tie")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    found = everyone.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", n)
    found = found.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))).drop("next")
    found = with_fingerprint(found, "text", "own").drop("text")
    found = with_fingerprint(found.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "changed").drop("edited")
    found = found.withColumn("of_next", F.lead("own").over(order)).where("NOT guest")
    out = found.select(
        "key",
        F.col("id").alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("of_next")).alias("near_next"),
    )
    # repeated rows once for each row
    times = again.withColumnRenamed("key", "of")
    out = out.join(times, F.col("key") == F.col("of"), "left")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int")))).drop("key", "of", "times", "copy")
