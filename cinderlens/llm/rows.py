"""Keys of whole rows, and semi and anti joins that move few of the rows.

A table of documents is large by its texts, while the keys to keep or to drop are few and short. A bit field over the
keys (64 bits a row, at most ``WORDS`` rows, so its broadcast has a fixed bound) tells for most rows that their key is
not among them, in place; only the rows that it cannot tell go to an exact join. With more keys than bits it tells
nothing and the join does all the work: the result is the same. That join is a merge join at any size, so that what is
moved grows in proportion to the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlens.llm.scratch import durable

#: Rows of the bit field: 16 million bits.
WORDS = 1 << 18
ROW = "__row"


def with_row_key(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with a 64-bit hash of these columns (all, if none are given); rows that are equal in them have equal keys."""
    columns = columns or df.columns
    return df.withColumn(ROW, F.xxhash64(*columns, *(F.col(c).isNull() for c in columns)))


def _word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(WORDS))


def _bit(key: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(key), F.lit(64)))


def _field(keys: DataFrame, key: str) -> DataFrame:
    return durable(keys.groupBy(_word(F.col(key)).alias("__word")).agg(F.bit_or(_bit(key)).alias("__bits")), "field")


def _asked(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with ``__maybe``: false for rows whose key is not among the keys."""
    # at most WORDS rows of 16 bytes
    asked = df.withColumn("__at", _word(F.col(key))).join(F.broadcast(_field(keys, key)), F.col("__at") == F.col("__word"), "left")
    return asked.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(_bit(key)) != 0, F.lit(False))).drop("__at", "__word", "__bits")


def maybe_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among those of ``keys``, and some more; nothing is moved."""
    return _asked(df, keys, key).where("__maybe").select(*df.columns)


def semi_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among those of ``keys`` (a column of the same name)."""
    return _asked(df, keys, key).where("__maybe").drop("__maybe").join(keys.select(key).distinct().hint("merge"), key, "left_semi").select(*df.columns)


def anti_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among those of ``keys``."""
    asked = _asked(df, keys, key)
    rest = asked.where("__maybe").drop("__maybe").join(keys.select(key).distinct().hint("merge"), key, "left_anti")
    return asked.where("NOT __maybe").select(*df.columns).unionByName(rest.select(*df.columns))
