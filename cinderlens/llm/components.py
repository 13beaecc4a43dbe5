"""Connected components of a link table by smallest label, with pointer jumping.

Each round takes the smallest label among a vertex and its neighbours, and then the label of that label, so the number
of rounds grows with the logarithm of the longest shortest path in usual graphs. Labels are written after each round.
A vertex with very many links is combined before the shuffle; joins at such a vertex are split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlens.llm.scratch import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, label`` for every vertex of the links; the label is the smallest vertex of its component."""
    both = durable(links.select(F.explode(F.array(F.struct(F.col(a).alias("v"), F.col(b).alias("u")), F.struct(F.col(b).alias("v"), F.col(a).alias("u")))).alias("e")).select("e.*"), "links")
    labels = durable(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("v").alias("mid"), F.col("label").alias("far"))
        step = durable(hooked.join(jump, "mid", "left").select("v", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        labels = step.select("v", "label")
        if not step.where("old <> label").limit(1).count():
            return labels
