"""Byte n-grams inside words, counted by Spark over all texts.

A word is read as its bytes between start marks and an end mark, and every byte and end mark is predicted from the bytes
before it in the same word, up to ``ORDER - 1``. Words are independent of each other, so that odd words do not explain the
odd words next to them: a text in a style that few texts have stays improbable although the corpus holds such texts. All
256 byte values are told apart, and n-grams of all texts are counted. An n-gram of up to 7 bytes is one 64-bit number,
which serves as its hash, free of collisions.

The tables grow with the corpus and stay on Spark: the model's levels are tables that joins make of each other. Log
probabilities are whole numbers of ``UNIT`` parts, so sums do not depend on the order in which they are made, and it changes
nothing whether an n-gram is looked up in memory or by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlens.llm.kneser_ney import discounts_of
from cinderlens.llm.scratch import durable
from cinderlens.llm.text import lookup, slices, utf8, words

#: Bytes that no word holds.
START, END = b" ", b"\n"
SIZE = 256
ORDER = 5
#: Parts of one in log10 probabilities.
UNIT = 10**12
#: Distinct words that a task holds before it sends its counts.
HELD_WORDS = 80_000


def codes_of(own: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each word and at its end, as a number in base 256, and their number by word."""
    pad = order - 1
    lengths = np.fromiter(map(len, own), np.int64, len(own)) + 1
    if not len(lengths):
        return np.zeros(0, np.int64), lengths
    symbols = np.frombuffer(START * pad + (END + START * pad).join(own) + END, np.uint8).astype(np.int64)
    code = symbols.copy()
    for k in range(1, order):
        code[k:] += symbols[:-k] << (8 * k)
    starts = np.cumsum(lengths + pad) - lengths - pad
    inside = np.ones(len(symbols), bool)
    for k in range(pad):
        inside[starts + k] = False
    return code[inside], lengths


def count_grams(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """``code, n``: the n-grams of all texts and how often they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                held.update(words(text))
                if len(held) >= HELD_WORDS:
                    yield counted(held)
                    held.clear()
        if held:
            yield counted(held)

    def counted(held: Counter[bytes]) -> pa.RecordBatch:
        code, lengths = codes_of(list(held), order)
        code, at = np.unique(code, return_inverse=True)
        n = np.bincount(at, weights=np.repeat(np.fromiter(held.values(), np.int64, len(held)), lengths), minlength=len(code))
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

    return durable(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "grams")


def probabilities(grams: DataFrame, order: int) -> DataFrame:
    """``code, p`` of the n-grams ``code, n`` of the highest order: interpolated modified Kneser-Ney, as ``KneserNey``."""
    levels = [grams]
    for k in range(order - 1, 0, -1):
        levels.insert(0, durable(levels[0].groupBy((F.col("code") % SIZE**k).alias("code")).agg(F.count("*").alias("n")), "level"))
    lower = None
    for k, level in enumerate(levels):
        # four numbers
        few = {r["n"]: r["count"] for r in level.where("n <= 4").groupBy("n").count().collect()}
        d = [float(x) for x in discounts_of([float(few.get(r, 0)) for r in range(1, 5)])]
        rows = level.withColumn("context", F.shiftright("code", 8))
        n = F.col("n")
        held = [F.count_if(n == 1), F.count_if(n == 2), F.count_if(n > 2)]
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), sum(c * x for c, x in zip(held, d, strict=True)).alias("off"))
        rows = rows.join(contexts, "context")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / SIZE))
        else:
            rows = rows.join(lower.select(F.col("code").alias("suffix"), F.col("p").alias("below")), F.col("code") % SIZE**k == F.col("suffix"))
        off = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        lower = durable(rows.select("code", ((n - off) / F.col("total") + F.col("off") / F.col("total") * F.col("below")).alias("p")), "level")
    return lower


def gram_scores(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """``code, n, score``: log10 probabilities of the n-grams of all texts under the model of these texts, in units of
    ``1 / UNIT``."""
    grams = count_grams(docs, order, text_col)
    scored = probabilities(grams, order).select("code", F.round(F.log10("p") * UNIT).cast("long").alias("score"))
    return durable(grams.join(scored, "code"), "scores")


class WordScores:
    """Scores of words, worked out when a task first meets them: the sum over the n-grams that are held, and the others."""

    #: Words kept for reuse.
    KEPT = 250_000

    def __init__(self, codes: np.ndarray, scores: np.ndarray, order: int):
        self.codes, self.scores, self.order = codes, scores, order
        self.known: dict[bytes, tuple[int, list[int]]] = {}

    def of(self, texts: list[list[bytes]]) -> list[tuple[int, list[tuple[int, int]]]]:
        """Of each text the sum, and the n-grams that are not held with their numbers."""
        if len(self.known) > self.KEPT:
            self.known.clear()
        new = list({w for own in texts for w in own if w not in self.known})
        if new:
            self._learn(new)
        out = []
        for own in texts:
            found = list(map(self.known.__getitem__, own))
            rest = Counter(code for _, codes in found if codes for code in codes)
            out.append((sum(x for x, _ in found), sorted(rest.items())))
        return out

    def _learn(self, new: list[bytes]) -> None:
        code, lengths = codes_of(new, self.order)
        at, seen = lookup(self.codes, code)
        score = np.zeros(len(code), np.int64)
        score[seen] = self.scores[at[seen]]
        starts = np.cumsum(lengths) - lengths
        # in two parts, as a word may have any length
        high, low = np.add.reduceat(score >> 20, starts).tolist(), np.add.reduceat(score & 0xFFFFF, starts).tolist()
        rest: dict[int, list[int]] = {}
        for k in np.flatnonzero(~seen).tolist():
            rest.setdefault(int(np.searchsorted(starts, k, "right")) - 1, []).append(int(code[k]))
        self.known.update((w, ((h << 20) + x, rest.get(i, []))) for i, (w, h, x) in enumerate(zip(new, high, low, strict=True)))
