"""Quality rules: text statistics, and perplexity under a modified Kneser-Ney model with bands by language.

The model's n-grams are those of the bytes inside words, counted by Spark over all texts (see ``in_word_grams``), and stay
in tables; the perplexity of a text is the mean over its words. The ``HELD`` most frequent n-grams have their scores in memory,
the others get theirs by a join; all scores are whole numbers, so where one is found changes nothing. Its expected spread falls with the number of words,
down to what texts of one language differ by anyway: the deviation from the language's median is divided by
sqrt(1 / n_words + 1 / ``SAME``). The bands are ``WIDTH`` quartile distances beyond the quartiles of this deviation among
the language's texts of at least ``MIN_WORDS`` words. A language's quartiles are averaged with those of all texts, which
count as ``POOLED`` texts more, so languages with few texts have bands as well. Quartiles are taken over hundredths, with
counts summed before the shuffle, so results agree between runs.

Defined results: null text is empty: no words, base_failed, not kept, and no perplexity; null language is a language of
its own; a language with one text has its median there, so the text is kept if it passes the rules; repeated rows get
equal results; an empty table gives an empty result. ``keep`` tells rows apart by all their columns, so rows without an id
or with the same one are judged on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlens.llm.in_word_grams import ORDER, UNIT, WordScores, gram_scores
from cinderlens.llm.rows import ROW, anti_join, with_row_key
from cinderlens.llm.scratch import durable
from cinderlens.llm.text import slices, utf8, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
WIDTH = 1.5
#: Texts of one language differ as much as the means of so many words would.
SAME = 1000
#: Texts as which the quartiles of all languages count in each of them.
POOLED = 100
#: N-grams whose scores every task has in memory.
HELD = 1 << 22
SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(own: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of this many words that the text holds at least twice."""
    n = len(own) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in own], np.uint64)
    if len(number) == len(own):
        return 0
    key = ids[:n].copy()
    for k in range(1, window):
        key = (key ^ (key >> np.uint64(29))) * _MULTIPLIER + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(own) + 1, np.int64)
    groups: dict[tuple, list[int]] = {}
    for i in np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist():
        groups.setdefault(tuple(own[i : i + window]), []).append(i)
    for places in groups.values():
        if len(places) > 1:
            covered[places] += 1
            np.subtract.at(covered, np.minimum(np.array(places) + window, len(own)), 1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    worded = [line for line in lines if line.split()]
    return len(worded) - len(set(worded))


def statistics(text: bytes, own: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    return len(own), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), repeated_words(own)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``row, doc_id, lang``, the statistics, and ``log10_ppl`` (log10 perplexity per word) of every text; ``row`` is the
    key of the whole row."""
    scores = gram_scores(docs, text_col=text_col)
    frequent = scores.orderBy(F.desc("n"), "code").limit(HELD).select("code", "score").toArrow().sort_by("code")
    held = docs.sparkSession.sparkContext.broadcast((frequent["code"].to_numpy(), frequent["score"].to_numpy()))
    rows = with_row_key(docs).select(F.col(ROW).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rare_type = pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordScores(*held.value, ORDER)
        for batch in slices(batches):
            texts = utf8(batch.column(3))
            cut = [words(t) for t in texts]
            stats = np.array([statistics(t, own) for t, own in zip(texts, cut, strict=True)], np.int64).reshape(-1, 5)
            sums = scorer.of(cut)
            known = [Decimal(x) for x, _ in sums]
            rare = [[{"code": c, "times": n} for c, n in rest] for _, rest in sums]
            columns = [*map(pa.array, np.ascontiguousarray(stats.T)), pa.array(known, pa.decimal128(38, 0)), pa.array(rare, rare_type)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names)

    schema = "row long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, known decimal(38,0), rare array<struct<code: long, times: long>>"
    names = [x.split()[0] for x in schema.replace("<code: long, times: long>", "").split(", ")]
    read = durable(rows.mapInArrow(run, schema), "read")
    # equal rows have one key and the same n-grams
    rest = read.where("size(rare) > 0").select("row", F.inline("rare")).distinct().join(scores.select("code", "score"), "code").groupBy("row").agg(F.sum(F.col("times").cast("decimal(16,0)") * F.col("score").cast("decimal(18,0)")).cast("decimal(38,0)").alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0).cast("decimal(38,0)"))
    ppl = F.when(F.col("n_words") > 0, -total.cast("double") / UNIT / F.col("n_words"))
    return read.join(rest, "row", "left").select(*names[:-2], ppl.alias("log10_ppl"))


def _quartiles(binned: DataFrame, keys: list[str]) -> DataFrame:
    """``q1, q2, q3, texts`` by keys, from rows ``bin, n``."""
    w = Window.partitionBy(*keys).orderBy("bin")
    upto = binned.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bin"))) / 100
    return upto.groupBy(*keys).agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"), F.max("all").alias("texts"))


def deviations(scored: DataFrame) -> DataFrame:
    """``scored`` with ``deviation`` from the language's median in units of its expected spread. A language's counts by
    hundredth are few rows."""
    binned = scored.where(F.col("n_words") >= MIN_WORDS).groupBy("lang", F.floor(F.col("log10_ppl") * 100).alias("bin")).agg(F.count("*").alias("n"))
    medians = _quartiles(binned, ["lang"]).select(F.col("lang").alias("of"), "q2")
    out = scored.join(medians, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("deviation", (F.col("log10_ppl") - F.col("q2")) / F.sqrt(1 / F.greatest(F.col("n_words"), F.lit(1)) + F.lit(1 / SAME))).drop("q2")


def bands(deviating: DataFrame, width: float = WIDTH) -> DataFrame:
    """``band_lang, lower, upper`` of the deviation."""
    binned = deviating.where(F.col("n_words") >= MIN_WORDS).groupBy("lang", F.floor(F.col("deviation") * 100).alias("bin")).agg(F.count("*").alias("n"))
    binned = durable(binned, "bins")
    every = _quartiles(binned.groupBy(F.lit(0).alias("all_texts"), "bin").agg(F.sum("n").alias("n")), ["all_texts"]).select(F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    own = _quartiles(binned, ["lang"]).crossJoin(F.broadcast(every))  # one row
    mean = lambda q, a: (F.col(q) * F.col("texts") + F.col(a) * POOLED) / (F.col("texts") + POOLED)
    q1, q3 = mean("q1", "a1"), mean("q3", "a3") + 0.01
    return own.select(F.col("lang").alias("band_lang"), (q1 - width * (q3 - q1)).alias("lower"), (q3 + width * (q3 - q1)).alias("upper"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = WIDTH) -> DataFrame:
    """Scored texts with ``deviation, lower, upper, base_failed, kept``."""
    scored = deviations(durable(score_texts(docs, id_col, text_col, lang_col), "quality"))
    out = scored.join(bands(scored, width), F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    inside = F.col("deviation").between(F.col("lower"), F.col("upper"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(False)))


def keep(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    rejected = durable(judge(docs, **columns).where("NOT kept").select(F.col("row").alias(ROW)), "rejected")
    return anti_join(with_row_key(docs), rejected, ROW).select(*docs.columns)


def quality_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log10_ppl``."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log10_ppl")
