"""Katz backoff scoring of texts.

The model is over word tokens (A-Z lower-cased, words, an end mark): word pairs back off to words, and a word that no
training text holds counts as one more kind, as in the base score. Counts up to ``K`` are discounted by Good-Turing with
the counts of counts of all texts; the weight of the order below is what makes each context's probabilities sum to 1. A
context whose counts are all too large to be discounted gets one more unit in its denominator, so that it leaves
something to unseen words. Nothing of the size of the vocabulary is collected or broadcast:

* Documents are dealt to blocks by a hash of their id and text; a block sends each of its distinct words and pairs once,
  packed and dealt to buckets by the pair's last word, so a frequent pair has one entry per block.
* A bucket knows the counts of its words and pairs. It answers each block with them, in the order of the block's own
  entries, and sends what it adds to each context (the word before) to the context's bucket: counts and counts of counts,
  from which discounted mass and the mass of the order below follow once the discounts are known.
* A context's bucket sums these and answers each block with the denominators and backoff weights of its own words.
* Each block scores its texts with the two answers.

Words are told apart by 64-bit hashes. Defined results: null text is empty and has one token, its end; a null id counts
as the empty text for the split and is trained on; repeated rows are scored alike; without training texts every token is
of the one unknown kind and all scores are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlens.llm.scratch import durable
from cinderlens.llm.text import WordHasher, lookup, utf8

#: Counts up to this one are discounted.
K = 5
#: Bytes of text in a block.
BLOCK_BYTES = 20_000_000
#: Contexts in a message, and bytes of messages that are written and read at once.
CONTEXTS = 1024
GROUP_BYTES = 8_000_000
#: Keys of the end token and of the context at the start.
END_KEY = np.uint64(1)
START_KEY = np.uint64(0)


def good_turing(counts: np.ndarray, k: int = K) -> np.ndarray:
    """Discount ratios for counts 0 .. k (place 0 unused). Where the counts of counts give no ratio in (0, 1), half a
    unit is taken off instead."""
    return ratios(np.array([0.0, *((counts == r).sum() for r in range(1, k + 2))]), k)


def ratios(n: np.ndarray, k: int = K) -> np.ndarray:
    """Discount ratios from the counts of counts ``n`` (places 1 .. k + 1)."""
    r = np.arange(1, k + 1)
    half = np.concatenate([[1.0], (r - 0.5) / r])
    if n[1:].min() == 0:
        return half
    common = (k + 1) * n[k + 1] / n[1]
    ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
    return np.concatenate([[1.0], ratio]) if ((ratio > 0) & (ratio < 1)).all() else half


def held_out(id_col: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether an id's text belongs to the held-out fold."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct tokens (the start first), the number of each token of each text, and how many a text has. The
    texts are taken off the list as they are read."""
    hasher = WordHasher()
    cut = []
    for i, text in enumerate(texts):
        cut.append(np.append(hasher.of(text)[0], END_KEY))
        texts[i] = b""
    sizes = np.array([len(c) for c in cut], np.int64)
    # the start's key is the smallest there is
    keys, number = np.unique(np.concatenate([np.array([START_KEY]), *cut]), return_inverse=True)
    return keys, number[1:].astype(np.int32), sizes


@dataclass
class Grams:
    """Distinct words and pairs of a block's texts. Words are ordered by bucket and key, pairs by last word and word before."""

    keys: np.ndarray
    pairs: np.ndarray
    word_at: np.ndarray
    pair_at: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], n_buckets: int) -> Grams:
        keys, now, sizes = _numbered(texts)
        order = np.lexsort((keys, keys % np.uint64(n_buckets)))
        keys = keys[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        start, now = rank[0], rank[now]
        code = now * np.int64(len(keys))
        code[1:] += now[:-1]
        first = np.cumsum(sizes) - sizes
        code[first] = now[first] * np.int64(len(keys)) + start
        pairs, pair_at = np.unique(code, return_inverse=True)
        return cls(keys, pairs, now, pair_at.astype(np.int32), sizes)

    @property
    def last(self) -> np.ndarray:
        return self.pairs // len(self.keys)

    @property
    def context(self) -> np.ndarray:
        return self.pairs % len(self.keys)


def _borders(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of the numbers 0 .. n - 1 starts in the sorted ``of``, and the end."""
    return np.searchsorted(of, np.arange(n + 1))


def _bytes(table: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table[column].to_pylist()]


def block_grams(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """A row for each block and bucket: the block's words ``w`` of the bucket, how many pairs end in each, and for these the
    word before and the count in training texts."""

    def run(table: pa.Table) -> pa.Table:
        grams = Grams.of(utf8(table["text"].combine_chunks()), n_buckets)
        trained = np.repeat(~np.array(table["held_out"].to_pylist(), bool), grams.sizes)
        counts = np.bincount(grams.pair_at[trained], minlength=len(grams.pairs)).astype(np.uint32)
        kinds = np.bincount(grams.last, minlength=len(grams.keys)).astype(np.uint32)
        of = _borders((grams.keys % np.uint64(n_buckets)).astype(np.int64), n_buckets)
        upto = np.concatenate([[0], np.cumsum(kinds, dtype=np.int64)])[of]
        used = np.flatnonzero(np.diff(of))
        before = grams.keys[grams.context]
        cut = lambda x, at: pa.array([x[at[b] : at[b + 1]].tobytes() for b in used], pa.binary())
        block = np.full(len(used), table["block"][0].as_py(), np.int32)
        return pa.table({"bucket": used.astype(np.int32), "block": block, "w": cut(grams.keys, of), "kinds": cut(kinds, of), "v": cut(before, upto), "c": cut(counts, upto)})

    return blocks.groupBy("block").applyInArrow(run, "bucket int, block int, w binary, kinds binary, v binary, c binary")


_MESSAGE = "kind string, bucket int, block int, a binary, b binary"


def count_grams_of_buckets(sent: DataFrame, n_buckets: int, k: int = K) -> DataFrame:
    """Messages: ``count`` (to a block: counts of its words and of its pairs), ``ask`` (the block's words), ``context`` (to a
    context's bucket: what is added to each context) and ``total`` (numbers of the bucket).

    A context's row is the sum of its pairs' counts, the sum of the last words' counts, and how many pairs, and last words,
    have each count from 1 to k."""

    def run(table: pa.Table) -> pa.Table:
        w, kinds, v, c = (_bytes(table, x, t) for x, t in (("w", np.uint64), ("kinds", np.uint32), ("v", np.uint64), ("c", np.uint32)))
        bucket, blocks = table["bucket"][0].as_py(), table["block"].to_pylist()
        own, word_at = np.unique(np.concatenate(w), return_inverse=True)
        contexts, context_at = np.unique(np.concatenate(v), return_inverse=True)
        code, pair_at = np.unique(np.repeat(word_at, np.concatenate(kinds)) * max(1, len(contexts)) + context_at, return_inverse=True)
        pairs = np.bincount(pair_at, weights=np.concatenate(c), minlength=len(code)).astype(np.int64)
        last, of = code // max(1, len(contexts)), code % max(1, len(contexts))
        singles = np.bincount(last, weights=pairs, minlength=len(own)).astype(np.int64)
        seen = pairs > 0
        mine, n, m = of[seen], pairs[seen], singles[last[seen]]
        count = lambda x: np.bincount(mine, weights=x, minlength=len(contexts)).astype(np.int64)
        added = np.stack([count(n), count(m), *(count(n == r) for r in range(1, k + 1)), *(count(m == r) for r in range(1, k + 1))])
        rows = [("total", bucket, 0, np.array([singles.sum(), (singles > 0).sum(), *((x == r).sum() for x in (singles, pairs) for r in range(1, k + 2))], np.int64), b"")]
        word_ends, pair_ends = np.cumsum([len(x) for x in w]), np.cumsum([len(x) for x in v])
        for i, block in enumerate(blocks):
            its = word_at[word_ends[i] - len(w[i]) : word_ends[i]]
            rows.append(("count", bucket, block, singles[its], pairs[pair_at[pair_ends[i] - len(v[i]) : pair_ends[i]]].astype(np.uint32).tobytes()))
            rows.append(("ask", bucket, block, w[i], b""))
        known = np.flatnonzero(added[0] > 0)
        to = (contexts[known] % np.uint64(n_buckets)).astype(np.int64)
        known = known[np.argsort(to, kind="stable")]
        at = _borders(np.sort(to), n_buckets)
        for b in np.flatnonzero(np.diff(at)).tolist():
            for start in range(at[b], at[b + 1], CONTEXTS):
                its = known[start : min(start + CONTEXTS, at[b + 1])]
                rows.append(("context", b, -1, contexts[its], np.ascontiguousarray(added[:, its]).tobytes()))
        return pa.Table.from_pylist([{"kind": x[0], "bucket": x[1], "block": x[2], "a": x[3].tobytes(), "b": x[4]} for x in rows], schema=_SCHEMA)

    return sent.groupBy("bucket").applyInArrow(run, _MESSAGE)


_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


@dataclass
class Discounts:
    """Discount ratios of words and pairs, the denominator of words, and the probability of an unknown word."""

    word: np.ndarray
    pair: np.ndarray
    words_total: float
    unknown: float

    @classmethod
    def of(cls, totals: np.ndarray, k: int = K) -> Discounts:
        """From the sums of ``total`` messages."""
        n = totals[0]
        ones, twos = (np.concatenate([[0.0], totals[2 + i * (k + 1) : 2 + (i + 1) * (k + 1)]]) for i in (0, 1))
        word, pair = ratios(ones, k), ratios(twos, k)
        off = ((1 - word[1:]) * np.arange(1, k + 1) * ones[1 : k + 1]).sum()
        total = float(n) if off > 0 else float(n + 1)
        return cls(word, pair, total, 1 - (n - off) / total)

    def words_left(self, c: np.ndarray) -> np.ndarray:
        """Probability of words with these counts; unknown ones share one."""
        return np.where(c > 0, c * self.word_ratio(c) / self.words_total, self.unknown)

    def word_ratio(self, c: np.ndarray) -> np.ndarray:
        return np.where(c < len(self.word), self.word[np.minimum(c, len(self.word) - 1)], 1.0)

    def pair_ratio(self, c: np.ndarray) -> np.ndarray:
        return np.where(c < len(self.pair), self.pair[np.minimum(c, len(self.pair) - 1)], 1.0)

    def contexts(self, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Denominators and backoff weights of contexts from their summed rows."""
        k = len(self.pair) - 1
        r = np.arange(1, k + 1)
        off = ((1 - self.pair[1:]) * r) @ added[2 : 2 + k]
        total = added[0] + (off <= 0)
        lower = (added[1] - ((1 - self.word[1:]) * r) @ added[2 + k : 2 + 2 * k]) / self.words_total
        return total.astype(np.float64), (1 - (added[0] - off) / total) / (1 - lower)


def context_weights(messages: DataFrame, discounts: Discounts, k: int = K) -> DataFrame:
    """``weight`` messages to blocks: denominators and backoff weights of their words as contexts; 1 for a new context."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        a, b = _bytes(table, "a", np.uint64), _bytes(table, "b", np.int64)
        sent = [i for i, x in enumerate(kinds) if x == "context"]
        contexts, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(a[i] for i in sent)]), return_inverse=True)
        added = np.concatenate([np.zeros((2 + 2 * k, 0), np.int64), *(b[i].reshape(2 + 2 * k, -1) for i in sent)], axis=1)
        total, weight = discounts.contexts(np.stack([np.bincount(at, weights=x, minlength=len(contexts)) for x in added]))
        rows = []
        for i, x in enumerate(kinds):
            if x == "ask":
                place, known = lookup(contexts, a[i])
                its = np.ones((2, len(a[i])))
                its[0, known], its[1, known] = total[place[known]], weight[place[known]]
                rows.append({"kind": "weight", "bucket": table["bucket"][i].as_py(), "block": table["block"][i].as_py(), "a": its[0].tobytes(), "b": its[1].tobytes()})
        return pa.Table.from_pylist(rows, schema=_SCHEMA)

    return messages.where("kind IN ('ask', 'context')").groupBy("bucket").applyInArrow(run, _MESSAGE)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # as many buckets as blocks
    n_blocks = max(1, text_bytes // block_bytes)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    messages = durable(count_grams_of_buckets(block_grams(blocks, n_blocks), n_blocks), "counts", group_bytes=GROUP_BYTES)
    # a row of 14 numbers per bucket
    totals = sum((np.frombuffer(r["a"], np.int64) for r in messages.where("kind = 'total'").select("a").toLocalIterator()), np.zeros(2 + 2 * (K + 1), np.int64))
    discounts = Discounts.of(totals)
    train_tokens, kinds = int(totals[0]), int(totals[1])
    replies = messages.where("kind = 'count'").unionByName(context_weights(messages, discounts))

    def run(table: pa.Table, reply: pa.Table) -> pa.Table:
        reply = reply.sort_by("bucket")
        counts, weights = (reply.filter(pa.compute.equal(reply["kind"], x)) for x in ("count", "weight"))
        grams = Grams.of(utf8(table["text"].combine_chunks()), n_blocks)
        singles, pairs = (np.concatenate([np.zeros(0, t), *_bytes(counts, x, t)]) for x, t in (("a", np.int64), ("b", np.uint32)))
        total, weight = (np.concatenate([np.zeros(0), *_bytes(weights, x, np.float64)]) for x in ("a", "b"))
        p = weight[grams.context] * discounts.words_left(singles)[grams.last]
        seen = np.flatnonzero(pairs)
        p[seen] = pairs[seen] * discounts.pair_ratio(pairs[seen]) / total[grams.context[seen]]
        sums = lambda x: np.add.reduceat(x, np.cumsum(grams.sizes) - grams.sizes)
        return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": grams.sizes, "n_known": sums((singles > 0)[grams.word_at].astype(np.int64)), "logs": sums(np.log10(singles + 0.5)[grams.word_at]), "score": sums(np.log10(p)[grams.pair_at])})

    scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + 0.5 * (kinds + 1))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


#: The base columns over ``documents``, with the split given as a list of ids.
BASE_SQL = r"""
WITH t AS (SELECT doc_id, held_out, unnest(list_append(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> ''), chr(10))) AS w FROM documents),
c AS (SELECT w, count(*) FILTER (NOT held_out) AS c FROM t GROUP BY w),
g AS (SELECT sum(c) AS n, count(*) FILTER (c > 0) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens, sum(log10((c + 0.5) / (n + 0.5 * (v + 1)))) AS base_score
FROM t JOIN c USING (w), g GROUP BY doc_id
"""
