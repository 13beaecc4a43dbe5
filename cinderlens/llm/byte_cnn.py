"""Quality of texts by a convolutional network over bytes.

A filter looks at ``WIDTH`` bytes from each byte of a text on; bytes are vectors that are learned too, so its answer is a sum
of entries of ``WIDTH`` tables of 256 bytes. Answers are max-pooled over overlapping chunks of ``CHUNK`` bytes, one begun
every ``STEP``, which cover the whole text however long it is. Mean, maximum and minimum over a text's chunks go through one
hidden layer into a probability.

The network is learned in numpy with backpropagation on a bounded sample: at most ``rows`` labelled documents, as many of
either label, the first ones in order of a hash of the id, and at most ``pieces`` chunks of each, spread evenly over its
text. The share of the labels in all labelled documents is put back into the last bias. Scoring reads all bytes of all
texts; the network's tables, some 100 KB, go to the tasks with the function.

Defined results: null text is empty, and an empty text is one chunk of padding; labels of ids that are null, and null and
contradictory labels, are left out; of documents with one id the sample has one; a null id is not held out; with labels of
one kind only, or none, all scores are that kind's share, smoothed by one of each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlens.llm.text import slices, utf8

#: Bytes that a filter sees, filters, numbers of a byte, hidden units.
WIDTH, FILTERS, EMBED, HIDDEN = 7, 16, 10, 16
#: Windows of a block, of a chunk, and from one chunk to the next.
BLOCK, CHUNK, STEP = 64, 256, 192
#: Labelled documents and chunks of one that are learned from.
ROWS, PIECES = 4000, 16
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.01, 1e-4
#: Windows that are worked on at once.
AT_ONCE = 1 << 15


@dataclass
class Network:
    """The learned numbers; ``chars``: a row of each byte."""

    chars: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    hidden: np.ndarray
    hidden_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    def tables(self) -> np.ndarray:
        """What each place of a filter adds for each byte: ``WIDTH`` x 256 x ``FILTERS``."""
        return np.ascontiguousarray(np.einsum("be,wef->wbf", self.chars, self.filters).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.chars, self.filters, self.shift, self.hidden, self.hidden_shift, self.out, self.out_shift]


def fresh(seed: int) -> Network:
    """A network to learn from: bytes begin as what kind of character they are, with some noise."""
    rng = np.random.default_rng(seed)
    byte = np.arange(256)
    kinds = [(byte >= 65) & (byte <= 90), (byte >= 97) & (byte <= 122), (byte >= 48) & (byte <= 57), (byte == 32), (byte < 32) & (byte > 0), byte >= 128, byte == 0]
    other = ~np.any(kinds, axis=0)
    chars = rng.normal(0, 0.15, (256, EMBED))
    for k, kind in enumerate([*kinds, other]):
        chars[kind, k] += 1
    scale = np.sqrt(1 / (WIDTH * 1.5))
    return Network(chars, rng.normal(0, scale, (WIDTH, EMBED, FILTERS)), np.full(FILTERS, -0.5), rng.normal(0, np.sqrt(1 / (3 * FILTERS)), (3 * FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1))


def chunk_count(blocks: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-(blocks - 1) * BLOCK // STEP))


# ---- scoring


def block_maxima(data: np.ndarray, windows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The largest answers in each block of ``BLOCK`` windows; ``windows`` says where a window stands. ``data`` is
    ``WIDTH - 1`` bytes longer."""
    out = np.empty((len(windows) // BLOCK, FILTERS), np.float32)
    for s in range(0, len(windows), AT_ONCE):
        n = min(AT_ONCE, len(windows) - s)
        total = tables[0][data[s : s + n]]
        for j in range(1, WIDTH):
            total += tables[j][data[s + j : s + j + n]]
        total[~windows[s : s + n]] = -np.inf
        out[s // BLOCK : (s + n) // BLOCK] = total.reshape(-1, BLOCK, FILTERS).max(1)
    return out


def pooled(texts: list[bytes], tables: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Mean, maximum and minimum over the chunks of each text. Texts stand one behind the other, each from the start of a
    block on and followed by at least ``WIDTH - 1`` zeros."""
    sizes = np.array([max(1, len(t)) for t in texts])
    blocks = -(-sizes // BLOCK)
    room = -(-(sizes + WIDTH - 1) // BLOCK)
    starts = np.concatenate([[0], np.cumsum(room)])
    data = np.zeros(int(starts[-1]) * BLOCK + WIDTH - 1, np.uint8)
    windows = np.zeros(int(starts[-1]) * BLOCK, bool)
    for t, n, s in zip(texts, sizes.tolist(), (starts * BLOCK).tolist(), strict=False):
        data[s : s + len(t)] = np.frombuffer(t, np.uint8)
        windows[s : s + n] = True
    top = np.concatenate([block_maxima(data, windows, tables), np.zeros((1, FILTERS), np.float32)])
    counts = chunk_count(blocks)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(texts)), counts)
    first = starts[of] + (np.arange(ends[-1]) - np.repeat(ends - counts, counts)) * (STEP // BLOCK)
    last = np.minimum(first + CHUNK // BLOCK, starts[of] + blocks[of])
    chunks = np.tanh(np.maximum.reduceat(top, np.stack([first, last], 1).ravel())[::2].astype(np.float64) + shift)
    at = ends - counts
    return np.concatenate([np.add.reduceat(chunks, at) / counts[:, None], np.maximum.reduceat(chunks, at), np.minimum.reduceat(chunks, at)], 1)


def probability(x: np.ndarray, net: Network) -> np.ndarray:
    logit = np.maximum(x @ net.hidden + net.hidden_shift, 0) @ net.out + net.out_shift[0]
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


# ---- learning


def pieces_of(text: bytes, most: int) -> tuple[list[bytes], list[int]]:
    """At most ``most`` chunks of a text, evenly spread, and how many windows each has."""
    n = max(1, len(text))
    count = int(chunk_count(np.array([-(-n // BLOCK)]))[0])
    chosen = range(count) if count <= most else sorted({round(k * (count - 1) / max(1, most - 1)) for k in range(most)})
    return [text[STEP * k : STEP * k + CHUNK + WIDTH - 1] for k in chosen], [min(CHUNK, n - STEP * k) for k in chosen]


class Sample:
    """Chunks of documents as rows of bytes, and each document's first chunk."""

    def __init__(self, pieces: list[list[bytes]], windows: list[list[int]], labels: np.ndarray):
        flat = [p for own in pieces for p in own]
        self.bytes = np.zeros((len(flat), CHUNK + WIDTH - 1), np.uint8)
        for k, p in enumerate(flat):
            self.bytes[k, : len(p)] = np.frombuffer(p, np.uint8)
        self.windows = np.array([w for own in windows for w in own])
        self.counts = np.array([len(own) for own in pieces])
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.labels = labels

    def rows(self, docs: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[d], self.starts[d + 1]) for d in docs])


def _gradients(net: Network, sample: Sample, docs: np.ndarray, learn: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Probabilities of documents, and the gradients of the mean loss."""
    rows = sample.rows(docs)
    x, tables = sample.bytes[rows], net.tables()
    answers = tables[0][x[:, :CHUNK]]
    for j in range(1, WIDTH):
        answers += tables[j][x[:, j : j + CHUNK]]
    answers[np.arange(CHUNK) >= sample.windows[rows][:, None]] = -np.inf
    place = answers.argmax(1)
    a = np.tanh(np.take_along_axis(answers, place[:, None], 1)[:, 0].astype(np.float64) + net.shift)
    counts = sample.counts[docs]
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    of = np.repeat(np.arange(len(docs)), counts)
    high, low = np.maximum.reduceat(a, at), np.minimum.reduceat(a, at)
    pool = np.concatenate([np.add.reduceat(a, at) / counts[:, None], high, low], 1)
    before = pool @ net.hidden + net.hidden_shift
    unit = np.maximum(before, 0)
    p = 1 / (1 + np.exp(-np.clip(unit @ net.out + net.out_shift[0], -50, 50)))
    if not learn:
        return p, []
    d = (p - sample.labels[docs]) / len(docs)
    d_unit = np.outer(d, net.out) * (before > 0)
    d_pool = d_unit @ net.hidden.T
    is_high, is_low = a == high[of], a == low[of]
    share = lambda x: x / np.add.reduceat(x.astype(np.float64), at)[of]
    d_a = (d_pool[:, :FILTERS] / counts[:, None])[of] + d_pool[of, FILTERS : 2 * FILTERS] * share(is_high) + d_pool[of, 2 * FILTERS :] * share(is_low)
    d_z = d_a * (1 - a * a)
    # only the window that was the largest learns
    d_tables = np.empty((WIDTH, 256, FILTERS))
    column = np.arange(FILTERS)
    for j in range(WIDTH):
        seen = np.take_along_axis(x, place + j, 1).astype(np.int64)
        d_tables[j] = np.bincount((seen * FILTERS + column).ravel(), d_z.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    grads = [np.einsum("wbf,wef->be", d_tables, net.filters), np.einsum("be,wbf->wef", net.chars, d_tables), d_z.sum(0), pool.T @ d_unit, d_unit.sum(0), unit.T @ d, np.array([d.sum()])]
    return p, grads


def learn(sample: Sample, seed: int = 5, epochs: int = EPOCHS) -> Network:
    """Adam over batches of documents; of the states after each pass the one that is best on every tenth document, from
    which nothing is learned."""
    net, rng = fresh(seed), np.random.default_rng(seed)
    every = np.arange(len(sample.labels))
    aside = every[every % 10 == 0] if len(every) >= 100 else every
    own = every[every % 10 != 0] if len(every) >= 100 else every
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    best, kept = np.inf, [p.copy() for p in net.parts()]
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(own)
        for s in range(0, len(order), BATCH):
            _, grads = _gradients(net, sample, order[s : s + BATCH])
            step += 1
            for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        loss = 0.0
        for s in range(0, len(aside), BATCH):
            docs = aside[s : s + BATCH]
            p = np.clip(_gradients(net, sample, docs, learn=False)[0], 1e-6, 1 - 1e-6)
            y = sample.labels[docs]
            loss -= float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        if loss < best:
            best, kept = loss, [p.copy() for p in net.parts()]
    return Network(*kept)


# ---- DataFrames


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def usable_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``id, label`` of the ids that may be learned from."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    return own.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other").select("id", F.col("label").cast("int").alias("label"))


def drawn(docs: DataFrame, labels: DataFrame, rows: int = ROWS, pieces: int = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, label, pieces, windows`` of the sample."""
    order = F.xxhash64("id")
    chosen = labels.where("label = 0").orderBy(order, "id").limit(rows // 2).unionByName(labels.where("label = 1").orderBy(order, "id").limit(rows // 2))
    kind = "id long, label int, mark long, pieces array<binary>, windows array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column(2))
            cut = [pieces_of(t, pieces) for t in texts]
            marks = pa.array([zlib.crc32(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks, pa.array([x for x, _ in cut], pa.list_(pa.binary())), pa.array([w for _, w in cut], pa.list_(pa.int32()))], ["id", "label", "mark", "pieces", "windows"])

    # at most ``rows`` rows of an id and a label
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")
    return found.mapInArrow(run, kind).groupBy("id", "label").agg(F.min_by(F.struct("pieces", "windows"), "mark").alias("x")).select("id", "label", "x.pieces", "x.windows")


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, pieces: int = PIECES, epochs: int = EPOCHS) -> Network | float:
    """A network, or a constant score where the labels are of one kind."""
    usable = usable_labels(labels)
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    got = drawn(docs, usable, rows, pieces).orderBy(F.xxhash64("id"), "id").toArrow()
    y = got["label"].to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return share
    net = learn(Sample(got["pieces"].to_pylist(), got["windows"].to_pylist(), y), epochs=epochs)
    # from the sample's shares to those of all labels
    drawn_share = y.mean()
    net.out_shift = net.out_shift + np.log(share / (1 - share)) - np.log(drawn_share / (1 - drawn_share))
    return net


def score(docs: DataFrame, net: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row, from its whole text."""
    tables = None if isinstance(net, float) else net.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = utf8(batch.column(1))
            got = np.full(len(texts), net) if tables is None else probability(pooled(texts, tables, net.shift), net)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
