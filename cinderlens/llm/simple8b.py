"""Token-id output as Simple-8b words, and its vectorised reader.

A word is 64 bits: a 4-bit selector and 60 bits that hold ``COUNTS[selector]`` values of ``WIDTHS[selector]`` bits. A
run of values is cut greedily: each word takes as many of the next values as fit. The last word of a block is padded
with zeros; the block knows how many values it holds. Values of 2**60 and more cannot be packed: 0 stands in their
place, and (position, value) is kept in the block's escapes.

The file format is one Parquet row per block, so that any file system Spark writes can hold it: ``part`` and ``block``
(ascending with the ids of documents), ``doc_ids``, ``lengths`` (ids per document), ``n_ids``, ``words`` (the packed
words, little-endian), ``escapes``. Blocks hold whole documents, and ``rel_start`` is the offset of a block's first id
within its part, so that a reader can go to any document without reading what comes before.

Defined results: null text is the empty text, which has only the end id; equal document ids are ordered by a hash of the
text, so that rows of one id may be dealt to several parts; null ids come first; very long texts make a long block of
their own; an empty table writes no block. Texts that hold the vocabulary's special tokens get their ids, as the
tokenizers library gives them by default.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.llm.scratch import new_path
from cinderlens.llm.text import LOWER, slices, utf8

#: Values per word and bits per value, by selector; fixed by the format.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.uint64)
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18
#: Texts that are cut into words at once.
CHUNK_TEXTS = 256
#: Words kept for reuse by one task.
CACHE_WORDS = 800_000
BLOCK_SCHEMA = "part long, block long, rel_start long, n_ids long, doc_ids binary, lengths binary, words binary, escapes binary"


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    out = np.ones(len(values), dtype=np.uint8)
    for width in range(1, 60):
        more = values >= np.uint64(1 << width)
        if not more.any():
            break
        out += more
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of these unsigned values, and the escapes as rows of position and value."""
    values = np.asarray(values, dtype=np.uint64)
    large = np.flatnonzero(values >= np.uint64(1 << 60))
    escapes = np.column_stack([large.astype(np.uint64), values[large]]) if len(large) else np.zeros((0, 2), np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), escapes
    padded = np.concatenate([np.where(values >= np.uint64(1 << 60), np.uint64(0), values), np.zeros(60, np.uint64)])
    bits = _bit_lengths(padded)
    # widest[c] at i: the most bits of the c values from i on; built for rising counts from shorter windows
    best = np.full(n, 13, dtype=np.uint8)
    window, width = bits, 1
    for selector in range(len(COUNTS) - 2, -1, -1):
        count = int(COUNTS[selector])
        while width < count:
            step = min(width, count - width)
            window = np.maximum(window[: len(window) - step], window[step:])
            width += step
        best[window[:n] <= WIDTHS[selector]] = selector
        if window[:n].min() > WIDTHS[selector - 1]:
            break
    jump = COUNTS[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += jump[at]
    start = np.array(starts, dtype=np.int64)
    chosen = best[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        own = np.flatnonzero(chosen == selector)
        for k in range(int(COUNTS[selector])):
            words[own] |= padded[start[own] + k] << (WIDTHS[selector] * np.uint64(k))
    return words, escapes


def unpack(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The first ``n`` values of these words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for selector in np.unique(selectors):
        own = np.flatnonzero(selectors == selector)
        mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
        for k in range(int(COUNTS[selector])):
            out[starts[own] + k] = (words[own] >> (WIDTHS[selector] * np.uint64(k))) & mask
    out = out[:n]
    if len(escapes):
        out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out


#: How added tokens begin; a text with it is not lower-cased beforehand.
_ADDED = b"<|"
#: Pieces of small letters that no normaliser changes, with marks behind them or not, and all these letters and marks.
_LETTERS, _MARKS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_PLAIN = re.compile(f"([{_LETTERS}]*)([{re.escape(_MARKS)}]*)")


class WordEncoder(dict):
    """Whole texts to ids with a tokenizers file. For vocabularies whose normaliser and pre-tokenizer treat white space
    only as a border, and whose added tokens hold none, the ids of a text are those of its white-space-separated pieces,
    which are kept for reuse: this is the table of the pieces and their ids.

    Most new pieces are plain letters and marks. Where the vocabulary leaves these as they are and makes one pre-token of
    the letters and one of the marks, in the byte-level alphabet, its model is asked for them without the steps before."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], np.uint32).tobytes()
        self.model, self.level = self.tokenizer.model, _byte_level()
        self.plain = self._is_plain()

    def _is_plain(self) -> bool:
        """Whether letters and marks go to the model as described."""
        t, piece = self.tokenizer, _LETTERS + _MARKS
        if t.normalizer is None or t.pre_tokenizer is None:
            return False
        pre = [x for x, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(piece))]
        return t.normalizer.normalize_str(piece) == piece and pre == [self._leveled(_LETTERS), _MARKS]

    def _leveled(self, letters: str) -> str:
        return letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.level)

    def __missing__(self, piece: bytes) -> bytes:
        own = piece.decode()
        found = _PLAIN.fullmatch(own) if self.plain and _ADDED not in piece else None
        if found is None:
            ids = self.tokenizer.encode(own, add_special_tokens=False).ids
        elif found[1] and found[2]:
            self[piece] = out = self[found[1].encode()] + self[found[2].encode()]
            return out
        else:
            ids = [x.id for x in self.model.tokenize(self._leveled(own))]
        self[piece] = out = array("I", ids).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id. A-Z are lower-cased first, as the vocabulary's
        normaliser does, so that fewer pieces are new."""
        if len(self) > CACHE_WORDS:
            self.clear()
        return [b"".join(map(self.__getitem__, (t if _ADDED in t else t.translate(LOWER)).split())) + self.end for t in texts]


def _byte_level() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies, by byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, end_id)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts in ascending order of ``id_col`` to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, total = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        doc_ids: list = []
        held = 0

        def close() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), np.uint32)
            words, escapes = pack(values)
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            known = np.array([[x is not None, x or 0] for x in doc_ids], np.int64).reshape(-1, 2)
            row = [part, block, total, len(values), known.tobytes(), lengths.tobytes(), words.tobytes(), escapes.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in slices(batches, CHUNK_TEXTS):
            coder = encoder_of(tokenizer_path, end_id)
            for doc, own in zip(batch.column(0).to_pylist(), coder.encode(utf8(batch.column(1))), strict=True):
                ids.append(own)
                doc_ids.append(doc)
                held += len(own) // 4
                if held >= block_ids:
                    yield close()
                    block, total, held, ids, doc_ids = block + 1, total + held, 0, [], []
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = max(1, rows.rdd.getNumPartitions())
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    rows.repartitionByRange(parts, "id", tie).sortWithinPartitions("id", tie).mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document in the files at ``path``, decoded from the packed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = unpack(np.frombuffer(row["words"], np.uint64), row["n_ids"], np.frombuffer(row["escapes"], np.uint64).reshape(-1, 2)).astype("<u4")
                known = np.frombuffer(row["doc_ids"], np.int64).reshape(-1, 2)
                lengths = np.frombuffer(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(values[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = pa.array(known[:, 1], pa.int64(), mask=known[:, 0] == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lengths), row["part"])), ids, pa.array(starts + row["rel_start"]), pa.array(lengths), pa.array(crc, pa.int64())], ["part", "id", "rel_start", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row per written part: as many as there were tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return blocks.mapInArrow(run, "part long, id long, rel_start long, n_tokens long, ids_crc32 long").join(offsets, "part").select("id", (F.col("offset") + F.col("rel_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write all texts and read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer_path, end_id)
    return read_ids(docs.sparkSession, path).withColumnRenamed("id", "doc_id")
