"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The rank file is turned into a sentencepiece BPE model without training: each token's bytes become a piece of mapped
characters, its score is its negative rank, and normalisation is the identity. Sentencepiece then merges the pair with
the best score, leftmost first, which is the merge order of the rank file. Texts are cut into pre-tokens by the public
pattern first, each pre-token is encoded alone, and a pre-token that is itself a token is not merged. Decoding maps ids
back to their bytes.

Defined results: null or empty text has no ids; ids never depend on other rows, so ties, repeats and row order do not
matter; very long texts are handled in one piece per text; an empty table gives an empty result. Only the two named
columns are read, so extra columns never clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlens.llm.text import ids_of, slices

#: Byte b is written as the character 0x100 + b: injective, and free of white space.
CHAR_OF_BYTE = {b: chr(0x100 + b) for b in range(256)}
#: Units kept for reuse by one task.
CACHE_UNITS = 300_000
#: A space next to other white space; str.isspace() is true of all that any regex engine takes for white space.
_LOOSE_SPACE = [pair for c in map(chr, range(0x3001)) if c.isspace() for pair in (" " + c, c + " ")]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece i is the token with the i-th smallest rank, the unknown piece comes last."""
    pieces = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(CHAR_OF_BYTE[b] for b in token).encode()
        pieces += _field(1, _field(1, name) + _field(2, float(-rank)) + _field(3, 1))
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file lacks single bytes: {missing[:5]}")
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of_piece = [r for _, r in by_rank]
        self.plain = self.rank_of_piece == list(range(len(by_rank)))
        self.bytes_of_id = {r: t for t, r in by_rank}
        self.table = str.maketrans({b: CHAR_OF_BYTE[b] for b in range(256)})
        self.units: dict[str, bytes] = {}
        self.decimal_of_id = {r: b"%d" % r for r in self.rank_of_piece}

    def _pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token: its own rank if it is a token, else the model's merges."""
        out = [self.ranks.get(p.encode()) for p in pretokens]
        unknown = [i for i, rank in enumerate(out) if rank is None]
        mapped = [pretokens[i].encode().decode("latin-1").translate(self.table) for i in unknown]
        ids = [x if x is None else [x] for x in out]
        for i, pieces in zip(unknown, self.model.encode(mapped, num_threads=1), strict=True):
            ids[i] = pieces if self.plain else [self.rank_of_piece[x] for x in pieces]
        return ids

    def _learn(self, units: list[str]) -> None:
        """Put new units into the cache."""
        cut = list(map(self.pattern.findall, units))
        ids = self._pretokens([p for c in cut for p in c])
        at = 0
        for unit, c in zip(units, cut, strict=True):
            n = len(c)
            self.units[unit] = array("I", ids[at] if n == 1 else [i for x in ids[at : at + n] for i in x]).tobytes()
            at += n

    def _units(self, text: str) -> list[str]:
        """Pieces of the text whose pre-tokens are those of the whole text: cut before each space that stands between
        two characters other than white space; otherwise the pattern's own matches."""
        if text[:1] == " " or text[-1:] == " " or any(pair in text for pair in _LOOSE_SPACE):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *(f" {x}" for x in rest)] if first else []

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        units = self._units(text)
        try:
            ids = b"".join(map(self.units.__getitem__, units))
        except KeyError:
            if len(self.units) > CACHE_UNITS:
                self.units.clear()
            self._learn([u for u in dict.fromkeys(units) if u not in self.units])
            ids = b"".join(map(self.units.__getitem__, units))
        return np.frombuffer(ids, np.uint32)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimals joined by commas."""
        return b",".join(map(self.decimal_of_id.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of these ids."""
        return b"".join(map(self.bytes_of_id.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=1)
def coder_of(ranks_path: str, pattern: str) -> ByteBpe:
    """One coder for all tasks of a Python worker."""
    return ByteBpe(read_ranks(ranks_path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(id, ids array<int>, ids_sha256, decoded binary)`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            coder = coder_of(ranks_path, pattern)
            ids, shas, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                own = coder.encode(text or "")
                ids.append(own.astype(np.int32))
                shas.append(hashlib.sha256(coder.decimals(own)).hexdigest())
                decoded.append(coder.decode(own))
            yield pa.RecordBatch.from_arrays([ids_of(batch.column(0)), pa.array(ids, pa.list_(pa.int32())), pa.array(shas, pa.string()), pa.array(decoded, pa.binary())], ["id", "ids", "ids_sha256", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>, ids_sha256 string, decoded binary")


def token_digest(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids and bytes are hashed where they are made."""
    return encode_documents(docs, ranks_path).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
