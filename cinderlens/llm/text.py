"""Byte-level text helpers shared by the operators; inputs are UTF-8 bytes of whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A-Z to a-z, everything else unchanged.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that only few texts are held as Python values at once. What is kept for reuse is
    given back at the end of a task."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def give_back() -> None:
    """Give memory that is free back to the system: a worker lives on after its task and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D (bytes.split() splits at exactly these)."""
    return text.split()


def ids_of(column: pa.Array) -> pa.Array:
    """The id column as 64-bit integers."""
    return column.cast(pa.int64())


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + _MIX[2]
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a text without a step per word: sums of byte values times powers of a base over the
    whole text, whose differences at the borders of words are divided by the power at the word's start. With ``lower``
    A-Z count as a-z. ``keep`` are the bytes of words; all but 0x20 and 0x09-0x0D unless given."""

    def __init__(self, lower: bool = True, keep: bytes | None = None):
        value = mix(np.arange(256, dtype=np.uint64)) | np.uint64(1)
        if lower:
            value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
        inside = np.ones(256, bool)
        inside[list(b" \t\n\x0b\x0c\r")] = False
        if keep is not None:
            inside[:] = False
            inside[list(keep)] = True
        self.value, self.inside = np.where(inside, value, np.uint64(0)), inside
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 14)
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words in order, and where they start and end in bytes."""
        data = np.frombuffer(text, np.uint8)
        self._grow(len(data))
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = self.inside[data]
        borders = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = borders[::2], borders[1::2]
        upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], out=upto[1:])
        return mix((upto[end] - upto[start]) * self.inverses[start]), start, end


#: Odd factors of the words of an n-gram.
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words from the hashes of the words."""
    size = len(h) - n + 1
    out = np.full(max(size, 0), n, np.uint64)
    for k in range(n):
        out += h[k : k + size] * _FACTORS[k % 64]
    return mix(out)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted numbers in the sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)
