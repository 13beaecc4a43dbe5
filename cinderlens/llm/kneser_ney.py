"""Interpolated modified Kneser-Ney model over byte n-grams, held in sorted arrays of n-gram codes.

The highest order uses counts, lower orders the number of distinct symbols that precede an n-gram. Each order has three
discounts from its counts of counts. The lowest order is interpolated with the uniform distribution, so every n-gram
has a positive probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cinderlens.llm.text import lookup


def discounts(counts: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the counts of counts; 0.5, 1 and 1.5 where these are missing."""
    return discounts_of([float((counts == r).sum()) for r in range(1, 5)])


def discounts_of(n: list[float]) -> np.ndarray:
    """As ``discounts``, from how many n-grams have the counts 1 to 4."""
    fixed = np.array([0.5, 1.0, 1.5])
    if min(n) == 0:
        return fixed
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return d if ((d > 0) & (d < [1, 2, 3])).all() else fixed


@dataclass
class Level:
    """One order: sorted codes with probabilities, sorted contexts with the weight of the order below."""

    codes: np.ndarray
    probability: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


class KneserNey:
    """``levels[k]`` is order k + 1."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, size: int, order: int):
        self.size = size
        tables = [(codes, counts)]
        for k in range(order - 1, 0, -1):
            suffixes, distinct = np.unique(tables[0][0] % size**k, return_counts=True)
            tables.insert(0, (suffixes, distinct))
        self.levels: list[Level] = []
        for own, n in tables:
            d = discounts(n)
            off = d[np.minimum(n, 3) - 1] if len(n) else np.zeros(0)
            contexts, at = np.unique(own // size, return_inverse=True)
            total = np.bincount(at, weights=n, minlength=len(contexts))
            weight = np.bincount(at, weights=off, minlength=len(contexts)) / np.maximum(total, 1)
            lower = self.probability(own % (size ** len(self.levels)) if self.levels else own) if self.levels else np.full(len(own), 1 / size)
            self.levels.append(Level(own, (n - off) / total[at] + weight[at] * lower if len(own) else np.zeros(0), contexts, weight))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams of the highest order built so far."""
        return self._at(len(self.levels), codes)

    def _at(self, order: int, codes: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full(len(codes), 1 / self.size)
        level = self.levels[order - 1]
        at, seen = lookup(level.codes, codes)
        out = np.empty(len(codes))
        out[seen] = level.probability[at[seen]]
        rest = codes[~seen]
        if len(rest):
            c, known = lookup(level.contexts, rest // self.size)
            weight = np.ones(len(rest))
            weight[known] = level.weight[c[known]]
            out[~seen] = weight * self._at(order - 1, rest % self.size ** (order - 1))
        return out

    def log10(self, codes: np.ndarray) -> np.ndarray:
        return np.log10(self.probability(codes))
