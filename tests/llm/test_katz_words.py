"""The word model of op6 against Katz backoff by brute force."""

import collections
import math
import zlib

import numpy as np
import pytest

from cinderlens.llm.katz import K, good_turing, score

SCHEMA = "doc_id long, text string"
END_TOKEN = b"\n"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def corpus():
    rng = np.random.default_rng(4)
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 40) % 300)) for i in range(120)] + [(500, "new words only"), (501, ""), (502, "漢字 école")]


def brute(rows):
    """Probability of a word after a context, and the words of training texts."""
    cut = lambda t: [*t.encode().lower().split(), END_TOKEN]
    singles, pairs = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            own = cut(t)
            singles.update(own)
            pairs.update(zip([None, *own], own, strict=False))
    d1, d2 = (good_turing(np.array(list(c.values()))) for c in (singles, pairs))
    n = sum(singles.values())
    kept = lambda c, d: c * d[c] if c <= K else c
    p1 = {w: kept(c, d1) / n for w, c in singles.items()}
    p1[None] = 1 - sum(p1.values())
    after = collections.defaultdict(dict)
    for (v, w), c in pairs.items():
        after[v][w] = c

    def p(v, w):
        w = w if w in singles else None
        own = after.get(v)
        if not own:
            return p1[w]
        mass, total = sum(kept(c, d2) for c in own.values()), sum(own.values())
        total += mass >= total
        if w in own:
            return kept(own[w], d2) / total
        return (1 - mass / total) / (1 - sum(p1[x] for x in own)) * p1[w]

    return p, singles, cut


@pytest.mark.parametrize("block_bytes", [2_000, 1 << 20])
def test_scores_are_those_of_word_pairs(spark, block_bytes):
    rows = corpus()
    p, singles, cut = brute(rows)
    for v in (None, b"w1", b"w2", b"unheard"):
        assert math.isclose(sum(p(v, w) for w in [*singles, None]), 1)
    got = {r["doc_id"]: r for r in score(spark.createDataFrame(rows, SCHEMA).repartition(3), block_bytes=block_bytes).collect()}
    for i, t in rows:
        own = cut(t)
        expected = sum(math.log10(p(v, w)) for v, w in zip([None, *own], own, strict=False))
        assert math.isclose(got[i]["score"], expected, rel_tol=1e-9), i
    tested = [r for r in got.values() if r["held_out"] and r["doc_id"] < 120]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)
