"""Hashes of words against the words themselves."""

import random

import numpy as np

from cinderlens.llm.text import LOWER, WordHasher, gram_hashes


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abé漢Z.,") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    hasher, seen = WordHasher(), {}
    for n in (0, 1, 5, 4000):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\t \r", "\x0b\x0c"]) for _ in range(n)).encode()
        h, start, end = hasher.of(text)
        own = text.translate(LOWER).split()
        assert [text.translate(LOWER)[a:b] for a, b in zip(start, end, strict=True)] == own
        for word, key in zip(own, h.tolist(), strict=True):
            assert seen.setdefault(word, key) == key
    assert len(set(seen.values())) == len(seen)


def test_grams_tell_order_apart():
    h = WordHasher().of(b"a b c a b c b a")[0]
    grams = [tuple(h[k : k + 3].tolist()) for k in range(6)]
    got = gram_hashes(h, 3).tolist()
    assert len({g: k for g, k in zip(grams, got, strict=True)}) == len(set(got)) == len(set(grams))
    assert not len(gram_hashes(np.zeros(2, np.uint64), 3))
