"""Parts of the operators that need no Spark."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderlens.llm.count_tree_join import Bands, CountTree, _similar, point_of, tree_join
from cinderlens.llm.kneser_ney import KneserNey
from cinderlens.llm.licenses import TemplateIndex, template_sets
from cinderlens.llm.simple8b import pack, unpack


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=200))
def test_packed_words_come_back(values):
    words, escapes = pack(np.array(values, np.uint64))
    assert unpack(words, len(values), escapes).tolist() == values


def grams(size, order, n, seed):
    rng = np.random.default_rng(seed)
    symbols = rng.integers(1, size, n)
    codes = sum(np.roll(symbols, k) * size**k for k in range(order))
    return np.unique(codes, return_counts=True)


@pytest.mark.parametrize("n", [40, 3000])
def test_kneser_ney_sums_to_one(n):
    size, order = 8, 3
    codes, counts = grams(size, order, n, 2)
    model = KneserNey(codes, counts, size, order)
    for context in range(size ** (order - 1)):
        assert abs(model.probability(context * size + np.arange(size)).sum() - 1) < 1e-9


def test_a_model_without_texts():
    none = np.zeros(0, np.int64)
    assert np.isfinite(KneserNey(none, none, 8, 3).log10(np.arange(8))).all()


def near_sets(seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(16):
        base = rng.integers(0, 2**63, int(rng.integers(1, 120)), dtype=np.uint64)
        for share in (1.0, 0.97, 0.9, 0.8):
            own = base[rng.random(len(base)) < share]
            out.append(np.unique(np.concatenate([own, rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)])))
    return [x for x in out if len(x)]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("p", [80, 90])
def test_similar_sets_share_a_cell_and_the_tree_finds_them(p, seed):
    sets, bands = near_sets(seed), Bands(p, 100)
    cells = [set(bands.cells(x).tolist()) for x in sets]
    points = np.stack([point_of(x) for x in sets])
    half = len(sets) // 3
    pairs = set()
    for a, b in ((0, 0), (0, half), (half, half)):
        end = lambda k: half if not k else len(sets)
        found = tree_join(CountTree(points[a : end(a)]), CountTree(points[b : end(b)]), p, 100, lambda i, j: np.ones(len(i), bool))
        pairs |= {(int(i) + a, int(j) + b) for i, j in zip(*found)}
    pairs |= {(j, i) for i, j in pairs}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            common = len(np.intersect1d(x, y))
            linked = common * 100 >= (len(x) + len(y) - common) * p
            assert _similar(x, y, p, 100) == linked
            if linked:
                assert cells[i] & cells[j] and (i, j) in pairs


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_template_search_is_exact(data):
    letters = "abcdefghij"
    templates = {k: [" ".join(data.draw(st.lists(st.sampled_from(letters), min_size=1, max_size=8)))] for k in ("x", "y", "z")}
    sets = template_sets(templates)
    order = data.draw(st.permutations(sorted(frozenset().union(*(s for _, s in sets)))))
    index = TemplateIndex(templates, list(order), 0.8)
    words = set(data.draw(st.lists(st.sampled_from([w.encode() for w in letters]), max_size=10)))
    block = sorted(index.rank[w] for w in words if w in index.rank)
    found = {k for k, _ in index.matches(block)}
    assert found == {k for k, (_, own) in enumerate(sets) if len(own & words) >= 0.8 * len(own) - 1e-9}
