"""Large groups of near copies give links in proportion to their members."""

import numpy as np

from cinderlens.llm import count_tree_join


def _classes(n, pairs):
    of = list(range(n))
    for a, b in pairs:
        of = [of[a] if x == of[b] else x for x in of]
    return of


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(5)
    for n, m in ((2, 1), (30, 12), (30, 40), (30, 400), (5, 0)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        taken = count_tree_join.forest(a * 7, b * 7, rng.integers(0, 5, m))
        every, some = _classes(n, zip(a, b, strict=True)), _classes(n, zip(a[taken], b[taken], strict=True))
        assert len(set(zip(every, some, strict=True))) == len(set(every)) == len(set(some))
        assert taken.sum() == n - len(set(every))


def test_a_cell_of_single_texts_asks_for_fewer_pairs_than_it_has_members(spark):
    n = 60
    rows = [(i, " ".join(f"x{i}" if k == i else f"w{k}" for k in range(150))) for i in range(n)]
    sets = count_tree_join.sets_of(spark.createDataFrame(rows, "row long, text string"), 3)
    members = count_tree_join.points_of(sets).selectExpr("2L AS key", "mark AS id", "mark AS label", "point")
    ids = sorted(r["id"] for r in members.collect())
    for turn in range(count_tree_join.FORESTS):
        pairs = [(ids.index(r["a"]), ids.index(r["b"])) for r in count_tree_join.forest_pairs(members, 90, 100, turn).collect()]
        assert len(pairs) == n - 1 and len(set(_classes(n, pairs))) == 1
    assert count_tree_join.remaining_pairs(members, 90, 100, True).count() == n * (n - 1) // 2
