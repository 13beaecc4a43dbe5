"""Pairs and cells that points rule out cost no sets and no second search."""

from cinderlens.llm import count_tree_join as J


def test_what_points_rule_out_is_neither_verified_nor_searched_again(spark, monkeypatch):
    pairs, members, verify, forest_pairs = [], [], J.verify, J.forest_pairs

    def verified(some, sets, p, q):
        held = {r["mark"]: J.point_of(J.unpacked(bytes(r["shingles"]))) for r in sets.collect()}
        pairs.extend(J._possible(held[r["a"]], held[r["b"]], p, q) for r in some.collect())
        return verify(some, sets, p, q)

    def searched(placed, p, q, turn):
        members.append(placed.count())
        return forest_pairs(placed, p, q, turn)

    monkeypatch.setattr(J, "verify", verified)
    monkeypatch.setattr(J, "forest_pairs", searched)
    # two copies but for a word, and texts that share less and less with them
    rows = [(i, " ".join(f"w{i}x{k}" if k < 12 * i else f"w{k}" for k in range(160))) for i in range(6)] + [(6, " ".join(f"w{k}" for k in range(159)))]
    got = {r["doc_id"]: r["component_id"] for r in J.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}
    assert pairs and all(pairs)
    assert members[0] > 0 and members[1] == 0
