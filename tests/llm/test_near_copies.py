"""Classes and the row that is kept, on chained clusters, repeated ids, null ids and repeated rows."""

import random

import pytest
from test_contract import classes_of

from cinderlens.llm import count_tree_join

SCHEMA = "doc_id long, text string, lang string, key string"


def chained(seed):
    """Texts that drift away from a start by single words, so that only neighbours in a chain are similar."""
    rng = random.Random(seed)
    rows = []
    for chain in range(6):
        own = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 11, 33, 90, 400]))]
        for _ in range(25):
            rows.append(" ".join(own))
            for _ in range(max(1, len(own) // 40)):
                own[rng.randrange(len(own))] = f"c{chain}x{rng.randrange(10**6)}"
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(1))
def test_chains(spark, seed):
    rows = chained(seed)
    for n, p in ((3, 90), (5, 80)):
        expected = classes_of(rows, n, p, 100)
        got = count_tree_join.link_classes(spark.createDataFrame([(i, t, "en", "k") for i, t in rows], SCHEMA).repartition(3), n, p, 100).collect()
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected


def test_an_id_with_several_texts_links_their_partners(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(5, a, "en", "k"), (5, b, "en", "k"), (7, a.replace("a30", "z"), "en", "k"), (3, b.replace("b59", "z"), "en", "k"), (9, "alone", "en", "k")]
    got = {(r["id"], r["component_id"]) for r in count_tree_join.near_copies(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("doc_id", "id").collect()}
    assert got == {(5, 3), (7, 3), (3, 3), (9, 9)}


def test_one_row_of_each_class_is_kept(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(4, a, "en", "1"), (4, a, "en", "1"), (4, b, "en", "2"), (None, a, "fr", "3"), (None, b + " more", None, "4"), (2, a + " end", "en", "5"), (None, "own", None, None), (None, "own", None, None), (8, None, "en", None), (9, "", "en", None)]
    kept = count_tree_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["key"] or "") for r in kept) == [(0, ""), (2, "5"), (4, "2"), (8, ""), (9, "")]
