"""The search over all pairs of a mixed cell follows even when the nearest ones give nothing new."""

from cinderlens.llm import count_tree_join


def test_all_pairs_are_searched_when_the_nearest_give_nothing(spark, monkeypatch):
    passes, search = [], count_tree_join.remaining_pairs

    def remaining(searched, p, q, nearest):
        passes.append(nearest)
        found = search(searched, p, q, nearest)
        return found.where("false") if nearest else found

    monkeypatch.setattr(count_tree_join, "remaining_pairs", remaining)
    rows = [(i, " ".join(f"w{i}x{k}" if k < 3 * i else f"w{k}" for k in range(40))) for i in range(6)]
    assert count_tree_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    assert passes == [True, False]
