"""Searches over the stored indexes against plain loops and against the exact search."""

import collections
import math
import random
import re

import numpy as np
import pytest

from cinderlens.operators import search


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def bm25(docs, query, k, least=0.0):
    held = {i: collections.Counter(words(t)) for i, t in docs}
    df = collections.Counter(w for c in held.values() for w in c)
    mean = sum(sum(c.values()) for c in held.values()) / len(held)
    scores = {}
    for i, c in held.items():
        n = sum(c.values())
        parts = [math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (search.K1 + 1) / (c[w] + search.K1 * (1 - search.B + search.B * n / mean)) for w in set(words(query)) if w in c]
        if parts:
            scores[i] = round(sum(parts), 6)
    best = sorted(((-s, i) for i, s in scores.items() if s >= least))[: search.clamp_hits(k)]
    return [(i, r, pytest.approx(-s, abs=2e-6)) for r, (s, i) in enumerate(best, 1)]


@pytest.mark.parametrize(("k", "least"), [(3, 0.0), (50, 0.0), (0, 0.0), (5, 2.5)])
def test_words_against_loops(spark, tmp_path, k, least):
    rng = random.Random(9)
    # a word in every document, and words that few hold
    pool = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
    docs = [(i, "common " + " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, "Common, common; COMMON!")]
    asked = [(1, "common w1 w2 w3"), (2, "w7 W9, w399 nothing"), (3, ""), (4, "nothing at all"), (5, " ".join(pool[:60]))]
    # blocks of about 20 documents, so that most blocks are left out
    index = search.word_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / f"i{k}{least}"), per_block=20)
    got = collections.defaultdict(list)
    for r in search.keyword_hits(index, spark.createDataFrame(asked, "query long, text string"), k, least).collect():
        got[r["query"]].append((r["doc_id"], r["rank"], r["score"]))
    for q, text in asked:
        assert sorted(got[q], key=lambda x: x[1]) == bm25(docs, text, k, least)


def test_blocks_are_left_out_only_below_the_bar(spark, tmp_path):
    docs = [(i, "common rare" if i == 77 else "common " * (1 + i % 5)) for i in range(400)]
    index = search.word_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"), per_block=10)
    assert index.cells.where("word = 'common'").count() > 30
    got = search.keyword_hits(index, spark.createDataFrame([(1, "rare common")], "query long, text string"), 1).collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(77, 1)]


def recall(spark, rows, queries, k=10, **more):
    index = search.vector_index(rows, more.pop("folder"))
    assert index.lists.selectExpr("sum(size(ids))").first()[0] == rows.count()
    found = {(r["query"], r["vec_id"]) for r in search.vector_hits(index, queries, k, **more).collect()}
    exact = search._nearest(search._packed(queries, 256, "qs", "qv").crossJoin(search._packed(rows, 4096, "ids", "values")), k)
    wanted = {(r["query"], r["vec_id"]) for r in exact.collect()}
    return len(found & wanted) / len(wanted), index


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, tmp_path, sf):
    rows = search._vectors(spark, f"/root/testdata/{sf}")
    assert recall(spark, rows, rows.where("vec_id % 100 = 0"), folder=str(tmp_path / "v"))[0] >= 0.9


def test_recall_and_probes_where_vectors_gather(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    data = [(i, [float(x) for x in centres[i % 40] + rng.normal(scale=0.15, size=16)]) for i in range(3000)]
    data += [(5000 + i, data[0][1]) for i in range(600)]
    rows = spark.createDataFrame(data, "vec_id long, v array<double>")
    share, index = recall(spark, rows, rows.where("vec_id % 100 = 0"), folder=str(tmp_path / "v"))
    assert share >= 0.9 and index.probes < len(index.centroids) / 4


def test_no_vectors(spark, tmp_path):
    rows = spark.createDataFrame([], "vec_id long, v array<double>")
    assert search.vector_hits(search.vector_index(rows, str(tmp_path / "v")), rows).count() == 0
