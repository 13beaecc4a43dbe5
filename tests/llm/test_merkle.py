"""Manifest and proofs against plain Python, over groups of more than one page and more groups than one page holds."""

import collections
import hashlib
import zlib

import pytest
from conftest_rows import DOC_SCHEMA, document_rows

from cinderlens.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        start = at - at % 3
        out.append((at - start, [x for k, x in enumerate(level[start : start + 3], start) if k != at]))
        at //= 3
    return out


def expected(rows):
    """``rows``: doc_id, source, lang, n_chars, text."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for k, s in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = way(trees[s], at) + way(top, k)
            node = own
            if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0:
                node = leaf((*r[:4], r[4] and r[4].replace("\n", "")))
            for d, siblings in path:
                node = h(*siblings[:d], node, *siblings[d:])
            out.append((r[0], own, trees[s][-1][0], root, h(*(x for _, xs in path for x in xs)), node, node == root))
    return sorted(out, key=str)


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return sorted((tuple(r) for r in merkle.manifest(docs.repartition(3)).collect()), key=str)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in document_rows()]
    rows += [(7, None, None, None, None), (7, None, None, None, None), (7, None, "en", 3, "a\nb"), (None, "=x", "en", 1, ""), (None, "-", None, 0, "\n\n")]
    assert result(spark, rows) == expected(rows)


@pytest.mark.parametrize("sources", [1, 900])
def test_several_pages(spark, sources):
    # one group of several pages, and more groups than a page has places
    rows = [(i, "hot" if i % 3 else f"s{i % sources}", "en", i, f"line {i}\nnext" if i % 5 else None) for i in range(2700)]
    assert result(spark, rows) == expected(rows)


def test_one_row(spark):
    rows = [(4, "s", "en", 1, "x")]
    assert result(spark, rows) == expected(rows)


def test_records_are_stored_once(spark):
    blocks = spark.createDataFrame([("a", 0, 4, list("wxyz")), ("b", 0, 4, list("wxyz"))], "grp string, page long, n long, digests array<string>")
    pages, tops = merkle.build(blocks, 4)
    assert pages.count() == 1 and tops.count() == 2
    records = {x["digest"]: x["children"] for x in pages.first()["records"]}
    top = tops.first()["digest"]
    assert [records[d] for d in records[top]] == [["w", "x", "y"], ["z"]]
    assert all(h(*c) == d for d, c in records.items())


def test_clashing_columns(spark):
    schema = DOC_SCHEMA + ", rank int, grp int, digest int, path int"
    rows = [(*r, 1, 2, 3, 4) for r in document_rows()]
    assert merkle.manifest(spark.createDataFrame(rows, schema)).count() == len(rows)
