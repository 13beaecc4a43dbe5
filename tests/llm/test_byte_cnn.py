"""Scores against plain loops, gradients against differences, and held-out accuracy."""

import math
import zlib

import numpy as np
import pytest
from conftest_rows import DOC_SCHEMA, document_rows

from cinderlens.llm import byte_cnn
from cinderlens.llm.byte_cnn import BLOCK, CHUNK, FILTERS, STEP, WIDTH

LABELS = "doc_id long, quality int, toxic int"


def plain_score(text, net):
    tables = net.tables().astype(np.float64)
    n = max(1, len(text))
    data = text + b"\0" * (WIDTH + n - len(text))
    answers = [[sum(tables[j][data[t + j]][f] for j in range(WIDTH)) for f in range(FILTERS)] for t in range(n)]
    chunks = []
    for s in range(0, max(1, -(-n // BLOCK) - 1) * BLOCK, STEP):
        own = answers[s : s + CHUNK]
        chunks.append([math.tanh(max(a[f] for a in own) + net.shift[f]) for f in range(FILTERS)])
    columns = list(zip(*chunks, strict=True))
    x = [sum(c) / len(c) for c in columns] + [max(c) for c in columns] + [min(c) for c in columns]
    unit = [max(0.0, sum(a * b for a, b in zip(x, w, strict=True)) + h) for w, h in zip(net.hidden.T, net.hidden_shift, strict=True)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(unit, net.out, strict=True)) - net.out_shift[0]))


TEXTS = [b"", b"a", b"x" * 63, b"y" * 64, b"z" * 65, b"abc " * 64, "é漢".encode() * 60, b"Word, " * 150, b"q" * (STEP + BLOCK), bytes(range(256)) * 3]


def test_scores_by_definition():
    net = byte_cnn.fresh(1)
    got = byte_cnn.probability(byte_cnn.pooled(TEXTS, net.tables(), net.shift), net)
    assert np.allclose(got, [plain_score(t, net) for t in TEXTS], atol=1e-5)
    alone = [byte_cnn.probability(byte_cnn.pooled([t], net.tables(), net.shift), net)[0] for t in TEXTS]
    assert np.allclose(got, alone, atol=1e-12)


def test_a_very_long_text_counts_to_its_end():
    net = byte_cnn.fresh(2)
    long = b"plain words and " * 20_000
    a, b = byte_cnn.pooled([long, long[:-9] + b"#$%&|<>#$"], net.tables(), net.shift)
    assert not np.allclose(a, b)


def test_sample_pieces_are_chunks():
    net = byte_cnn.fresh(3)
    cut = [byte_cnn.pieces_of(t, 99) for t in TEXTS]
    sample = byte_cnn.Sample([p for p, _ in cut], [w for _, w in cut], np.ones(len(TEXTS)))
    p, _ = byte_cnn._gradients(net, sample, np.arange(len(TEXTS)), learn=False)
    assert np.allclose(p, [plain_score(t, net) for t in TEXTS], atol=1e-5)
    assert len(byte_cnn.pieces_of(b"x" * 100_000, 16)[0]) == 16


def test_gradients_by_differences():
    rng = np.random.default_rng(4)
    net = byte_cnn.fresh(4)
    cut = [byte_cnn.pieces_of(bytes(rng.integers(1, 255, n, dtype=np.uint8)), 9) for n in (40, 700, 300, 1000)]
    sample, docs = byte_cnn.Sample([p for p, _ in cut], [w for _, w in cut], np.array([0.0, 1, 1, 0])), np.arange(4)
    loss = lambda: -np.mean(np.log(np.where(sample.labels == 1, p := byte_cnn._gradients(net, sample, docs, learn=False)[0], 1 - p)))
    _, grads = byte_cnn._gradients(net, sample, docs)
    for part, grad in list(zip(net.parts(), grads, strict=True))[1:]:
        flat, g = part.reshape(-1), grad.reshape(-1)
        for k in np.argsort(-abs(g))[:3]:
            was, step = flat[k], 1e-3
            flat[k] = was + step
            up = loss()
            flat[k] = was - step
            down = loss()
            flat[k] = was
            assert math.isclose((up - down) / (2 * step), g[k], rel_tol=0.08, abs_tol=1e-4)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r["doc_id"]: r for r in byte_cnn.quality_report(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    right = {q: [p == q for p, y in held if y == q] for q in (0, 1)}
    assert sum(right[0]) >= 0.9 * len(right[0]) and sum(right[1]) >= 0.98 * len(right[1])


def test_only_allowed_labels_are_learned_from(spark):
    rows = [(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (4, 1, 0), (6, 7, 0)]
    got = {r["id"]: r["label"] for r in byte_cnn.usable_labels(spark.createDataFrame(rows, LABELS)).collect()}
    assert got == {i: i % 2 for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1 and i != 4}
    docs = spark.createDataFrame([(i, f"text {i}") for i in [*range(60), 5, 5]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60) if i != 4], "id long, label int")
    drawn = byte_cnn.drawn(docs, labels, rows=20).collect()
    assert len(drawn) == 20 and len({r["id"] for r in drawn}) == 20


@pytest.mark.parametrize("labels", [[], [(100, 1, 0), (98, 1, 0), (97, 1, 0)], [(100 - i, i % 2, 0) for i in range(30)]])
def test_odd_tables(spark, labels):
    docs = spark.createDataFrame(document_rows(), DOC_SCHEMA)
    frame = spark.createDataFrame(labels, LABELS)
    rows = byte_cnn.quality_report(docs, frame).collect()
    assert len(rows) == len(document_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    same = {}
    for r in rows:
        text = next((x[1] or "" for x in document_rows() if x[0] == r["doc_id"]), "")
        assert same.setdefault(text, r["score"]) == pytest.approx(r["score"], abs=1e-12)
    assert byte_cnn.quality_report(docs.limit(0), frame).count() == 0
