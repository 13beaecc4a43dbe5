"""Chunks by paragraphs and sentences against plain loops."""

import random
import re

import pytest

from cinderlens.operators.retrieval import chunks

LOW = "".join(map(chr, range(33)))
SPACES = " \t\n\x0b\f\r"


def fixed(text, size, overlap):
    out, at = [], 0
    while True:
        out.append(text[at : at + size])
        if at + size >= len(text):
            return out
        at += size - overlap


def paragraphs(text, size, _):
    out, open_ = [], ""
    for p in filter(None, (x.strip(LOW) for x in re.split(r"\n{2,}", text))):
        if open_ and len(open_) + 2 + len(p) > size:
            out.append(open_)
            open_ = p
        else:
            open_ = f"{open_}\n\n{p}" if open_ else p
        if len(open_) > size:
            out += fixed(open_, size, 0)
            open_ = ""
    return [*out, open_] if open_ else out


def sentences(text, size, overlap):
    out, open_, tail = [], "", ""
    for s in filter(None, (x.strip(LOW) for x in re.split(rf"(?<=[.!?。？！])[{SPACES}]+", text))):
        if not open_:
            open_ = f"{tail} {s}" if tail else s
        elif len(open_) + 1 + len(s) <= size:
            open_ += " " + s
        else:
            out.append(open_)
            tail = open_[-overlap:] if len(open_) > overlap else ""
            open_ = f"{tail} {s}" if tail else s
        if len(open_) > size * 1.5:
            out += fixed(open_, size, overlap)
            open_ = tail = ""
    return [*out, open_] if open_ else out


@pytest.mark.parametrize(("strategy", "brute"), [("paragraph", paragraphs), ("sentence", sentences)])
def test_chunks(spark, strategy, brute):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 12)))
    texts = ["", "  ", "one", "aaa\r\n\n\n\tbbb", "\x01\n\n\x02", "a" * 200, *("".join(word() + rng.choice([" ", " ", ". ", "! ", "\n", "\n\n", ".\n\n\n", "\r\n\n\n\t", "\x01\n\n", "!\t\x02"]) for _ in range(rng.randrange(1, 90))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["c"] for r in rows.select("id", chunks(rows["text"], strategy, 60, 9).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t.strip(SPACES), 60, 9), repr(t)
