"""License scans by an exact set-similarity join of text blocks with license templates.

A block is one of the overlapping windows of ``block_words`` words over the whole text, line ends or not, as notices are
often wrapped; windows start every ``block_words / 2`` words, so any run of half that many words lies in one block whole,
and windows are made larger where half of one is shorter than the longest template. A block meets a template when it holds at least ``threshold`` of the template's distinct words. The join is exact:

* tokens are ordered by how many texts hold them, counted by Spark over all texts (only template tokens can matter);
* prefix: a block that meets a template of n words holds one of its n - ceil(threshold * n) + 1 rarest words;
* length: it has at least ceil(threshold * n) template words;
* position: with both word lists in the global order, a match at places i and j leaves room for at most
  1 + min(n - i, m - j) - 1 common words from there on;
* survivors are verified by counting common words.

Templates are a bounded list given by the caller and go to the tasks as they are; texts stay in their partitions.

Words are runs of 0-9, a-z and all characters from 0x80 on, after A-Z are lower-cased. Defined results: a null text is
empty, has no words and no labels; labels are distinct and sorted; a repeated row gets the same result; empty tables
give empty results; long texts are cut into blocks, never dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlens.llm.text import slices, utf8

#: Phrases that give a label wherever their words stand consecutively.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label to the wordings of its notices.
TEMPLATES = {
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "agpl": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all-rights-reserved": ["Copyright. All rights reserved. No part of this publication may be reproduced without permission"],
}
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
#: Words of a block.
BLOCK_WORDS = 64

#: Word bytes lower-cased; all else a space.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def normalised(text: bytes) -> bytes:
    """Words separated by spaces."""
    return text.translate(_WORDS)


def template_sets(templates: dict[str, list[str]]) -> list[tuple[str, frozenset[bytes]]]:
    """Label and distinct words of every template."""
    return [(label, frozenset(normalised(t.encode()).split())) for label, own in sorted(templates.items()) for t in own]


def token_order(docs: DataFrame, tokens: frozenset[bytes], text_col: str = "text") -> list[bytes]:
    """The tokens from rare to frequent by the number of texts that hold them (ties by the token). The counts are summed in
    each task and then over tasks, at most one row per token; ``tokens`` is the bounded set of template words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                counts.update(tokens.intersection(normalised(text).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    n = {bytes(r["token"]): r["n"] for r in found.collect()}
    return sorted(tokens, key=lambda t: (n.get(t, 0), t))


class TemplateIndex:
    """The prefix index over templates, with words as ranks in the global order."""

    def __init__(self, templates: dict[str, list[str]], order: list[bytes], threshold: float):
        self.rank = {t: i for i, t in enumerate(order)}
        self.templates = [(label, sorted(self.rank[w] for w in own)) for label, own in template_sets(templates) if own]
        self.need = [math.ceil(threshold * len(own) - 1e-9) for _, own in self.templates]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, (_, own) in enumerate(self.templates):
            for i in range(len(own) - self.need[k] + 1):
                self.index.setdefault(own[i], []).append((k, i))
        self.prefix_words = frozenset(t for t, i in self.rank.items() if i in self.index)

    def matches(self, block: list[int]) -> list[tuple[int, float]]:
        """Templates that the block (sorted ranks of its template words) meets, with the containment."""
        seen, out = set(), []
        m = len(block)
        for j, token in enumerate(block):
            for k, i in self.index.get(token, ()):
                own = self.templates[k][1]
                # earlier places of both are already known to differ, as matches are met in order
                if k in seen or m < self.need[k] or 1 + min(len(own) - i, m - j) - 1 < self.need[k]:
                    continue
                seen.add(k)
                common = len(set(block).intersection(own))
                if common >= self.need[k]:
                    out.append((k, common / len(own)))
        return out


def blocks_of(words: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Start and end of the blocks of one text."""
    step = max(1, size // 2)
    for start in range(0, max(1, len(words) - step), step):
        yield start, min(len(words), start + size)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: ``doc_id, n_words, phrases array<(start, label)>, matches array<(label, start, end, score)>`` with
    word positions."""
    templates = TEMPLATES if templates is None else templates
    phrases = {normalised(p.encode()): label for p, label in (PHRASES if phrases is None else phrases).items()}
    longest = max((len(normalised(t.encode()).split()) for own in templates.values() for t in own), default=0)
    block_words = max(block_words, 2 * longest)
    tokens = frozenset().union(*(own for _, own in template_sets(templates)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = token_order(rows, tokens)

    def find(text: bytes, index: TemplateIndex) -> tuple[int, list, list]:
        text = normalised(text)
        all_words = text.split()
        found = []
        joined = None
        for phrase, label in phrases.items():
            if phrase.split()[0] in text and phrase.split()[-1] in text:
                joined = joined or b" " + b" ".join(all_words) + b" "
                at = joined.find(b" " + phrase + b" ")
                while at >= 0:
                    found.append({"start": joined.count(b" ", 0, at), "label": label})
                    at = joined.find(b" " + phrase + b" ", at + 1)
        hits = []
        if not index.prefix_words.isdisjoint(all_words):
            for a, b in blocks_of(all_words, block_words):
                if not index.prefix_words.isdisjoint(all_words[a:b]):
                    block = sorted({index.rank[w] for w in all_words[a:b] if w in index.rank})
                    hits.extend({"label": index.templates[k][0], "start": a, "end": b, "score": score} for k, score in index.matches(block))
        return len(all_words), sorted(found, key=lambda x: x["start"]), hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, order, threshold)
        places = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches):
            found = [find(text, index) for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], places), pa.array([x[2] for x in found], spans)], ["doc_id", "n_words", "phrases", "matches"])

    return rows.mapInArrow(run, "doc_id long, n_words long, phrases array<struct<start: long, label: string>>, matches array<struct<label: string, start: long, end: long, score: double>>")


def license_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: the phrases' labels, these with the
    templates' labels, and the best containment (1 where a phrase stands)."""
    base = F.array_sort(F.array_distinct(F.col("phrases.label")))
    every = F.array_sort(F.array_union(F.col("phrases.label"), F.col("matches.label")))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(F.col("phrases.start")).alias("first_word"),
        F.array_max(F.col("phrases.start")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("matches.score")), F.lit(0.0))).alias("score"),
    )
