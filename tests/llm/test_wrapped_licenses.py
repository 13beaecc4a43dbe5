"""Notices that are wrapped over several lines."""

import textwrap

import pytest

from cinderlens.llm.licenses import TEMPLATES, license_report


@pytest.mark.parametrize("width", [30, 72])
def test_wrapped_notices_keep_their_labels(spark, width):
    filler = " ".join(f"filler{i}" for i in range(45))
    rows = [(100 * k + i, label, f"{filler}\n" + "\n".join(textwrap.wrap(notice, width, initial_indent=" * ", subsequent_indent=" * ")) + f"\n{filler}") for k, label in enumerate(sorted(TEMPLATES)) for i, notice in enumerate(TEMPLATES[label])]
    got = {r["doc_id"]: r["labels"].split(",") for r in license_report(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()}
    for i, label, _ in rows:
        assert label in got[i]
