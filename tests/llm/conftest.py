import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent.parent), str(Path(__file__).parent)]

from conftest_rows import DOC_SCHEMA, LABEL_SCHEMA, PAGE_SCHEMA, TURN_SCHEMA, document_rows, label_rows, page_rows, turn_rows


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder with the small tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(document_rows(), DOC_SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(page_rows(), PAGE_SCHEMA).repartition(3).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(label_rows(), LABEL_SCHEMA).repartition(3).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(turn_rows(), TURN_SCHEMA).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], PAGE_SCHEMA).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], LABEL_SCHEMA).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], TURN_SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="session")
def results(spark, tables):
    """Rows of each query over the small tables, worked out once."""
    from cinderlens.llm.queries import QUERIES

    done = {}

    def of(name):
        if name not in done:
            done[name] = [r.asDict() for r in QUERIES[name](spark, tables).collect()]
        return done[name]

    return of
