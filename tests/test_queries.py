import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest
from oracle import connect, difference

from cinderlens import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    assert difference(registry.queries()[name](spark, FOLDER), con, registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0
