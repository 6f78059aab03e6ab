import pytest

from kinefield.queries import ORACLES, QUERIES
from tests.compare import SF, both


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    mine, theirs = both(spark, QUERIES[name], ORACLES[name])
    assert mine == theirs and mine


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
