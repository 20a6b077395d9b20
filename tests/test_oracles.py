import pytest

from lagweave.plans.oracles import ORACLES
from lagweave.plans.queries import QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert differences(spark, QUERIES[name], ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
