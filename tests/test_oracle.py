"""Every registered query against its SQL twin."""

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from emberlog.plans import oracle, registered

FOLDER = "/root/testdata/sf0.01"
# The training-data queries are tested with their package, over the same tables.
QUERIES = registered.queries()
ORACLES = oracle.oracle_sql()
# No SQL equivalent; their properties are tested in test_models, test_streaming.
ROWS_ONLY = {"cluster_summaries", "stream_monitor"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert not set(ORACLES) - set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLES[name]).df()) == []


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 835
