import os
import sys

import pytest

import __spark_entry__ as contract
import queries as registered

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")


def test_every_query_has_an_oracle():
    assert set(registered.queries()) == set(registered.oracle_sql())
    assert set(registered.queries()) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 80


@needs_data
def test_entry_runs(spark):
    assert contract.entry(spark).limit(1).count() == 1


@needs_data
def test_every_oracle_can_be_planned():
    import compare

    connection = compare.oracle(SMALL)
    for name, sql in contract.oracle_sql().items():
        try:
            connection.execute(f"EXPLAIN {sql}")
        except Exception as error:
            raise AssertionError(f"{name}: {error}") from error


@needs_data
@pytest.mark.parametrize(
    "name",
    ["universe", "exclusions", "dim_scd2_relabelled", "chain_calendar", "snapshot_check", "fact_pit_sliced",
     "anchor_metric_relabelled", "dq_integrity", "dq_suite"],
)
def test_agrees_with_the_oracle(spark, name):
    import compare

    ok, note = compare.compare(spark, compare.oracle(SMALL), SMALL, name)
    assert ok, note
