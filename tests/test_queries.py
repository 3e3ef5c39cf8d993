"""Every registered query against its SQL, or for rows, on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SLOW = {"M20_detector_run", "M19_explanation_summary", "K8_metrics_summary"}
# pages and samples that start behind the last row of the smallest tables
EMPTY_WHEN_SMALL = {"Q23_filtered_page", "Q23_keyset_page"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    rows = {r["alert_level"]: r["rows"] for r in contract.entry(spark).collect()}
    assert set(rows) == {"Normal", "Suspicious", "Attack"} and sum(rows.values()) > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - SLOW))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    problems = compare(df, con, sql)
    if name in EMPTY_WHEN_SMALL:
        problems = [p for p in problems if p != "no rows"]
    assert problems == []
