"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect, plan

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def check_plan(text: str) -> None:
    """No cross join and no row-at-a-time Python in any registered query."""
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    check_plan(plan(df))
    assert compare(df, con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_has_rows(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    check_plan(plan(df))
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
