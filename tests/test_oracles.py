"""Every registered query against its SQL counterpart."""

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.sql_tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert compare.difference(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["recording_id", "chunk", "num_frames", "fps", "actions"]
    assert rows.count() > 0
