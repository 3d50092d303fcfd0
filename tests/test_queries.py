"""Every named query against its SQL; without SQL, it must return rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import __spark_entry__ as entry
from tools.check import compare, open_tables

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return open_tables(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf):
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert ok, message


def test_entry_has_contexts(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "question", "context"]
    assert df.where("context <> ''").count() == df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
