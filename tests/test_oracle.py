"""Every registered query against its SQL on the checking engine."""
import re

import pytest

import __spark_entry__ as entry
from check import compare, connect
from tests.conftest import DATA

OPTIONAL = re.compile(r"op\d+_|pipeline$")  # has tests of its own in tests/llm
QUERIES = {k: q for k, q in entry.queries().items() if not OPTIONAL.match(k)}
SQL = {k: q for k, q in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    text, ok = compare(spark, con, DATA, name, QUERIES[name], SQL.get(name))
    assert ok, text


def test_every_sql_belongs_to_a_query():
    assert not set(SQL) - set(QUERIES)
    assert set(QUERIES) == set(SQL)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
