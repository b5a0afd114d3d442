"""Every query of the library against its SQL counterpart."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle.sql import ORACLE
from tools.check import compare
from tracemill.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    ok, note = compare(spark, duck, QUERIES[name], ORACLE[name], sf_dir)
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
