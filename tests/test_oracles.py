"""Every query that has SQL gives the same rows as DuckDB; the others are in test_plain.py."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from oracle import check  # noqa: E402

from panelwright.plans import catalog  # noqa: E402

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    check(QUERIES[name](spark, sf), sf, ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
