"""Every registered query against its independent SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import check, connect  # noqa: E402
from fanout.plans.registry import oracle_sql, queries  # noqa: E402

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, data, name):
    assert check(spark, duck, data, name, QUERIES[name], SQL.get(name)) is None
