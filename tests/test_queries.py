"""Every registered query at the smallest scale, against its SQL where it has one."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    good, text = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert good, text


def test_entry(spark):
    assert entry.entry(spark).columns == ["client_id", "total", "transactions", "avg_ticket", "best_day"]


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
