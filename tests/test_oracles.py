"""Every registered query against its SQL twin, on the smallest given tables."""

import pytest

import __spark_entry__ as E
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(E.queries()))
def test_query(spark, con, name):
    same, rows, _, _, detail = compare(spark, con, SF, name)
    assert same is not False, detail
    assert rows > 0


def test_entry(spark):
    assert E.entry(spark).columns == ["cluster_id", "points"]
