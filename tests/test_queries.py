"""Every registered query against its SQL twin, on the smallest test tables."""

import pytest

import __spark_entry__ as contract
from checks import load_all
from tools.check import connect, oracle_rows, spark_rows

REGISTRY = load_all()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(REGISTRY.queries))
def test_query(name, spark, folder, duck):
    names, _, got = spark_rows(REGISTRY.queries[name](spark, folder))
    want_names, _, want = oracle_rows(duck, REGISTRY.oracles[name])
    assert sorted(names) == sorted(want_names)
    assert got == want


def test_contract(spark):
    df = contract.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "row_num", "page_num"]
    assert df.count() == 150
    assert {r[0] for r in df.select("c_name").distinct().collect()} == {"*****"}
    assert set(contract.oracle_sql()) <= set(contract.queries())
