"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    ours = contract.queries()[name](spark, sf).toPandas()
    assert difference(ours, con.execute(SQL[name]).fetchdf()) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert contract.queries()[name](spark, sf).count() > 0


def test_names_agree():
    assert set(SQL) <= set(contract.queries())


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["split", "wc_split", "rows", "items", "users"]
    assert {r["wc_split"] for r in out.collect()} >= {"w_train", "c_valid", "c_test"}
