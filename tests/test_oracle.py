"""Every query with an oracle statement equals DuckDB on the smallest
driver tables (the driver repeats this at sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from oracle_check import compare

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_oracle_sf0001(spark):
    res = compare(spark, SF, NAMES, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "ok"}
    assert not bad, bad


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "category" in df.columns
