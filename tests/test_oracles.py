"""Every registered query against its SQL on the smallest given tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as driver  # noqa: E402
from check_oracles import compare, connect  # noqa: E402

from ledgerlens.plans import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and "status" in df.columns


def test_every_query_of_the_engine_has_an_oracle():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    df = driver.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in driver.oracle_sql():
        result = connect(SF_DIR).execute(driver.oracle_sql()[name])
        assert compare(df.columns, rows, [d[0] for d in result.description], result.fetchall()) == ""
