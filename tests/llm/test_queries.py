"""Registered queries on the smallest given tables, against their SQL where there is one."""

import pytest
from check_oracles import compare, connect

from ledgerlens.llm.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    result = connect(SF_DIR).execute(ORACLES[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in result.description], result.fetchall()) == ""
