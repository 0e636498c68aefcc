"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from turnstile.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
con = duckdb.connect()
for f in glob.glob(f"{SF}/*.parquet"):
    con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")


def shown(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_other_queries_give_rows(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() > 0
