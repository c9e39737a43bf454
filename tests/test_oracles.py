"""Every query of the analyses against its SQL oracle, on the smallest tables."""

import os

import duckdb
import pytest

from tidewell import catalog

DATA = "/root/testdata/sf0.001"
SLOW = {n for n in catalog.oracle_sql() if n.startswith("stream_")} - {"stream_q2", "stream_dedup"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n not in SLOW])
def test_query_matches_oracle(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
