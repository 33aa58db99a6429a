"""Every registered query of the library proper against its SQL, at the smallest scale."""

import duckdb
import pytest

from recordlab import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    if name in queries.ORACLE:
        rel = con.sql(queries.ORACLE[name])
        assert sorted(rel.columns) == columns
        assert got == sorted(map(repr, rel.select(*columns).fetchall()))
