"""Every query of the library against its SQL, at the smallest scale."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from basalt.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def _plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 5)
    return v


def _rows(rows, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert df.columns
        return
    answer = db.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(got, [df.columns.index(c) for c in columns]) == _rows(answer.fetchall(), range(len(columns)))
