"""Every query of the engine against its SQL on DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from flowloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.execute(SQL[name])
    columns = [d[0] for d in expected.description]
    got = table(df.columns, df.collect())
    assert got == table(columns, expected.fetchall())
    assert got[1], "the query should have rows"
