"""Every registered query against its SQL in DuckDB, on sf0.001."""

import decimal
import os

import duckdb
import pytest

from stowage.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF_DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    order = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    result = duck.execute(ORACLE[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == order
    at = [columns.index(c) for c in order]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE))
def test_rows(spark, name):
    QUERIES[name](spark, SF_DIR).collect()
