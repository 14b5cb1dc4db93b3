"""Queries with SQL give DuckDB's rows."""

import math

import duckdb
import pytest

from driftline import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def clean(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    left = sorted(([clean(v) for v in r] for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    right = sorted(([clean(r[c]) for c in columns] for r in df.collect()), key=repr)
    assert left == right
