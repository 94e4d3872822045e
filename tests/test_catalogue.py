"""Every catalogue query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from gradus.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{name}')")
    return con


def plain(rows):
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)
