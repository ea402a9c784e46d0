"""Every registered query against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest
from lathework import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(x):
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat() if hasattr(x, "hour") else x.isoformat()
    if isinstance(x, float) and math.isfinite(x):
        return round(x, 4) + 0.0
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    assert mine[1], "no rows"
    done = duck.execute(catalog.ORACLE_SQL[name])
    assert mine == rows([d[0] for d in done.description], done.fetchall())
