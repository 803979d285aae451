"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from condensa.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def norm(rows):
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    cols = ", ".join(f'"{c}"' for c in sorted(got.columns))
    want = duck.sql(f"select {cols} from ({catalog.ORACLE_SQL[name]}) q")
    assert norm(got.select(sorted(got.columns)).collect()) == norm(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
