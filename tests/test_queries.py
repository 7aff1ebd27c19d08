"""Every query of the library against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from shutterlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def normal(rows, columns):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else repr(v) for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    columns = sorted(found.columns)
    got = normal([r.asDict() for r in found.collect()], columns)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = normal([dict(zip(names, r, strict=True)) for r in result.fetchall()], columns)
    assert sorted(names) == columns
    assert got == want


def test_entry_runs_on_the_smallest_tables(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
