"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tapewright.plans.all import registered

QUERIES = registered()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.7g}"
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, sf_dir, oracle, name):
    query = QUERIES[name]
    got = query.run(spark, sf_dir)
    result = oracle.execute(query.oracle())
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_rows_are_whole_and_repeatable(spark, sf_dir, name):
    """Queries without SQL: rows under their own columns, and the same ones again. What they hold is tested in test_forward_models and test_operators."""
    first, again = (QUERIES[name].run(spark, sf_dir) for _ in range(2))
    assert first.columns == again.columns and len(set(first.columns)) == len(first.columns)
    found = rows(first.columns, [tuple(r) for r in first.collect()])
    assert found and found == rows(again.columns, [tuple(r) for r in again.collect()])
