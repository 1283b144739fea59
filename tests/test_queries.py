"""Every registered query runs, and those with SQL give what DuckDB gives. Kept out of this file: the llm queries."""

import os

import duckdb
import numpy as np
import pytest

from helixframe.catalogue import ORACLES, QUERIES


def rows(frame, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (float, np.floating)):
            return round(float(v), 6)
        return int(v) if isinstance(v, (int, np.integer, np.bool_)) else str(v)

    return sorted((tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, sql, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert got.columns.is_unique
    if name in ORACLES:
        want = sql.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry_module():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
