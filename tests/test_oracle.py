"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lodestone import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    expected = rows_of(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert [str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in a] == [str(float(x)) if hasattr(x, "__float__") and not isinstance(x, bool) else str(x) for x in b]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    """Queries that SQL can't express; `test_operators` pins the exact bootstrap to known bounds."""
    assert catalog.QUERIES[name](spark, SF).count() > 0
