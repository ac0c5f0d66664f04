"""Every query with SQL gives what DuckDB gives for it."""

import duckdb
import pytest

from lodeline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    return con


def rows(values):
    return sorted(repr(tuple(round(v, 7) if isinstance(v, float) else v for v in r)) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    found = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(names)
    order = [names.index(c) for c in frame.columns]
    assert rows(map(tuple, frame.collect())) == rows(tuple(r[i] for i in order) for r in found.fetchall())


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
