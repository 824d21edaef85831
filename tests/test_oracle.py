"""Every query with check SQL gives what DuckDB gives on the same files."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_duckdb(spark, sf, duck, name):
    frame = queries()[name](spark, sf)
    order = sorted(frame.columns)
    ours = sorted(repr(tuple(r[c] for c in order)) for r in frame.collect())
    cursor = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    theirs = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracle_names_are_queries():
    assert set(oracle_sql()) <= set(queries())
