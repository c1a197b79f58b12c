"""Every core query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from legajo import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()
#: No words with neighbours enough, and no numbers of enough mistyped queries, in the smallest tables.
MAY_BE_EMPTY = {"corpus_synonyms"}


def norm(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(norm, value)) + "]"
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    duck.execute(SQL[name])
    want = rows([d[0] for d in duck.description], duck.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in duck.description)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    """What they hold is compared with brute force in test_operators, test_whole and test_chain; here each gives rows, without a null in its first column, under names that differ."""
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows or name in MAY_BE_EMPTY
    assert len(set(df.columns)) == len(df.columns) and all(r[0] is not None for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
