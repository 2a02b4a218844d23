"""Every registered query with SQL against DuckDB on the smallest tables, order aside."""

import os
from importlib.util import find_spec

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def shown(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(round(value, 8))
    return str(list(value)) if isinstance(value, (list, tuple)) else str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([shown(r[i]) for i in order] for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[0]
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    assert got == table_of([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_the_training_data_package_is_optional():
    assert (find_spec("corpusloom.llm") is not None) or not any(q.startswith("op") for q in QUERIES)
