"""The registered queries against their SQL, on a small scale."""

import os

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows(columns, found):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in by) for r in found), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    got = df.collect()
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(columns, want.fetchall())
