"""Every registered query with a SQL counterpart gives the same rows in DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{file}'")
    return connection


def said(x):
    """A value as text: missing ones alike, whole numbers alike whether a column with missing values made them floats."""
    if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "null"
    return str(int(x)) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else str(x)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(said, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    mine = contract.queries()[name](spark, DATA).toPandas()
    theirs = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
