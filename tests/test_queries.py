"""Every query on the smallest tables: against its SQL where there is one, else that it runs."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings app_user workflow node_definition llm_global_config execution_record eval_item".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    if isinstance(value, float) and value == int(value) or hasattr(value, "item") and getattr(value, "dtype", None) is not None and value.dtype.kind in "iu":
        return int(value)
    return str(value) if isinstance(value, pd.Timestamp) else value


def table(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(plain, x)) for x in frame.astype(object).values.tolist()), key=repr)


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    if name not in ORACLES:
        assert frame.count() >= 0
        return
    assert table(frame.toPandas()) == table(duck.execute(ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
