"""The driver contract: names, SQL, and the registered queries of the reference's operators against DuckDB on small tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from gleanery.plans import catalog
from tests.fixture_cases import CASES

FOLDER = "/root/testdata/sf0.001"


def normal(df):
    def one(v):
        if hasattr(v, "__len__") and not isinstance(v, str | bytes):
            return [one(x) for x in v]
        if v is None or v is pd.NaT or v != v:
            return None
        if hasattr(v, "isoformat") or isinstance(v, np.datetime64):
            return str(v)[:10]
        return round(float(v), 6) if isinstance(v, int | float) or hasattr(v, "dtype") else v

    columns = sorted(df.columns)
    return columns, sorted(repr([one(v) for v in row]) for row in df[columns].astype(object).itertuples(index=False))


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert callable(queries["email_inventory"])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    for name, query in catalog.QUERIES.items():
        assert normal(query(spark, FOLDER).toPandas()) == normal(con.sql(catalog.ORACLE_SQL[name]).df()), name


def test_fixtures(spark):
    for name, (run, expected) in CASES.items():
        assert normal(run(spark).toPandas()) == normal(duckdb.sql(expected).df()), name
