"""Every query of the curation engine against its DuckDB twin."""

import duckdb
import pandas as pd
import pytest

from lexforge import queries as Q
from lexforge import record_queries as R

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "labels", "benchmark", "orders", "part")
QUERIES, ORACLE_SQL = Q.QUERIES | R.QUERIES, Q.ORACLE_SQL | R.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def text(v):
    if v is None or v is pd.NA or v != v:
        return ""
    return str(v) if isinstance(v, (bool, str)) else str(round(float(v), 6)) if isinstance(v, (int, float)) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(text, r)) for r in frame[cols].astype(object).itertuples(index=False))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_twin(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).fetchdf())
