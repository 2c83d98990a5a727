"""Every registered query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from doccensus.plans.inputs import BASE_TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert got
        return
    answer = duck.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert got == table(names, answer.fetchall())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"kb_domain", "grade", "pages", "mean_overall", "words"}


def test_no_oracle_without_query():
    assert set(ORACLE) <= set(QUERIES)
