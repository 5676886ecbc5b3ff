"""Every query beside its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as driver
from millrace.plans import catalogue


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def compare(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(x[0] for x in relation.description)
    order = sorted(range(len(columns)), key=lambda i: relation.description[i][0])
    ours = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    compare(catalogue.QUERIES[name](spark, sf_dir), duck.execute(catalogue.SQL[name]))


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL) and set(driver.oracle_sql()) <= set(driver.queries())


def test_flagship(spark):
    assert driver.entry(spark).count() > 0


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalogue.scan_pushed_down(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_shipdate" not in plan
