"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from lotwright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert catalogue.oracle_sql().keys() <= catalogue.queries().keys()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (name, c, got[~same].head(), want[~same].head())


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys() - {"best_building"}))
def test_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.oracle_sql().keys() <= e.queries().keys(); from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
