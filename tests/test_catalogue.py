"""Every query with oracle SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from bidloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def _rows(frame, cols):
    return sorted(map(tuple, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    mine, theirs = catalogue.queries()[name](spark, DIR).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    assert _rows(mine, cols) == _rows(theirs, cols)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
