"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from check import compare, matches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def compiled(spark):
    """A session that generates code, as users' sessions do."""
    session = spark.newSession()
    session.conf.set("spark.sql.codegen.wholeStage", "true")
    session.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
    return session


@pytest.mark.parametrize("name", list(spark_entry.queries()))
def test_query(compiled, db, name):
    found = spark_entry.queries()[name](compiled, SF).toPandas()
    assert len(found)
    if name in spark_entry.oracle_sql():
        expected = db.execute(spark_entry.oracle_sql()[name]).df()
        assert matches(found, expected), compare(found, expected)


def test_every_twin_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry(spark):
    frame = spark_entry.entry(spark)
    assert frame.columns == ["word_id", "mu", "y0", "y1", "y2", "y3"] and frame.count() == 200
