"""Each registered query of the event engine against its SQL twin in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tracemill.plans import incident_queries, log_queries, queries, report_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(values, columns):
    return sorted(tuple(str(plain(row[c])) for c in columns) for row in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, db, name):
    frame = queries.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    result = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows([r.asDict() for r in frame.collect()], columns) == rows([dict(zip(names, r)) for r in result.fetchall()], columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ord", "rule_id", "severity", "technique", "matched_value", "host", "source", "timestamp"]
