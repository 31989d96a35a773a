"""Indicators in odd texts against the SQL of their queries."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.plans import queries, report_queries  # noqa: F401

ODD = (
    "10.0.0.1 10.0.0.2", "10.0.0.1,10.0.0.2,10.0.0.3", "10.0.0.1  10.0.0.2\n", "é10.0.0.1²", "müller.com ßx.org日本.net", "http://a.b/x\x0by\x85z\u2028 \u017fx.com", "http\u017f://q.de", "\u212ar.\u212ar ı.com İ.com",
    "é" + "a" * 32 + "日", "_" + "a" * 40 + " " + "B" * 64 + "ß", "éc:\\x\x0b.exe|d", "-x.org.", "a-b.co\u0301", "x.com_ x.com٣", "", None,
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder, n = str(tmp_path_factory.mktemp("odd")), len(ODD)
    pd.DataFrame({"doc_id": range(n), "text": ODD}).to_parquet(f"{folder}/documents.parquet")
    pd.DataFrame({"page_id": range(n), "url": "http://u.com/1", "html": ODD}).to_parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["document_indicators", "indicator_counts", "indicator_rows", "indicator_totals"])
def test_odd_texts_agree_with_sql(spark, folder, name):
    connection = duckdb.connect()
    for t in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = connection.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect()) == sorted(result.fetchall())


def test_neighbouring_addresses_are_all_found(spark):
    found = spark.range(1).select(T.indicators(F.lit("10.0.0.1 10.0.0.2"), ("ip",))).first()[0]
    assert [r["value"] for r in found] == ["10.0.0.1", "10.0.0.2"]
