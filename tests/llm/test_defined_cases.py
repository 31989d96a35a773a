"""Nulls in any column, repeated rows and ids, ties and clashing names: every query gives one defined result."""

import pytest

from tracemill.llm import queries

LONG = " ".join(f"w{i % 97} v{i % 89}" for i in range(400))
ROWS = [
    (None, None, None, None, None, "x"), (None, LONG, "en", None, 1, None), (None, LONG, "en", "s", 1, None), (7, "same words here again", "en", "s", 3, "x"), (7, "same words here again", "en", "s", 3, "x"),
    (7, "other text of the same id", None, "s", 3, "x"), (8, LONG, "en", "t", 9, "x"), (9, "", "en", "t", 0, "x"), (10, "\n \n", "en", "t", 3, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {} string"


@pytest.fixture(scope="module", params=["node", "row"])
def odd(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ROWS, SCHEMA.format(request.param)).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (8, None, 1), (None, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "same words here again"), (2, None), (None, "same words here again")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(spark, odd, number):
    name = next(n for n in queries.QUERIES if n.startswith(f"op{number}_"))
    return queries.QUERIES[name](spark, odd).collect()


@pytest.mark.parametrize("number", [2, 4, 7, 8, 9, 10, 12, 13])
def test_one_row_per_row(spark, odd, number):
    found = rows(spark, odd, number)
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in ROWS)


def test_benchmark_items_in_repeated_rows(spark, odd):
    assert sorted((r.doc_id, str(r.item_id)) for r in rows(spark, odd, 1)) == [(7, "1"), (7, "None")]


def test_near_duplicates_of_odd_rows(spark, odd):
    found = rows(spark, odd, 3)
    assert len(found) == len(ROWS) and all(r.component_id == 7 for r in found if r.doc_id == 7)
    assert {r.kept for r in found if r.doc_id is None} == {True}


def test_licences_and_pieces_of_odd_rows(spark, odd):
    assert rows(spark, odd, 5) == []
    assert sum(r.length for r in rows(spark, odd, 6)) > 3000


def test_equal_texts_are_treated_alike(spark, odd):
    assert {r.n_removed == r.n_bytes for r in rows(spark, odd, 7) if r.n_bytes > 1000} == {True}
    assert len({round(r.score, 9) for r in rows(spark, odd, 10) if r.n_tokens > 100}) == 1
    assert len({r.fingerprint for r in rows(spark, odd, 8) if r.n_chars and r.n_chars > 1000}) == 1
