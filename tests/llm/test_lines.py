"""Boilerplate on hosts of few pages: the ratio decides there too."""

from tracemill.llm import lines


def cleaned(spark, pages, **options):
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(pages)], "doc_id long, source string, text string")
    return {r.row.doc_id: (r.cleaned, r.n_lines, r.n_dropped) for r in lines.clean(docs, **options).collect()}


def test_footer_of_a_host_of_five_pages(spark):
    found = cleaned(spark, [("small", f"own text {k}\nall pages end so") for k in range(5)])
    assert found == {k: (f"own text {k}", 2, 1) for k in range(5)}


def test_no_page_is_its_own_boilerplate(spark):
    pages = [("one", "a line\nanother"), ("two", "own\nfirst"), ("two", "own too\nsecond"), (None, "alone")]
    assert {k: v[0] for k, v in cleaned(spark, pages).items()} == {k: t for k, (_, t) in enumerate(pages)}


def test_every_row_is_a_page(spark):
    pages = [("host", "copied line"), ("host", "copied line"), *(("host", f"own {k}") for k in range(17))]
    found = cleaned(spark, pages)
    assert found[0] == ("", 1, 1) and found[1] == ("", 1, 1) and found[2] == ("own 0", 1, 0)
    assert cleaned(spark, [*pages, ("host", "one more")])[0] == ("copied line", 1, 0)  # 2 of 20 pages is at the ratio, not above


def test_nulls_blanks_ties_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, None, None, 1), (None, None, "", 2), (7, None, "foot\n \nx", 3), (7, None, " foot", 4)], "doc_id long, source string, text string, n_lines int")
    found = sorted((r.row.n_lines, r.cleaned, r.n_lines, r.n_dropped) for r in lines.clean(docs).collect())
    assert found == [(1, "", 0, 0), (2, "", 0, 0), (3, " \nx", 2, 1), (4, "", 1, 1)]


def test_ratio_decides_on_fifty_pages(spark):
    pages = [("host", f"own {k}" + ("\nsix of fifty" if k < 6 else "") + ("\nfive of fifty" if k < 5 else "")) for k in range(50)]
    found = cleaned(spark, pages)
    assert found[0] == ("own 0\nfive of fifty", 3, 1) and sum(n for _, _, n in found.values()) == 6
