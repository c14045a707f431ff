from datetime import date

import pytest

from foliograph.functions.text import parse_terms
from foliograph.operators import browse


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "cve string, record long")


def test_lookup(catalogue):
    assert browse.lookup_one(catalogue, cve="b")["record"] == 3 and browse.lookup_one(catalogue, record=2)["cve"] == "a" and browse.lookup_one(catalogue, cve="x") is None
    with pytest.raises(browse.Ambiguous) as error:
        browse.lookup_one(catalogue, cve="a")
    assert error.value.candidates == [1, 2]
    for bad in ({}, {"cve": "a", "record": 1}):
        with pytest.raises(browse.InvalidRequest):
            browse.lookup(catalogue, **bad)


def test_requests_are_checked(spark):
    rows = spark.createDataFrame([(1, date(2020, 1, 1)), (2, None)], "number long, date date")
    assert browse.exactly(rows, number=2).count() == 1 and browse.exactly(rows, year=2020).count() == 1
    for bad in ({"number": 0}, {"number": True}, {"other": 1}, {"number": "1"}):
        with pytest.raises(browse.InvalidRequest):
            browse.exactly(rows, **bad)
    with pytest.raises(browse.InvalidRequest):
        browse.check_search([], {"section": None}, {}, None, None)
    with pytest.raises(browse.InvalidRequest):
        browse.check_search(parse_terms(["x"]), {}, {}, date(2021, 1, 1), date(2020, 1, 1))
    browse.check_search([], {}, {"number": 3}, None, None)
    assert browse.between(rows).count() == 2 and browse.between(rows, since=date(2000, 1, 1)).count() == 1
    with pytest.raises(browse.InvalidRequest):
        browse.limited(rows, 501)
    page, total = browse.limited(rows, 1, rows.number.desc())
    assert page.first()["number"] == 2 and total.first()["total"] == 2


def test_listing_without_the_second_catalogue(spark):
    schema = "bulletin string, number long, date date"
    one, two = spark.createDataFrame([("a", 1, date(2020, 1, 1))], schema), spark.createDataFrame([("b", 2, date(2020, 2, 1)), ("c", 3, None)], schema)
    rows, summary = browse.listing(one, two, date(2020, 1, 1), date(2020, 12, 31), 1)
    assert [r["bulletin"] for r in rows.collect()] == ["b"] and tuple(summary.first()) == (2, True, False)
    assert tuple(browse.listing(one, None, date(2020, 1, 1), date(2020, 1, 1))[1].first()) == (1, False, True)


def test_hidden_articles_by_section_name(spark):
    listed = spark.createDataFrame([(1, 5, 38, "Economía"), (1, 6, 39, "Otra")], "bulletin long, number long, section_id int, section string")
    hidden = spark.createDataFrame([(1, 7, "ECONOMIA"), (1, 8, "Otra"), (2, 9, "Economía")], "bulletin long, number long, section string")
    assert sorted(r["number"] for r in browse.of_section(listed, hidden, 38).collect()) == [5, 7]


def test_text_from_page_pdf_or_nowhere(spark):
    pages = spark.createDataFrame([(1, [("a",)]), (2, [(" ",)]), (3, None), (4, [])], "id long, pages array<struct<text:string>>")
    pdf = spark.createDataFrame([(1, 1, "z"), (2, 2, "y"), (2, 1, "x"), (3, 1, "")], "id long, page int, text string")
    got = {r["id"]: (r["origin"], r["texts"]) for r in browse.readable_text(pages, pdf).collect()}
    assert got == {1: ("html", ["a"]), 2: ("pdf", ["x", "y"]), 3: ("none", []), 4: ("none", [])}


def test_catalogue_warnings(spark):
    links = [(0, 1, "a", date(2020, 1, 1), 2020), (1, 1, "b", date(2020, 1, 1), 2020), (2, 2, "c", date(2019, 1, 1), 2020), (3, 3, None, None, 2020), (4, 4, "d", date(2019, 1, 1), 2020)]
    got = {(r["kind"], r["record"], r["year"], r["n"]) for r in browse.catalogue_warnings(spark.createDataFrame(links, "pos long, record long, cve string, date date, header_year int")).collect()}
    assert got == {("unreadable", 3, None, 1), ("conflict", 1, None, 2), ("misfiled", None, 2020, 2)}


def test_warnings_are_dealt_by_record(spark, small, monkeypatch):
    """Tasks become more with the lines, and the first row of a record is found without sorting its rows again."""
    from foliograph.plans import browse_queries

    monkeypatch.setattr(browse_queries, "TASK_LINES", 100)
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    found = browse_queries.QUERIES["catalogue_warnings"](spark, small)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-lines // 100)})" in plan and "Window" not in plan
    monkeypatch.setattr(browse_queries, "TASK_LINES", 1 << 20)
    assert sorted(map(str, found.collect())) == sorted(map(str, browse_queries.QUERIES["catalogue_warnings"](spark, small).collect()))
