from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliograph import api, errors
from foliograph.api import Gazette, Library
from foliograph.functions.text import fold, fold_text
from foliograph.sources import records

SITE = "https://bomemelilla.es"


def bulletin_page(cve, day, articles):
    """articles: (kind, number, summary)."""
    items = "".join(f"<li><h5>BOME-{k}-{cve.split('-')[2]}-{n}</h5><blockquote>{t}</blockquote></li>" for k, n, t in articles)
    return f'<section id="bome-show"><h1>BOME Nº 1 - {day}</h1><h2>{cve}</h2></section><section id="bome-show-content"><div class="bome-show-departamento"><h3><span>D</span></h3><div class="accordion-consejeria" id="c-38"><button class="accordion-button"><span>Hacienda</span></button><ul class="organismo-list"><li><h4>U</h4><ul class="articulo-list">{items}</ul></li></ul></div></div></section>'


def article_page(bulletin, cve, summary, text="", heading="D - Hacienda - U"):
    pages = f'<div class="paginas-sumario"><div class="pagina" id="pagina-3"><div class="pagina-texto"><p>{text}</p></div></div></div>' if text else ""
    return f'<section id="bome-show"><ol class="breadcrumb"><a href="/bome/{bulletin}">b</a></ol><h1>BOME Nº 1, 2 de enero de 2020</h1><h2>{cve}</h2></section><section id="bome-show-articulo-content"><h3>{heading}</h3><div class="intro-sumario">{summary}</div>{pages}</section>'


BULLETINS = {
    "BOME-B-2020-5": bulletin_page("BOME-B-2020-5", "3 de marzo de 2020", [("A", 7, "Bases de personal"), ("A", 9, "Subvención"), ("A", 10, "Orden")]),
    "BOME-B-2020-6": bulletin_page("BOME-B-2020-6", "6 de marzo de 2020", [("A", 11, "Personal eventual")]),
    "BOME-BX-2020-1": bulletin_page("BOME-BX-2020-1", "1 de abril de 2020", [("AX", 1, "x"), ("AX", 4, "y")]),
    "BOME-BX-2020-2": bulletin_page("BOME-BX-2020-2", "2 de abril de 2020", []),
    "BOME-BX-2020-3": bulletin_page("BOME-BX-2020-3", "3 de abril de 2020", [("AX", 9, "z")]),
    "BOME-B-2020-9": "<p>broken",
}
ARTICLES = [
    ("BOME-B-2020-5", "BOME-A-2020-7", "Bases de personal", "uno"), ("BOME-B-2020-5", "BOME-A-2020-8", "Personal oculto", "dos"), ("BOME-B-2020-5", "BOME-A-2020-9", "Subvención", ""),
    ("BOME-B-2020-5", "BOME-A-2020-10", "Orden", "tres"), ("BOME-B-2020-6", "BOME-A-2020-11", "Personal eventual", ""), ("BOME-BX-2020-1", "BOME-AX-2020-4", "y", "cuatro"), ("BOME-BX-2020-2", "BOME-AX-2020-6", "extra", "seis"), ("BOME-BX-2020-3", "BOME-AX-2020-9", "z", "nueve"),
]


@pytest.fixture(scope="module")
def library(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    bulletins = records.read_pages(make(list(BULLETINS.items()), "key string, page string"), records.bulletin_of, records.BULLETIN).cache()
    articles = records.read_pages(make([(c, article_page(b, c, t, x)) for b, c, t, x in ARTICLES], "key string, page string"), records.article_of, records.ARTICLE).cache()
    summary = '<section id="bome-show"><h1>BOME nº 5 de 3 de marzo de 2020</h1><h2>BOME-B-2020-5</h2></section><section id="bome-show-sumario-content"></section>'
    old_schema = "key long, page string"
    catalogue = '<a href="ficha_bome.jsp?dboidboletin=1">nº 5 / 03-01-2000</a><a href="ficha_bome.jsp?dboidboletin=2">nº 5 / 04-01-2000</a><a href="ficha_bome.jsp?dboidboletin=3">nº 6 / 05-01-2015</a>'
    ficha = '<div class="bandaNo"><div class="banda8">Nº 6</div><div class="banda9">5 de enero de 2015</div><div class="B2"><ul><li><span class="txBoN">Artículo:</span> 3</li><li><span class="txBoN">Boletín:</span><a href="ficha_bome.jsp?dboidboletin=3">nº 6 / 05-01-2015</a></li><li><span class="txBoN">Orden:</span> Bases Antiguas</li></ul></div></div>'
    fichas = make([(3, ficha)], old_schema)
    return Library(
        bulletins=bulletins, articles=articles, summaries=records.summaries(make([("x", summary)], "key string, page string")).cache(),
        redirects=make([("BOME-A-2020-7", "/bome/BOME-B-2020-5/articulo/7"), ("BOME-A-2020-8", "/bome/BOME-B-2020-5/articulo/9"), ("BOME-AX-2020-4", "/bome/BOME-B-2020-5/articulo/4"), ("BOME-P-2020-1", "/bome/BOME-B-2020-5/articulo/7"), ("BOME-SX-2020-1", "/bome/BOME-B-2020-5")], "cve string, target string"),
        sections=make([(1, 38, "Hacienda"), (1, 39, "Otra"), (2, 40, "X")], "parent int, id long, name string"),
        calendar=make([(c, int(c.split("-")[3]), date(2020, 3, 5), "BX" in c, f"{SITE}/bome/{c}", None) for c in BULLETINS], records.REF),
        catalogue=records.catalogue(records.catalogue_links(make([(1, catalogue)], old_schema), "utf-8")).cache(),
        old_bulletins=records.old_bulletins(fichas, encoding="utf-8").cache(), old_articles=records.old_results(fichas, encoding="utf-8").cache(),
        pdf_pages=make([("BOME-A-2020-9", 1, "del pdf", None), ("BOME-B-2020-5", 1, "a" * 1500, None), ("BOME-B-2020-5", 2, "b", None), ("https://www.melilla.es/mandar.php/n/1/2/a.pdf", 1, "viejo", None), ("BOME-P-2020-1", None, None, "UnreadablePdf: no")], "name string, page int, text string, error string"),
        pdf_files=make([("BOME-B-2020-5", 99, "ab")], "name string, size long, sha256 string"),
    )


@pytest.fixture(scope="module")
def gazette(library):
    return Gazette(library=library, clock=lambda: datetime(2020, 6, 1))


def test_errors_have_codes(capsys):
    @api.answered
    def fails(error):
        raise error

    kinds = [k for k in vars(errors).values() if isinstance(k, type) and issubclass(k, errors.GazetteError)]
    assert len({k.code for k in kinds if hasattr(k, "code")}) >= 13
    for error in (errors.InvalidTerms("x"), errors.NotFound("x", hint="h"), errors.Ambiguous("k", [1, 2]), errors.SiteClosed("x", 9.0, True), errors.TooLarge("x"), errors.OtherVersion("x")):
        told = fails(error)
        assert not told["ok"] and told["error_code"] == error.code and told["error"]
    assert fails(errors.Ambiguous("k", [1, 2]))["candidates"] == [1, 2] and fails(errors.SiteClosed("x", 9.0, False))["retry_after_seconds"] == 9.0
    assert fails(RuntimeError("secret")) == {"ok": False, "error": "an internal error; its details are in the log", "error_code": "internal_error"} and "secret" in capsys.readouterr().err
    assert fails()["error_code"] == "invalid_request"


@pytest.mark.parametrize("value, want", [("2020-02-03", date(2020, 2, 3)), (" 03/02/2020 ", date(2020, 2, 3)), ("", None), (None, None), (date(2020, 1, 1), date(2020, 1, 1))])
def test_days(value, want):
    assert api.day(value, "since") == want
    with pytest.raises(errors.InvalidRequest):
        api.day("2020/1/1", "since")


def test_bulletins_and_hidden_articles(gazette):
    got = gazette.bulletin("bome-b-2020-5", hidden=True)
    assert got["ok"] and got["total_articles"] == 3 and [h["cve"] for h in got["hidden"]] == ["BOME-A-2020-8"] and got["errors"] == []
    extra = gazette.bulletin("BOME-BX-2020-1", hidden=True)
    assert extra["hidden"] == [] and [e["number"] for e in extra["errors"]] == [2, 3]
    assert gazette.bulletin("BOME-B-2015-1")["hint"] == "old_bulletin(cve='BOME-B-2015-1')" and gazette.bulletin("BOME-B-2015-1")["error_code"] == "not_found"
    assert gazette.bulletin("x")["error_code"] == "invalid_identifier" and gazette.bulletin("BOME-A-2020-1")["error_code"] == "invalid_identifier"
    assert gazette.summary("BOME-S-2020-5")["warning"] and gazette.summary("BOME-B-2020-6")["error_code"] == "not_found"


def test_articles_are_located(gazette):
    assert gazette.locate_article("BOME-A-2020-7")["bulletin"] == "BOME-B-2020-5"
    assert gazette.locate_article("BOME-B-2020-5", 10)["cve"] == "BOME-A-2020-10"
    wrong = gazette.locate_article("BOME-A-2020-8")
    assert wrong["error_code"] == "not_found" and "shows BOME-A-2020-9" in wrong["error"]
    assert gazette.locate_article("BOME-AX-2020-4")["bulletin"] == "BOME-BX-2020-1"  # by its range; the resolver names an ordinary one
    assert gazette.locate_article("BOME-AX-2020-6")["bulletin"] == "BOME-BX-2020-2"  # between the neighbours, lists nothing
    lost = gazette.locate_article("BOME-AX-2020-7")
    assert lost["error_code"] == "not_found" and lost["tried"] == ["BOME-BX-2020-2", "BOME-BX-2020-1"] and lost["untried"] == 1
    for bad in (("BOME-B-2020-5",), ("BOME-B-2020-5", 0), ("BOME-A-2020-7", 7), ("BOME-S-2020-5",)):
        assert gazette.locate_article(*bad)["error_code"] == "invalid_request"
    assert gazette.resolve("BOME-P-2020-1")["url"] == f"{SITE}/bome/BOME-B-2020-5/articulo/7" and gazette.resolve("BOME-AX-2020-9")["url"].endswith("BOME-BX-2020-3/articulo/9")
    assert gazette.resolve("BOME-PX-2020-1")["warning"] and gazette.resolve("BOME-SX-2020-1")["error_code"] == "not_found" and gazette.resolve("BOME-B-2020-99")["error_code"] == "not_found"


def test_reading(gazette):
    assert (gazette.read_article("BOME-A-2020-7")["pages"][0]["text"], gazette.read_article("BOME-A-2020-7")["source"]) == ("uno", "html")
    assert gazette.read_article("BOME-B-2020-5", 9)["source"] == "pdf" and gazette.read_article("BOME-B-2020-6", 11)["source"] == "none"
    whole = gazette.read_bulletin("BOME-B-2020-5", budget=1000)
    assert whole["next"] == {"page": 1, "at": 1000} and whole["pages"][0]["cut"] and whole["total_articles"] == 3
    assert gazette.read_bulletin("BOME-B-2020-5", page=1, at=1000)["next"] is None and gazette.read_bulletin("BOME-B-2020-6")["source"] == "none"
    assert gazette.read_bulletin("BOME-A-2020-7")["error_code"] == "invalid_request" and gazette.read_bulletin("BOME-B-2020-5", page=7)["error_code"] == "invalid_cursor" and gazette.read_bulletin("BOME-B-2020-5", page="1")["error_code"] == "invalid_request"
    assert gazette.read_pdf(url="http://www.melilla.es/mandar.php/n/1/2/a.pdf")["pages"][0]["text"] == "viejo"
    assert gazette.read_pdf(url="https://evil.example/a.pdf")["error_code"] == "invalid_address" and gazette.read_pdf()["error_code"] == "invalid_request" and gazette.read_pdf(cve="BOME-P-2020-1")["error_code"] == "unreadable_page"
    assert gazette.download_pdf("BOME-B-2020-5") == {"ok": True, "name": "BOME-B-2020-5", "size": 99, "sha256": "ab", "pages": 2} and gazette.download_pdf("BOME-B-2020-6")["error_code"] == "not_found"


def test_listings(gazette, library):
    got = gazette.list_bulletins("2000-01-01", "31/12/2020")
    assert got["total"] == 9 and not got["truncated"] and got["bulletins"][0]["origin"] == "new" and {b["record"] for b in got["bulletins"] if b["origin"] == "old"} == {1, 2, 3}
    assert gazette.list_bulletins()["total"] == 0 and gazette.list_bulletins("2020-02-02", "2020-01-01")["error_code"] == "invalid_request" and gazette.list_bulletins("x")["error_code"] == "invalid_request"
    alone = Gazette(library=Library(calendar=library.calendar)).list_bulletins("2020-01-01", "2020-12-31")
    assert alone["degraded"] and alone["warning"] and alone["total"] == 6
    assert gazette.sections(1)["sections"] == [{"id": 38, "name": "Hacienda"}, {"id": 39, "name": "Otra"}] and gazette.sections(0)["error_code"] == "invalid_request" and gazette.units(38)["error_code"] == "not_found"


def test_searches_of_the_site(gazette):
    got = gazette.search_articles([{"text": "personal"}])
    assert [a["cve"] for a in got["articles"]] == ["BOME-A-2020-11", "BOME-A-2020-7", "BOME-A-2020-8"] and got["total_bulletins"] == 2 and got["total_exact"] and got["errors"][0]["bulletin"] == "BOME-B-2020-9"
    both = gazette.search_articles([{"text": "bases"}, {"text": "personal", "operator": "or"}])
    assert len(both["articles"]) == 3 and both["total_bulletins"] == 3 and not both["total_exact"] and both["distinct_bulletins"] == 2 and len(both["parameters"]) == 2
    assert [a["cve"] for a in gazette.search_articles([{"text": "personal"}], section=38, max_articles=1)["articles"]] == ["BOME-A-2020-11"]
    assert gazette.search_articles([{"text": "personal"}], max_articles=1)["reason"] == "max_articulos"
    for bad in ({}, {"terms": ["a"], "max_bulletins": 0}, {"terms": ["a"], "since": "2021-01-01", "until": "2020-01-01"}):
        assert gazette.search_articles(**bad)["error_code"] == "invalid_request"
    found = gazette.search_bulletins([{"text": "dos", "scope": "content"}])
    assert [b["bulletin"] for b in found["bulletins"]] == ["BOME-B-2020-5"] and found["total_pages"] == 1 and ("contenido[0][type]", "content") in found["parameters"]
    assert [b["bulletin"] for b in gazette.search_bulletins(since="2020-03-01", until="2020-03-31")["bulletins"]] == ["BOME-B-2020-6", "BOME-B-2020-5"]
    assert gazette.search_bulletins(["personal"], number=11)["total"] == 1 and gazette.search_bulletins(bulletin_number=5)["total"] == 1 and gazette.search_bulletins(["personal"], section=99)["total"] == 0
    assert gazette.search_bulletins([{"text": "a"}, {"text": "b", "operator": "or"}])["error_code"] == "invalid_search" and gazette.search_bulletins(["a"], page=0)["error_code"] == "invalid_search" and gazette.search_bulletins(["a"], scope="x")["error_code"] == "invalid_search" and gazette.search_bulletins()["error_code"] == "invalid_request"


def test_the_old_portal(gazette):
    got = gazette.search_old("  bases   antiguas ")
    assert (got["text"], got["total"], got["articles"][0]["cve"], got["articles"][0]["number"]) == ("bases antiguas", 1, "BOME-B-2015-6", 3)
    assert gazette.search_old("bases", since="2016-01-01") | {"warning": 0} == {"ok": True, "text": "bases", "total": 0, "total_unfiltered": 1, "truncated": False, "articles": [], "warning": 0}
    assert {gazette.search_old(*a)["error_code"] for a in (("ab",), (3,), ("abc", "x"), ("abc", None, None, 0))} == {"invalid_search"}
    assert gazette.old_bulletin(cve="BOME-B-2015-6")["total_articles"] == 1 and "warning" not in gazette.old_bulletin(record=3)
    assert gazette.old_bulletin(cve="BOME-B-2000-5")["candidates"] == [1, 2] and gazette.old_bulletin(cve="BOME-B-2000-5")["error_code"] == "ambiguous"
    assert gazette.old_bulletin()["error_code"] == "invalid_request" and gazette.old_bulletin(record=0)["error_code"] == "invalid_request" and gazette.old_bulletin(record=99)["error_code"] == "not_found" and gazette.old_bulletin(cve="BOME-B-1999-1")["error_code"] == "not_found"


def test_a_shut_site_is_not_asked(spark, library):
    now = datetime(2020, 6, 1, 12)
    log = lambda *rows: spark.createDataFrame([("s", now - timedelta(seconds=ago), k, status, None) for k, (ago, status) in enumerate(rows)], "site string, ts timestamp, seq long, status int, retry_after double")
    shut = lambda outcomes: Gazette(library=Library(bulletins=library.bulletins, articles=library.articles, outcomes=outcomes), clock=lambda: now)
    blocked = shut(log((100, 403))).search_articles(["personal"])
    assert blocked["error_code"] == "site_blocked" and blocked["retry_after_seconds"] == 4400.0
    full = shut(log((500, 500), (300, 404), (100, 500))).search_bulletins(["personal"])
    assert full["error_code"] == "preventive_pause" and full["retry_after_seconds"] == 100.0
    assert shut(log((700, 500), (300, 404), (100, 500))).search_articles(["personal"])["ok"]
    assert shut(log((100, 403))).server_status()["guard"]["cause"] == "HTTP 403"


def test_no_index_yet(gazette):
    assert gazette.search(["x"])["error_code"] == "index_unavailable" and gazette.status() == {"ok": True, "exists": False, "status": None, "warning": "there is no index yet"}
    assert gazette.search([""])["error_code"] == "invalid_terms" and gazette.search(limit=0)["error_code"] == "invalid_search" and gazette.search(nothing=1)["error_code"] == "invalid_request"
    assert gazette.cancel()["state"] == "inactivo" and gazette.server_status()["folders"]["pdf"]["path"] and gazette.server_status()["ok"]


def test_index_shortcut(spark, library):
    articles = spark.createDataFrame([(1, 2, "BOME-AX-2020-6")], "id long, bulletin long, cve string")
    bulletins = spark.createDataFrame([(2, "BOME-BX-2020-2", "new")], "bulletin long, cve string, origin string")
    assert Gazette(articles, bulletins, library=library, max_errors=2).locate_article("BOME-AX-2020-6")["bulletin"] == "BOME-BX-2020-2"


def test_old_rows_have_no_bulletin_of_the_new_site(spark):
    articles = spark.createDataFrame([(1, 10, "a", "n", "s", "a")], "id long, bulletin long, summary string, norm string, section string, section_norm string")
    bulletins = spark.createDataFrame([(10, "old")], "bulletin long, origin string")
    assert Gazette(articles, bulletins).bulletin_of_article(1) == {"ok": True, "bulletin": None}


def test_sql_functions(spark):
    api.register_functions(spark)
    row = spark.sql(r"select phrase_count('cecece', 'cec'), word_start('amigo migo', 'migo'), word_start('amigo', 'migo'), word_start('a\\Eb', '\\Eb'), parse_cve(' bome-bx-2020-007 '), parse_cve('BOME-ZZ-2020-1'), normalize('CAMIÓN  ﬁn'), highlight('El CAMIÓN', array('camion'), false), html_to_text('<p>a<p>b')").first()
    assert list(row[:4]) == [2, True, False, False] and tuple(row[4]) == ("BX", 2020, 7) and row[5] is None and list(row[6:]) == ["camion fin", "El **CAMIÓN**", "a\nb"]
    got = spark.sql("select * from chunks(array('abc', 'd', ''), 3)").collect()
    assert [(r["chunk"], r["page"], r["start"], r["text"], r["cut"]) for r in got] == [(1, 1, 0, "abc", False), (2, 2, 0, "d", False), (2, 3, 0, "", False)]
    plan = spark.sql("select phrase_count(cast(id as string), '1') as n, word_start(cast(id as string), '1') as w from range(3)")._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert spark.createDataFrame([("ñ",)], "t string").select(fold(F.col("t"))).first()[0] == fold_text("ñ")


def test_chunks_over_a_table(spark):
    """One document after another, as the same pages in an array and all at once."""
    from foliograph.api import register_functions
    from foliograph.operators.paging import all_chunks

    register_functions(spark)
    pages = spark.createDataFrame([("a", 1, "x" * 7), ("a", 2, ""), ("a", 3, "y" * 25), ("b", 1, None), ("b", 2, "zz"), ("a", 4, "w" * 4)], "doc string, page int, text string")
    rows = spark.sql("SELECT * FROM chunks(TABLE({pages}) PARTITION BY doc ORDER BY page, budget => 10)", pages=pages).collect()
    assert rows[0].asDict().keys() == {"doc", "chunk", "page", "start", "taken", "text"}
    want = all_chunks(pages.selectExpr("doc", "page", "length(text) as length"), budget=10).collect()
    assert sorted((r["doc"], r["chunk"], r["page"], r["start"], r["taken"]) for r in rows) == sorted(map(tuple, want))
    assert "".join(r["text"] for r in sorted(rows, key=lambda r: (r["doc"], r["page"], r["start"]))) == "x" * 7 + "y" * 25 + "w" * 4 + "zz"
    assert spark.sql("SELECT chunk, text FROM chunks(array('abc', 'defgh'), 4)").count() == 3
    with pytest.raises(Exception, match="doc, page"):
        spark.sql("SELECT * FROM chunks(TABLE({pages}), budget => 10)", pages=pages.drop("doc")).collect()
