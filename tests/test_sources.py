import zlib
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliograph.sources import files, recorded, records
from foliograph.sources.pdf import page_texts
from foliograph.sources.tree import parse, plain_text

BULLETIN = """<html><body><section id="bome-show"><h1>BOME Nº 41 - martes, 3 de marzo de 2020</h1><h2>CVE: BOME-BX-2020-41</h2>
<div class="bome-show-actions"><a href="/bome/BOME-BX-2020-41/sumario">s</a><a data-bome-tipo="Sumario" href="/d/BOME-SX-2020-41.pdf">pdf</a></div></section>
<section id="bome-show-content"><div class="bome-show-departamento"><h3><span>Gobierno</span><span title="Número de artículos">2</span></h3>
<div class="accordion-consejeria" id="consejeria-38"><button class="accordion-button"><span>Hacienda</span><span title="Número de páginas">7 páginas</span></button>
<ul class="organismo-list"><li><h4>Tesorería</h4><ul class="articulo-list"><li><h5>BOME-AX-2020-7</h5><blockquote>Bases  de
ayudas</blockquote><a data-bome-tipo="Articulo" href="x.pdf">p</a></li><li><h5>sin</h5></li><li><h5>BOME-AX-2020-9</h5></li></ul></ul></div></div></section>"""
ARTICLE = """<section id="bome-show"><ol class="breadcrumb"><li><a href="/bome/BOME-B-2014-5092">b</a></ol><h1>BOME Nº 5092, 2 de enero de 2014</h1><h2>BOME-A-2014-3</h2></section>
<section id="bome-show-articulo-content"><h3>A - B - C</h3><div class="intro-sumario">Un sumario</div><div class="paginas-sumario"><div class="pagina" id="pagina-12"><div class="pagina-titulo"><a data-bome-tipo="Pagina" data-bome-name="BOME-P-2014-12" href="/p.pdf">12</a></div><div class="pagina-texto"><p>uno<br>dos</p><table><tr><td>a</td><td> b </td></tr></table></div></div></div></section>"""
SUMMARY = """<section id="bome-show"><h1>BOME nº 6 de 1 de mayo de 2021</h1><h2>BOME-B-2021-6</h2></section><section id="bome-show-sumario-content">
<div class="sumario-departamento"><h2>D1</h2><h3 class="sumario-consejeria">C1</h3><div class="sumario-articulo" data-numero="4"><div class="sumario-articulo__content">4. Texto</div><div class="sumario-articulo__pagina">Pág. 33</div></div></div>
<div class="sumario-departamento"><h2>D2</h2><div class="sumario-articulo" data-numero="5"><div class="sumario-articulo__content">Otro</div></div></div></section>"""
RESULTS = """<div class="page-search-result"><a href="/bome/BOME-B-2020-1">BOME Nº 1 - 7 de enero de 2020</a><a href="/x">x</a><p>Página 1 de 2. Mostrando 1 elemento de un total de 1.934 elementos.</p></div>"""
CATALOGUE = """<div class="set"><div class="title"><img src="/i/2020.jpg"></div><a href="ficha_bome.jsp?dboidboletin=1">nº 5 / 03-01-2020</a><a href="ficha_bome.jsp?dboidboletin=1">nº 5 / 03-01-2020</a>
<a href="ficha_bome.jsp?dboidboletin=2">nº Extra2 / 03-01-2019</a><a href="ficha_bome.jsp?dboidboletin=3">?</a><a href="ficha_bome.jsp?dboidboletin=1">nº 6 / 03-01-2020</a><a href="ficha_bome.jsp?dboidboletin=9"><img src="u.png"></a></div>"""
FICHA = """<div class="bandaNo"><div class="banda8">BOLETÍN Nº 5302</div><div class="banda9">Número 5302 - viernes, 8 de enero de 2016 <a href="http://www.melilla.es/mandar.php/n/1/2/b.pdf">p</a></div>
<div class="bandabome">Ciudad</div><div class="bandanegociado">Economía</div><div class="bandanegociado">Empleo</div><div class="B2"><ul><li><span class="txBoN">Artículo:</span> 12</li><li><span class="txBoN">Orden:</span> : bases</li><li><span class="txBoN">Páginas:</span><a href="http://www.melilla.es/mandar.php/n/1/2/b_7.pdf">ver</a></li></ul><ul><li><span class="txBoN">Decreto:</span> otro</li></ul></div></div>"""


def test_bulletin_tree(spark):
    pages = spark.createDataFrame([(1, BULLETIN), (2, "<p>no</p>"), (3, None)], "key long, page string")
    read = records.read_pages(pages, records.bulletin_of, records.BULLETIN).cache()
    assert {r["key"]: r["error"] is None for r in read.collect()} == {1: True, 2: False, 3: False}
    row = read.where("key = 1").first()
    assert (row["cve"], row["date"], row["extraordinary"], row["summary_url"]) == ("BOME-BX-2020-41", date(2020, 3, 3), True, "https://bomemelilla.es/bome/BOME-BX-2020-41/sumario")
    flat = records.articles_of_bulletins(read).orderBy("pos").collect()
    assert [(r["number"], r["department"], r["section"], r["section_id"], r["unit"], r["summary"]) for r in flat] == [(7, "Gobierno", "Hacienda", 38, "Tesorería", "Bases de ayudas"), (9, "Gobierno", "Hacienda", 38, "Tesorería", None)]


def test_article_summary_results():
    a = records.article_of(ARTICLE)
    assert (a["cve"], a["bulletin_cve"], a["bulletin_number"], a["heading"], a["summary"], a["text"]) == ("BOME-A-2014-3", "BOME-B-2014-5092", 5092, "A - B - C", "Un sumario", "uno\ndos\na | b")
    assert a["pages"][0]["cve"] == "BOME-P-2014-12"
    assert records.printed_pages(parse('<div class="pagina" id="pagina-x"></div><div class="pagina" id="other"></div><div class="pagina" id="pagina-3"></div>'), "") == [{"number": 3, "cve": None, "pdf_url": None, "text": ""}]


def test_summaries(spark):
    free = SUMMARY[: SUMMARY.index("<section id=\"bome-show-sumario-content\">")] + "<p>free text</p>"
    later = SUMMARY.replace('<div class="sumario-articulo" data-numero="5">', '<div class="sumario-articulo" data-numero="x"></div><div class="pagina" id="pagina-9"></div><div class="sumario-articulo" data-numero="5">')
    rows = {r["key"]: r for r in records.summaries(spark.createDataFrame([(1, SUMMARY), (2, free), (3, "<p>no</p>"), (4, later)], "key long, page string")).collect()}
    for k in (1, 4):
        assert [(e["department"], e["section"], e["article"]["cve"], e["article"]["summary"], e["article"]["first_page"]) for e in rows[k]["entries"]] == [("D1", "C1", "BOME-A-2021-4", "Texto", 33), ("D2", None, "BOME-A-2021-5", "Otro", None)]
    assert (rows[1]["bulletin_cve"], rows[1]["cve"], rows[1]["bulletin_number"], rows[1]["date"], rows[1]["warning"], rows[1]["error"]) == ("BOME-B-2021-6", "BOME-S-2021-6", 6, date(2021, 5, 1), None, None)
    assert rows[4]["pages"] == [9] and rows[2]["entries"] == [] and rows[2]["warning"] and rows[3]["error"] and rows[3]["entries"] is None


def test_results_and_years(spark):
    r = {r["key"]: r for r in records.results(spark.createDataFrame([(1, RESULTS), (2, "<p>")], "key long, page string")).collect()}
    assert (len(r[1]["results"]), r[1]["page"], r[1]["total_pages"], r[1]["total_results"]) == (1, 1, 2, 1934) and r[1]["results"][0]["date"] == date(2020, 1, 7)
    assert (r[2]["results"], r[2]["page"], r[2]["total_pages"], r[2]["total_results"]) == ([], 1, 0, 0)
    slides = spark.createDataFrame([(1, '<a href="/bome/BOME-B-1-1">no</a><div class="swiper-slide"><a href="/bome/BOME-B-2005-1">1 de enero de 2005</a></div>')], "key long, page string")
    assert [(x["cve"], x["date"]) for x in records.years(slides).collect()] == [("BOME-B-2005-1", date(2005, 1, 1))]


def test_old_portal(spark):
    links = records.catalogue_links(spark.createDataFrame([(1, CATALOGUE), (2, "<p>")], "key long, page string"), "utf-8")
    rows = records.catalogue(links).orderBy("record").collect()
    assert [(r["record"], r["cve"], r["official"]) for r in rows] == [(1, "BOME-B-2020-5", True), (2, "BOME-BX-2019-2", True)]
    assert rows[0]["url"].endswith("contenedor.jsp?seccion=ficha_bome.jsp&dboidboletin=1&codResi=1&language=es&codAdirecto=15")
    assert {(w["kind"], w["record"], w["year"]) for w in records.catalogue_warnings(links).collect()} == {("conflict", 1, None), ("unreadable", 3, None), ("unreadable", 9, None), ("misfiled", None, 2020)}
    two = FICHA.replace("</div></div>", '</div><div class="bandabome">Otra</div><div class="B2"><ul><li><span class="txBoN">Bolet\u00edn:</span><a href="ficha_bome.jsp?dboidboletin=77">n\u00ba 9 / 02-01-2001</a></li></ul></div></div>')
    latin = spark.createDataFrame([(5, bytearray(two.encode("latin-1"))), (6, bytearray(b"<p>"))], "key long, page binary")
    got = {r["record"]: r for r in records.old_bulletins(latin).collect()}
    row = got[5]
    assert (row["cve"], row["pdf_url"], row["error"], row["date"]) == ("BOME-B-2016-5302", "https://www.melilla.es/mandar.php/n/1/2/b.pdf", None, date(2016, 1, 8)) and got[6]["error"]
    assert [(a["number"], a["kind"], a["summary"], a["path"], [p["number"] for p in a["pages"]]) for a in row["articles"]] == [(12, "Orden", "bases", ["Ciudad", "Economía", "Empleo"], [7]), (None, "Decreto", "otro", ["Ciudad", "Economía", "Empleo"], []), (None, None, None, ["Otra"], [])]
    known = spark.createDataFrame([(5, "BOME-BX-2016-1", 1, True, "1 bis", date(2016, 1, 9))], "record long, cve string, number long, extraordinary boolean, suffix string, date date")
    assert records.old_bulletins(latin, known).where("record = 5").first()["suffix"] == "1 bis"
    hits = records.old_results(latin).collect()
    assert [(h["place"], h["cve"], h["date"], h["record"]) for h in hits if h["record"]] == [(3, "BOME-B-2001-9", date(2001, 1, 2), 77)] and hits[0]["url"] is None
    empty = spark.createDataFrame([(1, '<div class="bandaNo"></div>')], "key long, page string")
    assert records.old_results(empty).collect() == [] and records.old_bulletins(empty).first()["error"]


def test_json(spark):
    df = spark.createDataFrame([('[{"title":" BOME ","start":"2020-01-02T00","url":"/bome/BOME-B-2020-007"},{"url":"/x"},{"start":"bad","url":"https://h/bome/bome-bx-2020-3/"}]',), ], "json string")
    both = df.unionByName(spark.createDataFrame([("{}",)], "json string"))
    got = {(r["cve"], r["date"], r["extraordinary"], r["title"]) for r in records.calendar(df).collect()}
    assert got == {("BOME-B-2020-7", date(2020, 1, 2), False, "BOME"), ("BOME-BX-2020-3", None, True, None)}
    assert records.not_arrays(both).count() == 1
    with pytest.raises(Exception, match="isn't an array"):
        records.calendar(both).collect()
    assert [tuple(r) for r in records.entities(spark.createDataFrame([('[{"id":"91","nombre":" a  b "}]',)], "json string")).collect()] == [(91, "a b")]
    with pytest.raises(Exception, match="numeric id"):
        records.entities(spark.createDataFrame([('[{"nombre":"x"}]',)], "json string")).collect()


def test_resolver(spark):
    redirects = spark.createDataFrame([("BOME-A-2020-1", "https://h/bome/BOME-B-2020-9/articulo/1"), ("BOME-AX-2020-2", "/bome/BOME-B-2020-9")], "cve string, target string")
    asked = spark.createDataFrame([("BOME-A-2020-1",), ("BOME-AX-2020-2",), ("BOME-A-2020-3",)], "cve string")
    assert {r["cve"]: r["agrees"] for r in records.resolved(redirects, asked).collect()} == {"BOME-A-2020-1": True, "BOME-AX-2020-2": False, "BOME-A-2020-3": None}


def test_plain_text():
    assert plain_text(parse("<div>a<script>x</script><p>b<!-- c -->d</p>e<br>f<ul><li>g<li>h</ul></div>")) == "a\nbd\ne\nf\ng\nh"


def test_recorded_responses(spark, tmp_path):
    rows = [("https://s.es/a", 200, None, datetime(2026, 1, 1), None, "ñ"), ("https://s.es/a", 503, "9", datetime(2026, 1, 2), None, None), ("https://s.es/buscar-cve?cve=bome-a-2020-1", 302, None, datetime(2026, 1, 1), "/bome/BOME-B-2020-9/articulo/1", None)]
    recorded.record(spark.createDataFrame(rows, recorded.SCHEMA), f"{tmp_path}/r")
    found = recorded.responses(spark, f"{tmp_path}/r")
    assert {(r["url"][-3:], r["kind"], r["retry_after_seconds"]) for r in found.collect()} == {("s/a", "ok", None), ("s/a", "blocked", 9.0), ("0-1", "ok", None)}
    assert {r["url"]: r["status"] for r in recorded.latest(found).collect()}["https://s.es/a"] == 503
    assert [tuple(r) for r in recorded.redirects(found).collect()] == [("BOME-A-2020-1", "/bome/BOME-B-2020-9/articulo/1")]
    assert {r["site"] for r in recorded.outcomes(found).collect()} == {"s.es"}


def pdf(*pages, packed=True):
    """A PDF with the content streams of its pages, one font with a ToUnicode table for codes 1 to 3."""
    cmap = b"1 beginbfchar <01> <00F1> endbfchar 1 beginbfrange <02> <03> <0041> endbfrange"
    stream = lambda data, more=b"": b"<< /Length %d %s%s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if packed else b"", more, zlib.compress(data) if packed else data)
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (kids, len(pages)), 3: b"<< /Type /Font /Subtype /Type1 >>", 4: b"<< /Type /Font /ToUnicode 5 0 R >>", 5: stream(cmap)}
    for k, content in enumerate(pages):
        objects |= {10 + 2 * k: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k), 11 + 2 * k: stream(content)}
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, body) for n, body in objects.items()) + b"\ntrailer << /Root 1 0 R >>"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_text(packed):
    first = rb"BT /F1 12 Tf 72 700 Td (Hola \(mundo\) \361) Tj 0 -14 Td [(se) -300 (gun) 20 (da)] TJ T* <6c69> Tj ET"
    assert page_texts(pdf(first, b"", rb"BT /F2 9 Tf (\001\002\003) Tj ET", packed=packed)) == ["Hola (mundo) ñ\nse gunda\nli", "", "ñAB"]


def test_pdf_pages(spark, tmp_path):
    for name, data in (("a", pdf(b"BT (uno) Tj ET", b"BT (dos) Tj ET")), ("b", b"<html>"), ("c", b"%PDF-1.4 nothing"), ("d", pdf(b"x") + b"/Encrypt")):
        (tmp_path / f"{name}.pdf").write_bytes(data)
    got = sorted((r["path"][-5], r["page"], r["text"], (r["error"] or "")[:13]) for r in files.pdf_pages(files.pdf_files(spark, str(tmp_path))).collect())
    assert [g[:3] for g in got[:2]] == [("a", 1, "uno"), ("a", 2, "dos")] and [(g[0], g[3]) for g in got[2:]] == [("b", "not_pdf"), ("c", "UnreadablePdf"), ("d", "UnreadablePdf")]


def test_stored_files(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(n, bytearray(c)) for n, c in r], "name string, content binary")
    say = lambda df: {r["name"]: (r["size"], r["reused"]) for r in df.collect()}
    assert say(files.write_files(rows(("a", b"xx")), str(tmp_path))) == {"a": (2, False)}
    assert say(files.write_files(rows(("a", b"yyy"), ("b", b"z")), str(tmp_path))) == {"a": (2, True), "b": (1, False)}
    assert say(files.write_files(rows(("a", b"yyy")), str(tmp_path), refresh=True)) == {"a": (3, False)}
    assert files.stored_files(spark, str(tmp_path)).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "pdf/b.pdf").write_bytes(b"<html>")
    got = {r["path"].rsplit("/", 1)[1]: (r["error"], r["size"]) for r in files.pdf_files(spark, f"{tmp_path}/pdf").collect()}
    assert got == {"a.pdf": (None, 10), "b.pdf": ("not_pdf", 6)}
    assert {r["error"] for r in files.pdf_files(spark, f"{tmp_path}/pdf", most=8).collect()} == {"too_large", "not_pdf"}
    first = files.store_pdf(tmp_path / "cache", "x.pdf", b"%PDF-1")
    again = files.store_pdf(tmp_path / "cache", "x.pdf", b"%PDF-2")
    assert not first["reused"] and again["reused"] and again["sha256"] == first["sha256"]
    assert files.store_pdf(tmp_path / "cache", "x.pdf", b"%PDF-2", refresh=True)["sha256"] != first["sha256"]
    with pytest.raises(files.BadDownload):
        files.store_pdf(tmp_path / "cache", "y.pdf", b"html")


def test_snapshots(spark, tmp_path):
    folder = f"{tmp_path}/snap"
    files.write_snapshot(spark.range(3), folder)
    files.write_snapshot(spark.range(5), folder)
    assert files.read_snapshot(spark, folder).count() == 5
    files.migrate_snapshot(spark, folder, lambda df: df.withColumn("origin", F.lit("new")), 1, 2)
    assert files.read_snapshot(spark, folder, 2).columns == ["id", "origin"]
    with pytest.raises(ValueError):
        files.read_snapshot(spark, folder, 1)
    assert files.data_folder({"FOLIOGRAPH_HOME": "/x"}) == (Path("/x"), "FOLIOGRAPH_HOME") and files.data_folder({"XDG_DATA_HOME": "/y"})[0] == Path("/y/foliograph")
    assert files.folder_of("pdf", {"FOLIOGRAPH_PDF_DIR": "/p"}) == (Path("/p"), "FOLIOGRAPH_PDF_DIR") and files.folder_of("index", {"FOLIOGRAPH_HOME": "/x"}) == (Path("/x/index"), "FOLIOGRAPH_HOME")


def test_recordings_as_a_format(spark, tmp_path):
    """Read by the format's name: all at once as Spark's reader does, and as a stream that goes on at its offset, each row once."""
    path, out = f"{tmp_path}/recording", f"{tmp_path}/out"
    recorded.register_format(spark)

    def fetched(first, last):
        rows = [(f"https://s.es/{k}", 200 if k % 3 else None, None, datetime(2024, 1, 1, 0, 0, k % 60), "ñ" if k % 2 else None, 'line\nof "text"' * (k % 4)) for k in range(first, last)]
        recorded.record(spark.createDataFrame(rows, recorded.SCHEMA).repartition(3), path)

    def stream(**options):
        rows = spark.readStream.format("recordings").options(**options).load(path)
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check{len(options)}").trigger(availableNow=True).start(f"{out}{len(options)}")
        assert query.awaitTermination(90)
        return sorted(spark.read.parquet(f"{out}{len(options)}").collect(), key=str)

    def whole():
        return sorted(spark.read.schema(recorded.SCHEMA).json(path).collect(), key=str)

    fetched(0, 40)
    assert sorted(spark.read.format("recordings").load(path).collect(), key=str) == whole()
    assert stream() == whole() and len(whole()) == 40
    fetched(40, 70)
    fetched(10, 12)  # rows alike are rows of their own
    assert stream() == whole() and len(whole()) == 72
    assert stream() == whole()
    assert stream(notes="_others") == whole()
    assert sorted(recorded.RecordedArrivals(path, "_notes").latestOffset().items()) == [("note", 2)]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert spark.read.format("recordings").load(str(empty)).count() == 0
    (empty / "a.json").write_text('no object\n\n{"url": "https://s.es/1", "more": 1}\n')
    assert sorted(map(tuple, spark.read.format("recordings").load(str(empty)).collect()), key=str) == [("https://s.es/1", *[None] * 5), (None,) * 6]


def test_plain_pages_are_read_as_by_the_tokenizer():
    from foliograph.sources import tree

    def dump(e):
        return e.tag, e.attrs, [c if isinstance(c, str) else dump(c) for c in e.children]

    for page in (BULLETIN, ARTICLE, SUMMARY, RESULTS, FICHA, "<ul><li>a &amp; b<li>c</ul><script>x &amp; y</script>tail"):
        builder = tree._Builder()
        builder.feed(page)
        builder.close()
        assert dump(tree._parse_plain(page)) == dump(builder.tree.root)
    for odd in ("<!-- c -->a", "<p/>", "a < b", "<a href='x'>", "<script>a<b></script>", "<textarea>", "<a href=\"x&amp;y\">"):
        assert tree._parse_plain(odd) is None


def test_a_block_is_looked_through_once(monkeypatch):
    from foliograph.sources.tree import Element

    looked, own = [], Element.all
    monkeypatch.setattr(Element, "all", lambda self, *a, **k: looked.append(self) or own(self, *a, **k))
    links = "".join(f'<a href="ficha_bome.jsp?dboidboletin={k}">nº {k}</a>' for k in range(50))
    found = list(records.catalogue_rule(parse(f'<div class="set"><div class="title"><img src="/i/2001.jpg"></div>{links}</div>')))
    assert {f[2]["picture"] for f in found} == {"/i/2001.jpg"} and len(looked) == 3


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_payload_is_hashed_before_its_events(spark):
    plan = _plan(records.whole_calendar(spark.createDataFrame([("[]",)], "json string")))
    assert plan.index("Generate") < plan.index("xxhash64")


def test_pages_are_read_once(spark):
    pages = spark.createDataFrame([(1, FICHA), (2, "<p>")], "key long, page string")
    for found in (records.old_bulletins(pages, encoding="utf-8"), records.old_results(pages, encoding="utf-8"), records.summaries(pages), records.results(pages)):
        assert "MapIn" not in _plan(found)


def test_pages_of_links_are_bounded(spark, small, monkeypatch):
    """However many orders a month or year has, a page holds the links of a block of numbers; months and years say the same."""
    from foliograph.plans import page_queries as pq

    rows = lambda name: sorted(map(str, pq.QUERIES[name](spark, small).collect()))
    whole = {name: rows(name) for name in ("results_pages", "year_pages")}
    monkeypatch.setattr(pq, "PAGE_NUMBERS", 64)
    links = pq._links(spark, small).collect()
    assert max(r["links"].count("<a ") for r in links) <= 64 and len(links) > len({r["month"] for r in links})
    assert {name: rows(name) for name in whole} == whole


def test_pages_of_one_shape_are_parsed_once(monkeypatch):
    from foliograph.sources import tree

    parsed, own = [], tree.parse
    monkeypatch.setattr(tree, "parse", lambda page: parsed.append(page) or own(page))
    shapes = {rule: tree.Shapes(rule) for rule in (records.old_rule, records.summary_rule)}
    for rule, page in ((records.old_rule, FICHA), (records.summary_rule, SUMMARY)):
        like = [page] + [page.replace("Otro", f" O  {k} &amp; > ").replace("Empleo", f' "E" {k}').replace(" 12</li>", f" {k}</li>").replace("b_7.pdf", f"b_{k}.pdf").replace("Texto", "\xa0") for k in range(9)]
        parsed.clear()
        assert [shapes[rule].events(p) for p in like] == [list(rule(own(p))) for p in like]
        assert len(parsed) == (1 if rule is records.old_rule else 10), "texts with > are no shape"
    item = '<div class="bandaNo"><div class="B2"><ul><li>{}</li></ul></div></div>'
    odd = ['one <span class="txBoN">L:</span> <a href="x">two</a>', '<span class="txBoN"> </span> two', '<span class="txBoN">L:</span>', "<script>a &amp; b</script>c", "a > b", "<!-- c -->d", '<a href="x>y">z</a>', '<a href="" href="q">z</a>', "\0", "\U000f0000", "<a href='x'>y</a>"]
    for page in [item.format(x) for x in odd] + [item.format(x.replace("two", "2 2").replace("L:", "M:").replace("c<", "d<")) for x in odd]:
        assert shapes[records.old_rule].events(page) == list(records.old_rule(own(page)))


def test_a_label_is_worked_out_once(spark):
    found = records.old_results(spark.createDataFrame([(1, FICHA)], "key long, page string"), encoding="utf-8")
    assert _plan(found).count("regexp_extract") < 20


def test_pages_of_old_catalogues_are_bounded(spark, small, monkeypatch):
    from foliograph.plans import page_queries as pq

    rows = lambda: sorted(map(str, pq.old_catalogue(spark, small).collect()))
    whole, own, given = rows(), records.catalogue_links, []
    monkeypatch.setattr(pq, "PAGE_NUMBERS", 64)
    monkeypatch.setattr(records, "catalogue_links", lambda pages: given.append(pages) or own(pages))
    assert rows() == whole
    assert max(r["page"].count("<a ") for r in given[0].collect()) <= 2 * 64
