from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from foliograph.functions import identifiers as ids, scalars as sc

CVES = [
    (" bome - b - 2026 - 6416 ", "BOME-B-2026-6416"), ("BOME-BX-2020-0016", "BOME-BX-2020-16"), ("BOME-ZZ-2020-1", None),
    ("BOME-B-2020-0", None), ("BOME-B-20-1", None), ("", None), ("BOME-A-2014-1051", "BOME-A-2014-1051"),
]


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(column(F.col("t"))).collect()]


def test_identifiers(spark):
    got = values(spark, lambda t: F.when(ids.cve_struct(t).isNotNull(), ids.cve_text(ids.cve_struct(t))), [c for c, _ in CVES])
    assert got == [c for _, c in CVES]
    for raw, canonical in CVES:
        if canonical:
            assert str(ids.Cve.parse(raw)) == canonical
        else:
            with pytest.raises(ids.InvalidIdentifier):
                ids.Cve.parse(raw)
    assert str(ids.Cve.parse("BOME-SX-2020-3").as_kind("B")) == "BOME-BX-2020-3"
    with pytest.raises(ids.InvalidIdentifier):
        ids.Cve.parse("BOME-A-2020-3").as_kind("B")


def test_addresses(spark):
    c = lambda t: ids.cve_struct(t)
    assert values(spark, lambda t: ids.article_url(c(t), F.lit(5)), ["BOME-BX-2020-3", "BOME-A-2020-3"]) == ["https://bomemelilla.es/bome/BOME-BX-2020-3/articulo/5", None]
    assert values(spark, lambda t: ids.summary_url(c(t)), ["BOME-S-2020-3"]) == ["https://bomemelilla.es/bome/BOME-B-2020-3/sumario"]
    assert values(spark, lambda t: ids.pdf_url(c(t)), ["bome-ax-2020-3"]) == ["https://bomemelilla.es/bome/descargar/BOME-AX-2020-3.pdf"]


def test_dates(spark):
    assert values(spark, sc.spanish_date, ["Lunes, 22 de Septiembre de 2026", "31 de febrero de 2020", "1 de setiembre de 1999", "x", None]) == [date(2026, 9, 22), None, date(1999, 9, 1), None, None]
    assert values(spark, sc.flexible_date, ["2020-02-29", "29/02/2021", "1/3/2021", "2021/1/1"]) == [date(2020, 2, 29), None, date(2021, 3, 1), None]


def test_labels(spark):
    got = values(spark, sc.catalogue_label, ["nº Extra16 / 09-03-2021", "5722 / 17-01-2020", "nº 12 bis / 01-02-1999", "nº 7 / 31-02-1999", "x", "EXTRAORINARIO nº 3 / 1-1-1990"])
    assert [g and (g["cve"], g["suffix"]) for g in got] == [("BOME-BX-2021-16", None), ("BOME-B-2020-5722", None), ("BOME-B-1999-12", "12 bis"), None, None, ("BOME-BX-1990-3", "nº 3")]


def test_texts_as_they_come(spark):
    assert values(spark, sc.spanish_date, ["3  de\u00a0MARZO\nde 2020", "de 5 de de 2020", "1 de abril de 20"]) == [date(2020, 3, 3), None, None]
    assert values(spark, sc.ordinal_number, ["BOME Nº 41", "N° 7", "no. 12", "x", None]) == [41, 7, 12, None, None]
    odd = ["PAGINA 3 DE 1.000. Mostrando 1 elemento de un total de 1 elemento.", "Página 1 de 2.", "Página 1 de 2. Mostrando x elementos de un total de 3 elementos."]
    assert [c and tuple(c) for c in values(spark, sc.result_counter, odd)] == [(3, 1000, 1, 1), None, None]
    labels = ["n° 5 / 03-01-2020", "Nº. EXTRA - 3 / 3-1-2020", "nº extraordinario nº 4 / 03-01-2020 ", "5/6 / 03-01-2020", "0 / 03-01-2020", "nº 5 / 03-01-20", "abc / 03-01-2020"]
    assert [c and (c["cve"], c["suffix"]) for c in values(spark, sc.catalogue_label, labels)] == [("BOME-B-2020-5", None), ("BOME-BX-2020-3", None), ("BOME-BX-2020-4", "nº 4"), ("BOME-B-2020-5", "5/6"), None, None, None]


def test_headings_counters_statuses(spark):
    assert [tuple(h) for h in values(spark, sc.heading_parts, ["A - B - C - D", "A - B", "A"])] == [("A", "B", "C - D"), ("A - B", "", ""), ("A", "", "")]
    counter = values(spark, sc.result_counter, ["Página 0 de 0. Mostrando 0 elementos de un total de 0 elementos.", "Página 2 de 194. Mostrando 10 elementos de un total de 1.934 elementos.", "x"])
    assert [c and (c["page"], c["pages"], c["total"]) for c in counter] == [(1, 0, 0), (2, 194, 1934), None]
    statuses = spark.createDataFrame([(s,) for s in (None, 200, 403, 404, 429, 500, 503, 410)], "s int")
    assert [r[0] for r in statuses.select(sc.status_class(F.col("s"))).collect()] == ["no_answer", "ok", "blocked", "not_found", "blocked", "broken", "blocked", "refused"]


def test_retry_after(spark):
    now = F.lit(datetime(2026, 1, 1, 12, 0, 0))
    got = values(spark, lambda t: sc.retry_after_seconds(t, now), ["120", "-5", "Thu, 01 Jan 2026 12:01:30 GMT", "Thu, 01 Jan 2026 11:00:00 GMT", "soon", None])
    assert got == [120.0, 0.0, 90.0, 0.0, None, None]
    more = {"+5": 5.0, "1e3": 1000.0, ".5": 0.5, "7.": 7.0, "Thursday, 01-Jan-26 12:00:10 GMT": 10.0, "Thu Jan  1 12:00:20 2026": 20.0, "1 Jan 2026 13:00:30 +0100": 30.0, "Thu, 1 Jan 2026 12:01 GMT": 60.0, "01-Jan-70 00:00:00 GMT": 0.0, "1e999": None, "nan": None, "inf": None, "": None, "Thu, 32 Jan 2026 12:00:00 GMT": None, "--5": None}
    assert dict(zip(more, values(spark, lambda t: sc.retry_after_seconds(t, now), list(more)), strict=True)) == more


def test_addresses_of_files(spark):
    good = "http://www.melilla.es/mandar.php/n/1/2/a_3.pdf"
    assert values(spark, sc.allowed_pdf, [good, good + "?x", "https://evil.example/a.pdf", None]) == [True, False, False, False]
    assert values(spark, sc.file_name_of, [good, "https://x.example/a b.pdf?q=1"]) == ["a_3.pdf", "a_b.pdf"]
    assert values(spark, lambda t: sc.absolute_url(t, "https://x.example"), ["/a", "https://y.example/b", " "]) == ["https://x.example/a", "https://y.example/b", None]


def test_settings():
    assert sc.parse_setting("2,5") == 2.5 and sc.parse_setting("3.0", whole=True) == 3
    for bad in ("x", "1e5", "-1", "86401", ""):
        with pytest.raises(ValueError):
            sc.parse_setting(bad)
    with pytest.raises(ValueError):
        sc.parse_setting("2.5", whole=True)
