"""Records out of recorded pages.

Bulletins and articles are nested and are read page by page (``read_pages``).
Flat pages - summaries, result lists, the old portal's catalogue and bulletins -
become events in page order (``events``); what belongs together is then said
with windows and aggregates over the events.  What can't be read becomes a row
with an error instead of failing the job.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..errors import UnreadablePage
from ..functions import identifiers as ids
from ..functions.identifiers import SITE, Cve, InvalidIdentifier
from ..functions.scalars import EXTRAORDINARY, MONTHS, NUMBER_SIGNS, catalogue_label, clean, figures_date, once, ordinal_number, result_counter, secure_url, spanish_date
from ..shipping import shared_folder, ship
from .tree import Element, Event, Shapes, first_number, parse, plain_text, squeeze

# Addresses and identifiers in the sources' pages.
IN_TEXT = r"(?i)BOME-[A-Z]{1,2}-\d{4}-\d+"
BULLETIN_HREF = r"(?i)/bome/(BOME-BX?-\d{4}-\d+)/?$"
RECORD_HREF, RECORD_ID = "ficha_bome.jsp", r"dboidboletin=(\d+)"
OLD_SITE = "https://www.melilla.es/melillaPortal"
#: Bulletins from this year on have official identifiers.
OFFICIAL_SINCE = 2014

REF = "cve string, number bigint, date date, extraordinary boolean, url string, title string"
ARTICLE_REF = "struct<cve:string,number:bigint,summary:string,url:string,pdf_url:string,first_page:bigint>"
UNIT = f"struct<name:string,articles:array<{ARTICLE_REF}>>"
SECTION = f"struct<name:string,id:bigint,article_count:bigint,page_count:bigint,units:array<{UNIT}>>"
BULLETIN = f"cve string, number bigint, date date, extraordinary boolean, url string, pdf_url string, summary_url string, summary_pdf_url string, departments array<struct<name:string,article_count:bigint,page_count:bigint,sections:array<{SECTION}>>>"
PAGE = "struct<number:bigint,cve:string,pdf_url:string,text:string>"
ARTICLE = f"cve string, number bigint, bulletin_cve string, bulletin_number bigint, bulletin_date date, heading string, summary string, text string, pages array<{PAGE}>, url string, pdf_url string"


# --- pieces ------------------------------------------------------------------


def day_of(text: str | None) -> date | None:
    """``spanish_date`` for one text."""
    words = (text or "").lower().split()
    for day, of, month, of_year, year in zip(words, words[1:], words[2:], words[3:], words[4:], strict=False):
        figures = re.search(r"\d{1,2}$", day)
        if figures and of == of_year == "de" and month.isalpha() and year[:4].isdecimal() and len(year) > 3:
            try:
                return date(int(year[:4]), MONTHS.index("septiembre" if month == "setiembre" else month) + 1, int(figures[0]))
            except ValueError:
                return None
    return None


def _link(node: Element | None, site: str) -> str | None:
    href = node.attrs.get("href", "").strip() if node is not None else ""
    return href if not href or href.startswith(("http://", "https://")) else f"{site.rstrip('/')}/{href.lstrip('/')}"


def _address(node: Element | None, site: str) -> str | None:
    return _link(node, site) or None


def _text(node: Element | None) -> str:
    return node.text() if node is not None else ""


def _header(root: Element) -> Element:
    header = root.first("section", id="bome-show")
    if header is None:
        raise UnreadablePage("the page has no gazette header")
    return header


def _action(header: Element, kind: str) -> Element | None:
    bar = header.first(cls="bome-show-actions")
    return bar.first("a", data_bome_tipo=kind) if bar is not None else None


def _printed_cve(text: str) -> Cve:
    found = re.search(IN_TEXT, text)
    if not found:
        raise UnreadablePage("the header has no identifier")
    return Cve.parse(found[0])


def _count(node: Element | None, title: str) -> int | None:
    return first_number(_text(node.first("span", title=title))) if node is not None else None


# --- nested pages ------------------------------------------------------------


def bulletin_of(page: str, site: str = SITE) -> dict:
    """A bulletin as departments > sections > units > articles."""
    root = parse(page)
    header = _header(root)
    cve = _printed_cve(_text(header.first("h2"))).as_kind("B")
    title, bar = _text(header.first("h1")), header.first(cls="bome-show-actions")
    has_summary = bar is not None and bar.first("a", where=lambda e: e.attrs.get("href", "").endswith("/sumario")) is not None

    def article(item: Element) -> dict | None:
        found = re.search(IN_TEXT, _text(item.first("h5")))
        if not found:
            return None
        own = Cve.parse(found[0])
        return {"cve": str(own), "number": own.number, "summary": _text(item.first("blockquote")) or None, "url": f"{site}/bome/{cve}/articulo/{own.number}", "pdf_url": _address(item.first("a", data_bome_tipo="Articulo"), site), "first_page": None}

    def unit(item: Element) -> dict:
        lists = item.all("ul", cls="articulo-list")
        return {"name": _text(item.first("h4")), "articles": [a for ul in lists for li in ul.own("li") if (a := article(li))]}

    def section(block: Element) -> dict:
        button = block.first(cls="accordion-button")
        ending = re.search(r"(\d+)$", block.attrs.get("id", ""))
        return {"name": _text(button.first("span")) if button is not None else "", "id": int(ending[1]) if ending else None, "article_count": _count(button, "Número de artículos"), "page_count": _count(button, "Número de páginas"), "units": [unit(li) for ul in block.all("ul", cls="organismo-list") for li in ul.own("li")]}

    def department(block: Element) -> dict:
        head = block.first("h3")
        return {"name": _text(head.first("span")) if head is not None else "", "article_count": _count(head, "Número de artículos"), "page_count": _count(head, "Número de páginas"), "sections": [section(b) for b in block.all(cls="accordion-consejeria")]}

    body = root.first("section", id="bome-show-content") or root
    return {
        "cve": str(cve), "number": cve.number, "date": day_of(title), "extraordinary": cve.extraordinary, "url": f"{site}/bome/{cve}", "pdf_url": f"{site}/bome/descargar/{cve}.pdf",
        "summary_url": f"{site}/bome/{cve}/sumario" if has_summary else None, "summary_pdf_url": _address(_action(header, "Sumario"), site),
        "departments": [department(b) for b in body.all(cls="bome-show-departamento")],
    }


def printed_pages(box: Element | None, site: str) -> list[dict]:
    """The printed pages in a box, those with a number."""
    numbers = {id(block): first_number(block.attrs["id"]) for block in (box or Element("", {}, None)).all("div", cls="pagina") if block.attrs.get("id", "").startswith("pagina-")}

    def read(block: Element) -> dict:
        title = block.first(cls="pagina-titulo")
        link = title.first("a", data_bome_tipo="Pagina") if title is not None else None
        name = link.attrs.get("data-bome-name") if link is not None else None
        text = block.first(cls="pagina-texto")
        return {"number": numbers[id(block)], "cve": str(Cve.parse(name)) if name else None, "pdf_url": _address(link, site), "text": plain_text(text) if text is not None else ""}

    return [read(block) for block in box or () if numbers.get(id(block)) is not None]


def article_of(page: str, site: str = SITE) -> dict:
    """An article with its text by printed page."""
    root = parse(page)
    header = _header(root)
    cve, crumbs = _printed_cve(_text(header.first("h2"))), header.first(cls="breadcrumb")
    link = crumbs.first("a", where=lambda e: "/bome/BOME-" in e.attrs.get("href", "")) if crumbs is not None else None
    found = re.search(BULLETIN_HREF, link.attrs["href"]) if link is not None else None
    if not found:
        raise UnreadablePage("the article doesn't link its bulletin")
    bulletin, title = Cve.parse(found[1]), _text(header.first("h1"))
    body = root.first("section", id="bome-show-articulo-content") or Element("", {}, None)
    pages = printed_pages(body.first(cls="paginas-sumario"), site)
    number = re.search(r"no ?(\d+)", title.lower().translate({ord("º"): "o", ord("°"): "o"}).replace("no.", "no"))
    return {
        "cve": str(cve), "number": cve.number, "bulletin_cve": str(bulletin), "bulletin_number": int(number[1]) if number else None, "bulletin_date": day_of(title),
        "heading": _text(body.first("h3")) or None, "summary": _text(body.first(cls="intro-sumario")) or None,
        "text": "\n\n".join(p["text"] for p in pages if p["text"]) or None, "pages": pages, "url": f"{site}/bome/{bulletin}/articulo/{cve.number}", "pdf_url": _address(_action(header, "Articulo"), site),
    }


#: Records or events of a batch that goes back to Spark.
ROWS_BACK = 4_096


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _read_batches(batches: Iterator[pa.RecordBatch], reader: Callable[[str], dict], schema: pa.Schema, encoding: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, page in zip(batch.column(0), batch.column(1), strict=True):
            try:
                page = page.as_py()
                rows.append(reader(page.decode(encoding) if isinstance(page, bytes) else page or "") | {"key": key.as_py(), "error": None})
            except (UnreadablePage, InvalidIdentifier, UnicodeDecodeError) as error:
                rows.append({"key": key.as_py(), "error": str(error)})
            if len(rows) == ROWS_BACK:
                yield _arrow(rows, schema)
                rows = []
        yield _arrow(rows, schema)


def read_pages(pages: DataFrame, reader: Callable[[str], dict], schema: str, key: str = "key", page: str = "page", encoding: str = "utf-8") -> DataFrame:
    """The record of each page, with its key and ``error`` (null where it could be read).  Binary pages are decoded, old ones as ISO-8859-1."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(page).alias("page"))
    schema = StructType.fromDDL(f"key {dict(rows.dtypes)['key']}, {schema}, error string")
    return rows.mapInArrow(partial(_read_batches, reader=reader, schema=to_arrow_schema(schema), encoding=encoding), schema)


def articles_of_bulletins(bulletins: DataFrame) -> DataFrame:
    """The nested tree as flat article rows in page order."""
    rows = bulletins.where("error is null") if "error" in bulletins.columns else bulletins
    rows = rows.select(F.col("cve").alias("bulletin_cve"), "date", "extraordinary", F.posexplode("departments").alias("p1", "d"))
    rows = rows.select("*", F.posexplode("d.sections").alias("p2", "s")).select("*", F.posexplode("s.units").alias("p3", "u")).select("*", F.posexplode("u.articles").alias("p4", "a"))
    return rows.select("bulletin_cve", "date", "extraordinary", F.struct("p1", "p2", "p3", "p4").alias("pos"), F.col("d.name").alias("department"), F.col("s.name").alias("section"), F.col("s.id").alias("section_id"), F.col("u.name").alias("unit"), "a.*")


# --- flat pages as events ----------------------------------------------------

def _event_batches(batches: Iterator[pa.RecordBatch], rule: Callable[[Element], Iterator[Event]], schema: pa.Schema, encoding: str) -> Iterator[pa.RecordBatch]:
    names = ("pos", "kind", "text", "attrs", "error")

    def arrow(keys: list, rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(keys, schema.field("key").type), *(pa.array(list(c), schema.field(n).type) for n, c in zip(names, columns, strict=True))], schema=schema)

    for batch in batches:
        keys, rows = [], []
        for key, page in zip(batch.column(0), batch.column(1), strict=True):
            key = key.as_py()
            try:
                page = page.as_py()
                root = parse(page.decode(encoding) if isinstance(page, bytes) else page or "")
                del page
                for pos, (kind, text, attrs) in enumerate(rule(root)):
                    keys.append(key)
                    rows.append((pos, kind, text, list(attrs.items()), None))
                    if len(rows) >= ROWS_BACK:
                        yield arrow(keys, rows)
                        keys, rows = [], []
            except (UnreadablePage, UnicodeDecodeError) as error:
                keys.append(key)
                rows.append((None, None, None, None, str(error)))
        yield arrow(keys, rows)


def events(pages: DataFrame, rule: Callable[[Element], Iterator[Event]], key: str = "key", page: str = "page", encoding: str = "utf-8") -> DataFrame:
    """(key, pos, kind, text, attrs, error): what ``rule`` finds on each page, in page order; one row with an error for a page that is none of its kind."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(page).alias("page"))
    schema = StructType.fromDDL(f"key {dict(rows.dtypes)['key']}, pos bigint, kind string, text string, attrs map<string,string>, error string")
    return rows.mapInArrow(partial(_event_batches, rule=rule, schema=to_arrow_schema(schema), encoding=encoding), schema)


def written_once(found: DataFrame) -> DataFrame:
    """Events that several branches of one result look at: written to the shared folder, so that pages are made and read once."""
    spark = found.sparkSession
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def _folded_batches(batches: Iterator[pa.RecordBatch], rule: Callable[[Element], Iterator[Event]], fold: Callable[[list[Event]], tuple], schema: pa.Schema, encoding: str) -> Iterator[pa.RecordBatch]:
    shapes, nothing = Shapes(rule), (None,) * (len(schema) - 2)
    for batch in batches:
        keys, pages = batch.columns
        for start in range(0, batch.num_rows, ROWS_BACK):
            rows = []
            for page in pages.slice(start, ROWS_BACK).to_pylist():
                try:
                    rows.append((*fold(shapes.events(page.decode(encoding) if isinstance(page, bytes) else page or "")), None))
                except (UnreadablePage, UnicodeDecodeError) as error:
                    rows.append((*nothing, str(error)))
            columns = [_column([r[k] for r in rows], f.type) for k, f in enumerate(list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([keys.slice(start, ROWS_BACK).cast(schema.field(0).type), *columns], schema=schema)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as Arrow, structs given as tuples; a list's items are laid out field by field."""
    if pa.types.is_list(kind):
        ends = [0]
        for v in values:
            ends.append(ends[-1] + len(v or ()))
        offsets = pa.array([None if v is None else end for v, end in zip(values, ends, strict=False)] + ends[-1:], pa.int32())
        return pa.ListArray.from_arrays(offsets, _column([x for v in values if v for x in v], kind.value_type), type=kind)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_column([v[k] for v in values], f.type) for k, f in enumerate(kind)], fields=list(kind))
    return pa.array(values, kind)


def folded(pages: DataFrame, rule: Callable[[Element], Iterator[Event]], fold: Callable[[list[Event]], tuple], schema: str, encoding: str = "utf-8") -> DataFrame:
    """(key, fields of ``schema``, error): what ``fold`` makes of the events that ``rule`` finds on each page, written once."""
    ship(pages.sparkSession)
    rows = pages.select("key", "page")
    schema = StructType.fromDDL(f"key {dict(rows.dtypes)['key']}, {schema}, error string")
    return written_once(rows.mapInArrow(partial(_folded_batches, rule=rule, fold=fold, schema=to_arrow_schema(schema), encoding=encoding), schema))


# As Java reads them: figures are 0 to 9, and ``$`` matches at the end and before a line's end there.
_FIGURES, _LEADING, _PLACE = re.compile("[0-9]+"), re.compile(" *([0-9]+)"), re.compile(r" *[0-9]+ *\. *")
_IN_FILE, _IN_RECORD = re.compile(r"_([0-9]+)\.pdf(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"), re.compile(RECORD_ID, re.ASCII)


def _bigint(figures: str | None) -> int | None:
    """``try_cast`` of figures."""
    figures = (figures or "").lstrip("0") or figures
    number = int(figures) if figures and len(figures) < 20 else None
    return number if number is None or number < 1 << 63 else None


def _first_int(text: str | None) -> int | None:
    found = _FIGURES.search(text or "")
    return _bigint(found[0]) if found else None


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _on(kind: str) -> Column:
    return F.col("kind") == kind


def failures(found: DataFrame) -> DataFrame:
    """(key, error) of the pages that couldn't be read."""
    return found.where("error is not null").select("key", "error")


def summary_rule(root: Element) -> Iterator[Event]:
    header = _header(root)
    link = _action(header, "Sumario")
    yield "header", _text(header.first("h1")), {"cve": _text(header.first("h2")), "pdf": link.attrs.get("href") if link is not None else None}
    for node in root.first("section", id="bome-show-sumario-content") or root:
        classes = node.classes()
        if node.tag == "h2" and node.above("sumario-departamento") is not None:
            yield "department", node.text(), {}
        if node.tag == "h3" and "sumario-consejeria" in classes:
            yield "section", node.text(), {}
        if node.tag == "div" and "sumario-articulo" in classes:
            yield "article", _text(node.first(cls="sumario-articulo__content")), {"number": node.attrs.get("data-numero"), "page": _text(node.first(cls="sumario-articulo__pagina"))}
        if node.tag == "div" and "pagina" in classes and node.attrs.get("id", "").startswith("pagina-"):
            yield "page", "", {"number": node.attrs["id"]}


SUMMARY = "title string, printed string, pdf string, pages array<bigint>, entries array<struct<department:string,section:string,number:bigint,said:string,first_page:bigint>>"


def summary_fold(events: list[Event]) -> tuple:
    """SUMMARY: department and section of an entry are the last headings before it; a new department ends the section."""
    title = printed = pdf = department = section = None
    pages, entries = [], []
    for kind, text, attrs in events:
        if kind == "header":
            title, printed, pdf = text, attrs["cve"], attrs["pdf"]
        elif kind == "department":
            department, section = text or None, None
        elif kind == "section":
            section = text or None
        elif (number := _first_int(attrs["number"])) is not None:
            if kind == "page":
                pages.append(number)
            else:
                entries.append((department, section, number, text[found.end() if (found := _PLACE.match(text)) else 0 :] or None, _first_int(attrs["page"])))
    return title, printed, pdf, pages, entries


def summaries(pages: DataFrame, site: str = SITE) -> DataFrame:
    """One row a summary page: key, bulletin_cve, cve, bulletin_number, date, url, pdf_url, pages, entries, warning, error.

    Department and section of an entry are the last headings before it; a new
    department ends the section.  A page of free text has no entries and says so
    in ``warning``.
    """
    found = folded(pages, summary_rule, summary_fold, SUMMARY)

    def owned(owner: Column) -> Column:
        kind = F.when(F.startswith(owner["kind"], F.lit("S")), F.replace(owner["kind"], F.lit("S"), F.lit("B"))).otherwise(owner["kind"])
        of = F.struct(kind.alias("kind"), owner["year"].alias("year"))
        return F.struct(owner.alias("owner"), ids.bulletin_of(owner).alias("bulletin"), ids.article_of(of, F.lit("")).alias("article_"))

    # inline: the identifiers are worked out once a page, not once a field or entry
    printed = once(ids.cve_struct(F.regexp_extract("printed", IN_TEXT, 0)), owned)
    whole = found.where("error is null").select("key", "title", "pdf", "pages", "entries", F.inline(F.array(printed)))
    cve, owner = F.col("bulletin"), F.col("owner")
    base = F.concat(F.lit(f"{site}/bome/"), cve)

    def entry(e: Column) -> Column:
        article = F.concat("article_", e["number"].cast("string"))
        own = F.struct(article.alias("cve"), e["number"].alias("number"), e["said"].alias("summary"), F.concat(base, F.lit("/articulo/"), e["number"].cast("string")).alias("url"), F.concat(F.lit(f"{site}/bome/descargar/"), article, F.lit(".pdf")).alias("pdf_url"), e["first_page"].alias("first_page"))
        return F.struct(e["department"].alias("department"), e["section"].alias("section"), own.alias("article"))

    pdf = F.when(F.col("pdf").rlike("^https?://"), F.col("pdf")).otherwise(F.concat(F.lit(f"{site}/"), F.regexp_replace("pdf", "^/+", "")))
    good = whole.select(
        "key", cve.alias("bulletin_cve"), ids.summary_of(owner).alias("cve"), ordinal_number(F.col("title")).alias("bulletin_number"), spanish_date(F.col("title")).alias("date"), F.concat(base, F.lit("/sumario")).alias("url"), pdf.alias("pdf_url"), "pages", F.transform("entries", entry).alias("entries"),
        F.when(F.size("entries") == 0, "the summary is free text; read the bulletin instead").alias("warning"), F.when(cve.isNull(), "the header has no identifier of a bulletin").alias("error"),
    )
    return good.unionByName(failures(found), allowMissingColumns=True)


def _links_of(blocks: list[Element]) -> Iterator[Event]:
    for block in blocks:
        for a in block.all("a"):
            yield "link", a.text(), {"href": a.attrs.get("href")}


def results_rule(root: Element) -> Iterator[Event]:
    block = root.first(cls="page-search-result")
    yield "page", _text(block), {}
    yield from _links_of([block] if block is not None else [])


def slides_rule(root: Element) -> Iterator[Event]:
    yield "page", "", {}
    yield from _links_of(root.all(cls="swiper-slide"))


def bulletin_links(found: DataFrame, site: str = SITE) -> DataFrame:
    """(key, pos and the fields of REF): links that lead to a bulletin."""
    cve = ids.cve_struct(F.regexp_extract(F.col("attrs")["href"], BULLETIN_HREF, 1))
    # inline: the identifier is worked out once a link, not once a field
    rows = found.where(_on("link")).select("key", "pos", "text", F.inline(F.array(F.struct(cve.alias("c"))))).where("c is not null")
    text = ids.cve_text(F.col("c"))
    return rows.select("key", "pos", text.alias("cve"), F.col("c.number").alias("number"), spanish_date(F.col("text")).alias("date"), ids.is_extraordinary(F.col("c")).alias("extraordinary"), F.concat(F.lit(f"{site}/bome/"), text).alias("url"), _filled(F.col("text")).alias("title"))


def results(pages: DataFrame, site: str = SITE) -> DataFrame:
    """One row a page of site search results: key, results, page, total_pages, total_results, error; without a counter it is the only page."""
    found = written_once(events(pages, results_rule))
    hit = F.struct("cve", "number", "date", "extraordinary", "url", "title")
    hits = bulletin_links(found, site).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", hit.alias("hit")))), lambda x: x["hit"]).alias("results"))
    counter = result_counter(F.col("text"))
    rows = found.where(_on("page") & F.col("error").isNull()).select("key", counter.alias("c")).join(hits, "key", "left")
    rows = rows.withColumn("results", F.coalesce("results", F.array().cast(hits.schema["results"].dataType))).withColumn("n", F.size("results").cast("long"))
    good = rows.select("key", "results", F.coalesce("c.page", F.lit(1)).alias("page"), F.coalesce("c.pages", F.least("n", F.lit(1))).alias("total_pages"), F.coalesce("c.total", "n").alias("total_results"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(failures(found), allowMissingColumns=True)


def years(pages: DataFrame, site: str = SITE) -> DataFrame:
    """The bulletins of years' sliders, as listed: key, pos and the fields of REF."""
    return bulletin_links(events(pages, slides_rule), site)


# --- the old portal ----------------------------------------------------------


def catalogue_rule(root: Element) -> Iterator[Event]:
    links = root.all("a", where=lambda e: RECORD_HREF in e.attrs.get("href", ""))
    if not links:
        raise UnreadablePage("the catalogue lists no bulletin")
    pictures: dict[int, str | None] = {}  # of a block, which is looked through once, however many links it has
    for a in links:
        block = a.above("set")
        if block is not None and block.start not in pictures:
            pictures[block.start] = next((i.attrs.get("src", "") for title in block.all("div", cls="title") for i in title.all("img")), None)
        yield "link", a.text(), {"href": a.attrs["href"], "picture": pictures[block.start] if block is not None else None}


def record_url(record: Column) -> Column:
    """The old portal's page of a bulletin."""
    return F.concat(F.lit(f"{OLD_SITE}/contenedor.jsp?seccion={RECORD_HREF}&dboidboletin="), record.cast("string"), F.lit("&codResi=1&language=es&codAdirecto=15"))


def _record_of(href: Column) -> Column:
    return F.regexp_extract(href, RECORD_ID, 1).try_cast("bigint")


def catalogue_links(pages: DataFrame, encoding: str = "ISO-8859-1") -> DataFrame:
    """(key, pos, record, text, header_year and the label's fields): the links of old catalogues."""
    rows = events(pages, catalogue_rule, encoding=encoding).where("error is null")
    year = F.regexp_extract(F.col("attrs")["picture"], r"/(\d{4})\.jpg$", 1).try_cast("int")
    # inline: the label is worked out once a link, not once a field
    return rows.select("key", "pos", _record_of(F.col("attrs")["href"]).alias("record"), "text", year.alias("header_year"), F.inline(F.array(catalogue_label(F.col("text")))))


def catalogue(links: DataFrame) -> DataFrame:
    """Old bulletins, each record once, the first link that can be read kept."""
    good = links.where("record is not null and cve is not null")
    first = F.row_number().over(Window.partitionBy("key", "record").orderBy("pos"))
    return good.withColumn("k", first).where("k = 1").select("key", "pos", "record", "cve", "number", "extraordinary", "suffix", "date", (F.year("date") >= OFFICIAL_SINCE).alias("official"), record_url(F.col("record")).alias("url"))


def catalogue_warnings(links: DataFrame) -> DataFrame:
    """(kind, record, year, n): links that can't be read (links with a picture only count if their record has no other), records whose links differ, headers with bulletins of other years."""
    from ..operators.browse import catalogue_warnings as of

    read = links.where("cve is not null").select("record").distinct()
    bare = links.where("text = ''").join(read, "record", "left_anti").dropDuplicates(["key", "record"])
    told = links.where("text <> ''").unionByName(bare.select(links.columns))
    return of(told.withColumn("cve", F.when(F.col("record").isNotNull(), F.concat_ws("~", "cve", F.coalesce("suffix", F.lit("")), "date"))).withColumn("cve", F.when(F.col("date").isNotNull(), F.col("cve"))))


def old_rule(root: Element) -> Iterator[Event]:
    band = root.first("div", cls="bandaNo")
    if band is None:
        raise UnreadablePage("the page has no results area")
    bars = [bar for name in ("banda8", "banda9") if (bar := band.first("div", cls=name)) is not None]
    yield "header", squeeze(" ".join(map(_text, bars))), {}
    for bar in bars[::-1]:
        for a in bar.all("a"):
            yield "file", "", {"href": a.attrs.get("href")}
    for div in band.all("div"):
        for name in div.classes():
            if name in ("bandabome", "bandanegociado"):
                yield {"bandabome": "top", "bandanegociado": "head"}[name], div.text(), {}
        for ul in div.all("ul") if "B2" in div.classes() else ():
            if ul.all("li"):
                yield "article", "", {}
            for li in ul.own("li"):
                label, said = _text(li.first("span", cls="txBoN")), li.text()
                yield "field", said[len(label) :].lstrip(), {"label": label} | ({} if said.startswith(label) else {"uneven": "yes"})
                for a in li.all("a"):
                    yield "link", a.text(), {"label": label, "href": a.attrs.get("href")}


#: Fields with a meaning of their own; the first other one names an article's kind.
OWN_FIELDS = ("boletin", "articulo", "paginas")


OLD = "head string, pdf string, articles array<struct<place:bigint,record:bigint,label:string,number:bigint,kind:string,summary:string,path:array<string>,pages:array<struct<number:bigint,url:string>>>>"


@lru_cache(4096)
def _field_name(label: str) -> tuple[str, str]:
    """A field's label without its colons, and its name among OWN_FIELDS."""
    label = label.rstrip(":").strip(" ")
    return label, label.lower().translate({ord("í"): "i", ord("á"): "a", ord("ó"): "o"})


def _old_page(text: str, href: str) -> tuple:
    in_href = _IN_FILE.search(href)
    number = _bigint(text) if _FIGURES.fullmatch(text) else None
    return number if number is not None or not in_href else _bigint(in_href[1]), "https://" + href[7:] if href.startswith("http://") else href


def old_fold(events: list[Event]) -> tuple:
    """OLD, from the events of ``old_rule``.

    Headings pile up until an article takes them; one without new headings has
    those of the article before it; a top heading starts anew.
    """
    head = pdf = None
    top, chain, coming, articles, own, place = "", (), [], [], {}, 0

    def close() -> None:
        if own:
            record, label = own.get("bulletin", (None, None))
            kind, summary = own.get("other", (None, None))
            articles.append((own["place"], record, label, own.get("number"), kind, summary, own["path"], own["pages"]))

    for event, text, attrs in events:
        if event == "field":
            label, name = _field_name(attrs["label"])
            if name == "articulo":
                found = _LEADING.match(text)
                number = _bigint(found[1]) if found else None
                if number is not None and number > own.get("number", -1):
                    own["number"] = number
            elif name not in OWN_FIELDS and "other" not in own:
                own["other"] = label or None, text.lstrip(" :").strip(" ") or None
        elif event == "link":
            name, href = _field_name(attrs["label"])[1], attrs["href"]
            if name == "boletin" and "bulletin" not in own:
                found = _IN_RECORD.search(href or "")
                own["bulletin"] = _bigint(found[1]) if found else None, text
            elif name == "paginas" and href is not None:
                own["pages"].append(_old_page(text, href))
        elif event == "article":
            close()
            chain, coming, place = coming or chain, [], place + 1
            own = {"place": place, "path": [h for h in (top, *chain) if h], "pages": []}
        elif event == "head":
            coming.append(text)
        elif event == "top":
            top, chain, coming = text, (), []
        elif event == "file":
            pdf = attrs["href"] if pdf is None and "mandar.php" in (attrs["href"] or "") else pdf
        else:
            head = text
    close()
    return head, pdf, articles


def old_articles(found: DataFrame) -> DataFrame:
    """(key, place, record, label, number, kind, summary, path, pages): articles of old pages, from what ``old_fold`` made of them."""
    return found.where("error is null").select("key", F.inline("articles"))


def old_results(pages: DataFrame, encoding: str = "ISO-8859-1") -> DataFrame:
    """Articles that the old portal's search found, ordered by page and by their place on it: key, place, cve, date, number, kind, summary, path, pages, record, url."""
    rows = old_articles(folded(pages, old_rule, old_fold, OLD, encoding)).orderBy("key", "place")
    # labels are read behind the sort, which looks at its rows twice; inline: once a row, not once a field
    label = F.struct(catalogue_label(F.col("label")).alias("of"))
    found = rows.select("*", F.inline(F.array(label)))
    return found.select("key", "place", "of.cve", "of.date", "number", "kind", "summary", "path", "pages", "record", record_url(F.col("record")).alias("url"))


def old_bulletins(pages: DataFrame, known: DataFrame | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """One row an old bulletin's page; the key is its record: record, cve, number, extraordinary, suffix, date, official, pdf_url, articles, error.

    What the catalogue ``known`` (record, cve, number, extraordinary, suffix,
    date) says of its number wins over the page's heading.
    """
    found = folded(pages, old_rule, old_fold, OLD, encoding)
    heads = found.where("error is null").select("key", F.lower(clean(F.col("head"))).alias("head"), secure_url(F.col("pdf")).alias("pdf_url"), "articles")
    # every way to write "number" becomes one sign; the number is the first one behind it, an extraordinary issue's word aside
    signed = F.col("head")
    for sign in ("número", "numero", *NUMBER_SIGNS):
        signed = F.replace(signed, F.lit(sign), F.lit("#"))
    number = F.regexp_extract(F.regexp_replace(signed, EXTRAORDINARY, ""), r"#[ #-]*(\d+)", 1).try_cast("bigint")
    in_figures = F.filter(F.transform(F.split("head", " "), lambda w: figures_date(F.btrim(w, F.lit(".,;:()")))), lambda d: d.isNotNull())
    day = F.coalesce(spanish_date(F.col("head")), F.get(in_figures, F.lit(0)))
    extra = F.col("head").rlike(EXTRAORDINARY)
    cve = F.concat_ws("-", F.lit("BOME"), F.when(extra, "BX").otherwise("B"), F.year(day).cast("string"), number.cast("string"))
    heads = heads.select("key", "pdf_url", "articles", F.when((number > 0) & day.isNotNull(), F.struct(cve.alias("cve"), number.alias("number"), extra.alias("extraordinary"), F.lit(None).cast("string").alias("suffix"), day.alias("date"))).alias("own"))
    if known is not None:
        heads = heads.join(known.select(F.col("record").alias("key"), F.struct("cve", "number", "extraordinary", "suffix", "date").alias("known")), "key", "left").withColumn("own", F.coalesce("known", "own"))
    articles = F.transform("articles", lambda a: F.struct(*(a[c].alias(c) for c in ("number", "kind", "summary", "path", "pages"))))
    good = heads.select(F.col("key").alias("record"), "own.*", (F.year("own.date") >= OFFICIAL_SINCE).alias("official"), "pdf_url", articles.alias("articles"), F.when(F.col("own").isNull(), "the page has no bulletin number or date").alias("error"))
    return good.unionByName(failures(found).withColumnRenamed("key", "record"), allowMissingColumns=True)


# --- JSON --------------------------------------------------------------------

CALENDAR_ITEM = "array<struct<title:string,start:string,url:string>>"
ENTITY_ITEM = "array<struct<id:string,nombre:string>>"


def _calendar_items(payloads: DataFrame, json_col: str, site: str) -> DataFrame:
    """``calendar``, and where each row stands: (hash of the payload, position).  A payload is parsed once."""
    text = F.col(json_col)
    # the hash belongs to the payload: named beside posexplode, it would be worked out again for every event
    parsed = payloads.select(F.xxhash64(text).alias("payload"), F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, CALENDAR_ITEM)).alias("items"))
    sure = F.coalesce("items", F.raise_error(F.lit("the calendar isn't an array")))
    item = parsed.select("payload", F.posexplode(sure).alias("pos", "e")).select(F.struct("payload", "pos").alias("place"), "e.*")
    cve = F.upper(F.regexp_extract("url", r"(?i)/bome/(BOME-BX?-\d{4}-\d+)/?$", 1))
    kind, year, number = F.regexp_extract(cve, r"-(BX?)-", 1), F.regexp_extract(cve, r"-(\d{4})-", 1), F.regexp_extract(cve, r"(\d+)$", 1).try_cast("bigint")
    canonical = F.concat_ws("-", F.lit("BOME"), kind, year, number)
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", " "))
    return item.where((cve != "") & (number > 0)).select("place", canonical.alias("cve"), number.alias("number"), F.try_to_date(F.substring("start", 1, 10), "yyyy-MM-dd").alias("date"), (kind == "BX").alias("extraordinary"), F.concat(F.lit(f"{site}/bome/"), canonical).alias("url"), F.when(title != "", title).alias("title"))


def calendar(payloads: DataFrame, json_col: str = "json", site: str = SITE) -> DataFrame:
    """Bulletins of calendar payloads (arrays of events); events without a bulletin's address are left out.

    A payload that is no array fails the job; ``not_arrays`` finds those.
    """
    return _calendar_items(payloads, json_col, site).drop("place")


def whole_calendar(payloads: DataFrame, json_col: str = "json", site: str = SITE) -> DataFrame:
    """Bulletins of many payloads, whose ranges may overlap, each once: of several rows the first of one payload, whichever order the payloads are in."""
    rows = _calendar_items(payloads, json_col, site)
    first = F.min_by(F.struct(*(c for c in rows.columns if c != "place")), "place")
    return rows.groupBy("cve").agg(first.alias("r")).select("r.*")


def not_arrays(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    return payloads.where(~F.coalesce(F.trim(json_col).startswith("["), F.lit(False)) | F.from_json(json_col, CALENDAR_ITEM).isNull())


def entities(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """(id, name) of entity payloads; strict: an item without a numeric id fails the job."""
    item = payloads.select(F.explode(F.from_json(json_col, ENTITY_ITEM)).alias("e"))
    number = F.col("e.id").try_cast("bigint")
    checked = F.when(number.isNotNull(), number).otherwise(F.raise_error(F.lit("an entity without a numeric id")))
    return item.select(checked.alias("id"), F.trim(F.regexp_replace(F.coalesce("e.nombre", F.lit("")), r"(?U)\s+", " ")).alias("name"))


def resolved(redirects: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Where the site's resolver sends each identifier: (cve, target, target_kind, agrees); unknown ones have nulls."""
    joined = identifiers.join(redirects, "cve", "left")
    printed = F.regexp_extract("target", IN_TEXT, 0)
    kind = F.when(printed != "", ids.cve_struct(printed)["kind"])
    own = ids.cve_struct(F.col("cve"))["kind"]
    return joined.select("cve", "target", kind.alias("target_kind"), (F.endswith(kind, F.lit("X")) == F.endswith(own, F.lit("X"))).alias("agrees"))

