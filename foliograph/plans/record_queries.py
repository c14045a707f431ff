"""Queries over what the library reads and writes: article pages, results of the old search, counts printed on pages, stored files, snapshots, the old plan's order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ingest
from ..shipping import shared_folder
from ..sources import files, records
from .ingest_queries import _CHUNKS, _STATES, _states
from .page_queries import _LINES, _joined, _lines, _page, _text, _words
from .views import bulletins, page_lengths, table


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles of a bulletin, with two printed pages, one without a number."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") + 1).alias("customer"), F.col("o_orderpriority").alias("priority"))
    year = F.year("day").cast("string")
    head = F.concat(F.lit('<section id="bome-show"><h1>BOME Nº. '), _text("customer"), F.lit(" - "), _words("day"), F.lit("</h1><h2>CVE: BOME-A-"), year, F.lit("-"), _text("k"), F.lit('</h2><div class="breadcrumb"><a href="/">x</a><a href="/bome/BOME-B-'), year, F.lit("-"), _text("customer"), F.lit('">b</a></div></section>'))
    page = F.concat(F.lit('<div class="pagina" id="pagina-'), (F.col("k") % 90 + 1).cast("string"), F.lit('"><div class="pagina-titulo"><a data-bome-tipo="Pagina" data-bome-name="bome-p-'), year, F.lit('-7" href="/p.pdf">p</a></div><div class="pagina-texto"><p>uno '), F.col("priority"), F.lit("</p><table><tr><td>dos<td> <td>tres</table><script>no</script></div></div>"))
    body = F.concat(F.lit('<section id="bome-show-articulo-content"><h3>C - S - U</h3><p class="intro-sumario">Orden  de\n'), F.col("priority"), F.lit('</p><div class="paginas-sumario"><div class="pagina" id="otra"><div class="pagina-texto">nada</div></div>'), page, F.lit("</div></section>"))
    read = records.read_pages(orders.select(F.col("k").alias("key"), F.concat(head, body).alias("page")), records.article_of, records.ARTICLE)
    return read.select("cve", "number", "bulletin_cve", "bulletin_number", "bulletin_date", "heading", "summary", "text", F.size("pages").cast("long").alias("n_pages"), F.col("pages")[0]["cve"].alias("page_cve"), "error")


_ARTICLES = """select 'BOME-A-' || y || '-' || k as cve, k as number, 'BOME-B-' || y || '-' || customer as bulletin_cve, customer as bulletin_number, day as bulletin_date, 'C - S - U' as heading,
  'Orden de ' || priority as summary, 'uno ' || priority || chr(10) || 'dos | tres' as text, 1 as n_pages, 'BOME-P-' || y || '-7' as page_cve, cast(null as varchar) as error
from (select o_orderkey as k, year(o_orderdate) as y, cast(o_orderdate as date) as day, o_custkey + 1 as customer, o_orderpriority as priority from orders where o_orderkey > 0)"""


def old_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as result pages of the old search: each line an article, with the bulletin that it is in; every third label can't be read."""
    label = F.when(F.col("supplier") % 3 == 0, "?").otherwise(F.concat(F.lit("nº "), _text("supplier"), F.lit(" / "), F.date_format("day", "d-M-yyyy")))
    item = F.concat(F.lit('<div class="B2"><ul><li><span class="txBoN">Artículo:</span> '), _text("article"), F.lit('</li><li><span class="txBoN">Boletín:</span><a href="ficha_bome.jsp?dboidboletin='), _text("supplier"), F.lit('">'), label, F.lit('</a></li><li><span class="txBoN">Decreto:</span> del '), _text("n"), F.lit("</li></ul></div>"))
    band = F.when(F.col("n") % 2 == 1, F.concat(F.lit('<div class="bandabome">T'), _text("n"), F.lit("</div>"))).otherwise("")
    pages = _lines(spark, sf_dir).groupBy("k").agg(_joined(F.concat(band, item), "n").alias("body")).select(F.col("k").alias("key"), F.concat(F.lit('<div class="bandaNo">'), F.col("body"), F.lit("</div>")).alias("page"))
    return records.old_results(pages, encoding="utf-8").select("key", F.array_join("path", " / ").alias("path"), "number", "kind", "summary", "record", "cve", "date")


_FOUND = f"""{_LINES} select k as key, 'T' || (n - (n + 1) % 2) as path, article as number, 'Decreto' as kind, 'del ' || n as summary, supplier as record,
  case when supplier % 3 <> 0 and supplier > 0 then 'BOME-B-' || year(day) || '-' || supplier end as cve, case when supplier % 3 <> 0 and supplier > 0 then day end as date from lines"""


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page prints as the number of a section's articles, pages too, and how many it lists."""
    item = F.concat(F.lit("<li><h5>BOME-A-2000-"), _text("article"), F.lit("</h5></li>"))
    own = _lines(spark, sf_dir).groupBy("k", "day", (F.col("supplier") % 3).alias("s")).agg(_joined(item, "n").alias("items"), F.count("*").alias("c"))
    counts = F.concat(F.lit('<span title="Número de artículos">('), (F.col("c") + 1000).cast("string"), F.lit(' artículos)</span><span title="Número de páginas">'), F.when(F.col("s") > 0, F.concat(_text("s"), F.lit(" páginas"))).otherwise("sin páginas"), F.lit("</span>"))
    section = F.concat(F.lit('<div class="accordion-consejeria" id="c-'), _text("s"), F.lit('"><button class="accordion-button"><span>S</span>'), counts, F.lit('</button><ul class="organismo-list"><li><ul class="articulo-list">'), F.col("items"), F.lit("</ul></ul></div>"))
    pages = own.groupBy("k", "day").agg(_joined(section, "s").alias("body")).select(_text("k").alias("key"), _page("day", "B", F.concat(F.lit('<section id="bome-show-content"><div class="bome-show-departamento">'), F.col("body"), F.lit("</div></section>"))).alias("page"))
    read = records.read_pages(pages, records.bulletin_of, records.BULLETIN).select("number", F.explode("departments").alias("d")).select("number", F.explode("d.sections").alias("s"))
    return read.select("number", F.col("s.id").alias("section"), F.col("s.article_count").alias("printed"), F.col("s.page_count").alias("pages"), F.size(F.flatten("s.units.articles")).cast("long").alias("listed"))


_COUNTS = f"{_LINES} select k as number, supplier % 3 as section, count(*) + 1000 as printed, case when supplier % 3 > 0 then supplier % 3 end as pages, count(*) as listed from lines group by k, supplier % 3"


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts kept as files: written, then asked for again with some that are new."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    own = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), _text("doc_id"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), "doc_id")
    files.write_files(own.where("doc_id % 3 = 0").drop("doc_id"), folder)
    return files.write_files(own.drop("doc_id"), folder)


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the calendar, then a newer one; readers see the newer, and the old one migrated on top of it."""
    folder = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    rows = bulletins(spark, sf_dir).select("bulletin", "date", "origin")
    files.write_snapshot(rows.where("bulletin % 2 = 0"), folder)
    files.write_snapshot(rows.where("bulletin % 5 <> 0"), folder)
    files.migrate_snapshot(spark, folder, lambda old: old.withColumn("version", F.lit(2)), files.SNAPSHOT_VERSION, 2)
    return files.read_snapshot(spark, folder, 2)


def old_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the old catalogue's plan, as many as one run takes, in its order."""
    planned = ingest.plan_old(bulletins(spark, sf_dir).select("bulletin", "number", "date").withColumn("record", F.col("bulletin") * 3), _states(spark, sf_dir))
    return planned.orderBy(*ingest.old_order()).limit(ingest.PER_RUN).select("record", "date", "state")


def chunks_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in chunks, by the table function, which is given the pages of one document after another."""
    from ..api import register_functions

    register_functions(spark)
    return spark.sql("SELECT doc, chunk, page, start, taken FROM chunks(TABLE({pages}) PARTITION BY doc ORDER BY page, budget => 1500)", pages=page_lengths(spark, sf_dir))


QUERIES = {
    "article_pages": article_pages,
    "old_search_pages": old_search_pages,
    "section_counts": section_counts,
    "stored_files": stored_files,
    "snapshot_latest": snapshot_latest,
    "old_plan_order": old_plan,
    "chunks_in_sql": chunks_in_sql,
}

ORACLES = {
    "article_pages": _ARTICLES,
    "old_search_pages": _FOUND,
    "section_counts": _COUNTS,
    "stored_files": "select 'd' || doc_id || '.txt' as name, strlen(text) as size, sha256(text) as sha256, doc_id % 3 = 0 as reused from documents",
    "snapshot_latest": "select o_orderkey as bulletin, cast(o_orderdate as date) as date, case when o_orderkey % 3 = 0 then 'old' else 'new' end as origin, 2 as version from orders where o_orderkey % 5 <> 0",
    "chunks_in_sql": _CHUNKS,
    "old_plan_order": f"{_STATES} select c.bulletin * 3 as record, c.date, k.state from bulletins c left join known k using (bulletin) where not coalesce(k.state = 'indexado' or (k.origin = 'old' and k.state in ('sin_sumarios', 'roto')), false) order by c.date desc nulls last, c.number desc, record desc limit 250",
}
