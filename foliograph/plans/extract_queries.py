"""Extraction and scalar-function queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import identifiers as ids, scalars as sc
from ..shipping import ship
from ..sources import records
from ..sources.tree import parse, plain_text
from .views import table

KINDS = ("B", "BX", "A", "AX", "S", "SX", "P", "ZZ")


def _plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"page_id": frame["page_id"], "text": [plain_text(parse(h)) if h else "" for h in frame["html"]]})


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(_plain, "page_id long, text string")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_count("html", F.lit(r"<a\s")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", sc.clean(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"), links.alias("links"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"))


def _cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % 8 + 1).cast("int"))
    raw = F.concat(F.lit(" bome - "), F.lower(kind), F.lit("-"), F.year("day").cast("string"), F.lit(" - 00"), F.col("k").cast("string"), F.lit(" "))
    c = F.col("c")
    rows = _orders(spark, sf_dir).select("k", ids.cve_struct(raw).alias("c"))
    return rows.select("k", c["kind"].alias("kind"), c["year"].alias("year"), c["number"].alias("number"), F.when(c.isNotNull(), ids.cve_text(c)).alias("cve"), ids.bulletin_of(c).alias("bulletin"), ids.summary_of(c).alias("summary"), ids.article_of(c, F.lit(7)).alias("article"), ids.article_url(c, F.lit(7)).alias("url"))


_CVES = """with c as (select o_orderkey as k, ['B','BX','A','AX','S','SX','P','ZZ'][cast(o_orderkey % 8 + 1 as int)] as kd, cast(year(o_orderdate) as int) as y from orders),
v as (select k, case when kd <> 'ZZ' and k > 0 then kd end as kind, case when kd <> 'ZZ' and k > 0 then y end as year, case when kd <> 'ZZ' and k > 0 then k end as number from c),
b as (select *, case when kind in ('B','S') then 'B' when kind in ('BX','SX') then 'BX' end as bk, case when kind in ('B','S') then 'S' when kind in ('BX','SX') then 'SX' end as sk, case kind when 'B' then 'A' when 'BX' then 'AX' end as ak from v)
select k, kind, year, number, 'BOME-' || kind || '-' || year || '-' || number as cve, 'BOME-' || bk || '-' || year || '-' || number as bulletin, 'BOME-' || sk || '-' || year || '-' || number as summary, 'BOME-' || ak || '-' || year || '-7' as article,
case when ak is not null then 'https://bomemelilla.es/bome/BOME-' || bk || '-' || year || '-' || number || '/articulo/7' end as url from b"""


def _spanish(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.element_at(F.array(*map(F.lit, sc.MONTHS)), F.month("day"))
    # every fifth has day 31 whatever the month, every eleventh no date
    number = F.when(F.col("k") % 5 == 0, F.lit(31)).otherwise(F.dayofmonth("day"))
    text = F.when(F.col("k") % 11 == 0, "sin fecha").otherwise(F.concat(F.lit("BOME del viernes, "), number.cast("string"), F.lit(" de "), F.initcap(month), F.lit(" de "), F.year("day").cast("string")))
    return _orders(spark, sf_dir).select("k", sc.spanish_date(text).alias("day"))


_SPANISH = "select o_orderkey as k, case when o_orderkey % 11 = 0 then null when o_orderkey % 5 = 0 then try_cast(year(o_orderdate) || '-' || lpad(cast(month(o_orderdate) as varchar), 2, '0') || '-31' as date) else cast(o_orderdate as date) end as day from orders"


def _flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("k") % 3 == 0, F.date_format("day", "dd/MM/yyyy")).when(F.col("k") % 3 == 1, F.date_format("day", "yyyy-MM-dd")).otherwise("31/02/2020")
    return _orders(spark, sf_dir).select("k", sc.flexible_date(text).alias("day"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("k") % 4 == 0, "nº Extra").when(F.col("k") % 4 == 1, "nº ").when(F.col("k") % 4 == 2, "EXTRAORINARIO-").otherwise(""), F.col("k").cast("string"), F.when(F.col("k") % 3 == 0, " bis").otherwise(""), F.lit(" / "), F.date_format("day", "dd-MM-yyyy"))
    rows = _orders(spark, sf_dir).select("k", sc.catalogue_label(text).alias("x"))
    return rows.select("k", "x.extraordinary", "x.number", "x.suffix", "x.date", "x.cve")


_LABELS = "select o_orderkey as k, case when o_orderkey > 0 then o_orderkey % 4 in (0, 2) end as extraordinary, case when o_orderkey > 0 then o_orderkey end as number, case when o_orderkey > 0 and o_orderkey % 3 = 0 then o_orderkey || ' bis' end as suffix, case when o_orderkey > 0 then cast(o_orderdate as date) end as date, case when o_orderkey > 0 then 'BOME-' || case when o_orderkey % 4 in (0, 2) then 'BX' else 'B' end || '-' || year(o_orderdate) || '-' || o_orderkey end as cve from orders"


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.format_number(F.col("k"), 0)
    text = F.concat(F.lit("Página 0 de "), F.ceil(F.col("k") / 10).cast("string"), F.lit(". Mostrando 10 elementos de un total de "), F.replace(n, F.lit(","), F.lit(".")), F.lit(" elementos."))
    rows = _orders(spark, sf_dir).select("k", sc.result_counter(text).alias("x"))
    return rows.select("k", "x.page", "x.pages", "x.total")


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, (200, 301, 403, 404, 410, 429, 500, 503))), (F.col("event_id") % 8 + 1).cast("int")))
    rows = table(spark, sf_dir, "events").select("event_id", status.cast("int").alias("status"))
    return rows.select("event_id", sc.status_class(F.col("status")).alias("kind"), sc.status_in_message(F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" from the site"))).alias("stored"))


_STATUSES = "with s as (select event_id, case when event_id % 9 = 0 then null else [200, 301, 403, 404, 410, 429, 500, 503][cast(event_id % 8 + 1 as int)] end as status from events) select event_id, case when status is null then 'no_answer' when status in (403, 429, 503) then 'blocked' when status = 404 then 'not_found' when status between 500 and 599 then 'broken' when status >= 400 then 'refused' else 'ok' end as kind, cast(status as int) as stored from s"


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.slice(F.array("p_name", "p_brand", "p_type", F.lit("Z")), 1, (F.col("p_partkey") % 4 + 1).cast("int")), " - ")
    return table(spark, sf_dir, "part").select("p_partkey", sc.heading_parts(text).alias("h")).select("p_partkey", "h.department", "h.section", "h.unit")


_HEADINGS = "with h as (select p_partkey, p_partkey % 4 + 1 as n, p_name, p_brand, p_type from part) select p_partkey, case when n >= 3 then p_name when n = 2 then p_name || ' - ' || p_brand else p_name end as department, case when n >= 3 then p_brand else '' end as section, case n when 3 then p_type when 4 then p_type || ' - Z' else '' end as unit from h"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    odd = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://www.melilla.es/mandar.php/n/"), F.col("page_id").cast("string"), F.lit("/1/a_1.pdf"))).otherwise(F.col("url"))
    return rows.select("page_id", sc.secure_url(odd).alias("secure"), sc.allowed_pdf(odd).alias("allowed"), sc.absolute_url(F.regexp_replace("url", "^https?://[^/]+", ""), "https://x.example/").alias("absolute"), sc.file_name_of(odd).alias("file_name"))


_URLS = "with u as (select page_id, url, case when page_id % 2 = 0 then 'http://www.melilla.es/mandar.php/n/' || page_id || '/1/a_1.pdf' else url end as odd from pages) select page_id, regexp_replace(odd, '^http://', 'https://') as secure, regexp_full_match(odd, 'https?://www\\.melilla\\.es/mandar\\.php/n/\\d+/\\d+/[A-Za-z0-9_]+\\.pdf') as allowed, 'https://x.example/' || regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '^/+', '') as absolute, regexp_replace(regexp_extract(regexp_replace(odd, '[?#].*$', ''), '([^/]+)/*$', 1), '[^A-Za-z0-9._~-]', '_', 'g') as file_name from u"


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders packed as calendar payloads, one a month, and read back."""
    kind = F.when(F.col("k") % 5 == 0, "BX").when(F.col("k") % 7 == 0, "A").otherwise("B")
    event = F.struct(F.concat(F.lit("  BOME  nº "), F.col("k").cast("string")).alias("title"), F.date_format("day", "yyyy-MM-dd").alias("start"), F.concat(F.lit("/bome/BOME-"), kind, F.lit("-"), F.year("day").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("url"))
    payloads = _orders(spark, sf_dir).groupBy(F.trunc("day", "month").alias("m")).agg(F.to_json(F.collect_list(event)).alias("json"))
    return records.calendar(payloads).select("cve", "number", "date", "extraordinary", "title")


_CALENDAR = "with o as (select o_orderkey as k, cast(o_orderdate as date) as day, case when o_orderkey % 5 = 0 then 'BX' when o_orderkey % 7 = 0 then 'A' else 'B' end as kind from orders) select 'BOME-' || kind || '-' || year(day) || '-' || k as cve, k as number, day as date, kind = 'BX' as extraordinary, 'BOME nº ' || k as title from o where kind <> 'A' and k > 0"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("n_nationkey").alias("id"), F.concat(F.lit(" "), F.col("n_name"), F.lit("  x ")).alias("nombre"))
    return records.entities(table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(item)).alias("json")))


def _retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 100 - 20).cast("string")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Wed, "), F.date_format(F.col("ts") + F.expr("interval 90 seconds"), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    whole = F.date_trunc("second", F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", sc.retry_after_seconds(header, whole).alias("seconds"), sc.utc_text(whole).alias("stamp"))


_RETRY = "select event_id, case event_id % 4 when 0 then cast(greatest(event_id % 100 - 20, 0) as double) when 1 then 90.0::double end as seconds, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') as stamp from events"

QUERIES = {
    "html_to_text": html_to_text,
    "html_title_links": _titles,
    "cve_parse": _cves,
    "spanish_date_parse": _spanish,
    "flexible_date_parse": _flexible,
    "catalogue_label_parse": _labels,
    "result_counter_parse": _counters,
    "http_status_class": _statuses,
    "heading_split": _headings,
    "url_rules": _urls,
    "json_props_extract": _props,
    "calendar_json": _calendar,
    "entities_json": _entities,
    "retry_after_parse": _retry_after,
}

ORACLES = {
    "html_title_links": r"select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) as title, cast(len(regexp_extract_all(html, '<a\s')) as bigint) as links from pages",
    "cve_parse": _CVES,
    "spanish_date_parse": _SPANISH,
    "flexible_date_parse": "select o_orderkey as k, case when o_orderkey % 3 < 2 then cast(o_orderdate as date) end as day from orders",
    "catalogue_label_parse": _LABELS,
    "result_counter_parse": "select o_orderkey as k, cast(1 as bigint) as page, cast(ceil(o_orderkey / 10.0) as bigint) as pages, o_orderkey as total from orders",
    "http_status_class": _STATUSES,
    "heading_split": _HEADINGS,
    "url_rules": _URLS,
    "json_props_extract": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
    "calendar_json": _CALENDAR,
    "entities_json": "select cast(n_nationkey as bigint) as id, n_name || ' x' as name from nation",
    "retry_after_parse": _RETRY,
}
