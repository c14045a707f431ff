"""Lookup, listing and local-filter queries."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import browse
from .views import WITH, articles, bulletins, listed, table

SINCE, UNTIL = date(1996, 1, 1), date(1996, 6, 30)
#: Lines that a task joins and sorts, about: tasks become more with the table, not larger.
TASK_LINES = 1 << 20


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are listed, the others hidden; a section's id is its number."""
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("bulletin"), F.col("doc_id").alias("number"), F.upper("source").alias("section"), F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("section_id"))
    shown = listed(spark, sf_dir).select("number")
    return browse.of_section(docs.join(shown, "number", "left_semi"), docs.join(shown, "number", "left_anti"), 3)


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("BOME-B-2000-"), F.expr("o_orderkey div 3").cast("string")).alias("cve"), F.col("o_orderkey").alias("record"))


def _listing(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    every = bulletins(spark, sf_dir)
    return browse.listing(every.where("bulletin % 3 <> 0"), every.where("bulletin % 3 <> 1"), SINCE, UNTIL)[part]


_LISTING = f"{WITH}, rows as (select * from bulletins where date between date '1996-01-01' and date '1996-06-30')"


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as links: orders are records, parts their identifiers, supply years the headers."""
    year = F.year("l_shipdate")
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("date"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines.count() / TASK_LINES))
    links = lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "l_orderkey"), "l_orderkey")
    cve = F.when(F.col("l_quantity") > 2, (F.col("l_partkey") % 3).cast("string"))
    return browse.catalogue_warnings(links.select((F.col("l_partkey") * 100_000_000 + F.col("l_suppkey") * 10_000 + F.col("l_linenumber")).alias("pos"), F.col("l_orderkey").alias("record"), cve.alias("cve"), "date", year.alias("header_year")))


_WARNINGS = """with links as (select l_partkey * 100000000 + l_suppkey * 10000 + l_linenumber as pos, l_orderkey as record, case when l_quantity > 2 then l_partkey % 3 end as cve, cast(o_orderdate as date) as date, cast(year(l_shipdate) as int) as header_year from lineitem join orders on l_orderkey = o_orderkey)
select 'unreadable' as kind, record, cast(null as int) as year, cast(1 as bigint) as n from links where cve is null
union all select 'conflict', record, null, count(distinct cve) from links where cve is not null group by record having count(distinct cve) > 1
union all select 'misfiled', null, header_year, count(*) from (select * from links where cve is not null qualify row_number() over (partition by record order by pos) = 1) where header_year <> year(date) group by header_year"""


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as the pages of a conversation's page, assistant turns as those of its PDF."""
    turns = table(spark, sf_dir, "conversations")
    own = turns.groupBy(F.col("conv_id").alias("id")).agg(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.when((t["role"] == "user") & (t["turn"] % 4 != 0), F.struct(t["text"].alias("text")))), lambda t: t.isNotNull()).alias("pages"))
    pdf = turns.where("role = 'assistant'").select(F.col("conv_id").alias("id"), F.col("turn").alias("page"), "text")
    found = browse.readable_text(own, pdf)
    return found.select("id", "origin", F.size("texts").cast("long").alias("pages"))


_READABLE = "with t as (select conv_id as id, count(*) filter (role = 'user' and turn % 4 <> 0 and trim(text) <> '') as own, count(*) filter (role = 'user' and turn % 4 <> 0) as n, count(*) filter (role = 'assistant') as pdf from conversations group by 1) select id, case when own > 0 then 'html' when pdf > 0 then 'pdf' else 'none' end as origin, case when own > 0 then n when pdf > 0 then pdf else 0 end as pages from t"

QUERIES = {
    "bulletin_state": lambda spark, sf_dir: bulletins(spark, sf_dir).where("bulletin = 7").select("bulletin", "state"),
    "states_of_origin": lambda spark, sf_dir: browse.states(bulletins(spark, sf_dir), "old"),
    "bulletin_of_article": lambda spark, sf_dir: browse.bulletin_of_article(articles(spark, sf_dir), bulletins(spark, sf_dir), F.lit(7)),
    "catalogue_lookup": lambda spark, sf_dir: browse.lookup(_catalogue(spark, sf_dir), cve="BOME-B-2000-5"),
    "exact_numbers": lambda spark, sf_dir: browse.exactly(bulletins(spark, sf_dir), year=1996).select("bulletin", "date"),
    "listing_of_catalogues": lambda spark, sf_dir: _listing(spark, sf_dir, 0).select("bulletin", "date"),
    "listing_totals": lambda spark, sf_dir: _listing(spark, sf_dir, 1),
    "section_with_hidden": _sections,
    "catalogue_warnings": _warnings,
    "readable_text_fallback": _readable,
}

ORACLES = {
    "bulletin_state": f"{WITH} select bulletin, state from bulletins where bulletin = 7",
    "states_of_origin": f"{WITH} select bulletin, state from bulletins where origin = 'old'",
    "bulletin_of_article": f"{WITH} select bulletin from joined where id = 7 and origin = 'new'",
    "catalogue_lookup": "select 'BOME-B-2000-5' as cve, o_orderkey as record from orders where o_orderkey // 3 = 5",
    "exact_numbers": f"{WITH} select bulletin, date from bulletins where year(date) = 1996",
    "listing_of_catalogues": f"{_LISTING} select bulletin, date from rows order by date desc nulls last, number desc, bulletin limit 500",
    "listing_totals": f"{_LISTING} select count(*) as total, count(*) > 500 as truncated, false as degraded from rows",
    "section_with_hidden": "with docs as (select doc_id // 50 as bulletin, doc_id as number, upper(source) as section, doc_id in (select doc_id from labels) as listed from documents) select bulletin, number, section, listed from docs d where section = 'SRC3' and (listed or exists (select 1 from docs e where e.bulletin = d.bulletin and e.listed and e.section = 'SRC3'))",
    "catalogue_warnings": _WARNINGS,
    "readable_text_fallback": _READABLE,
}
