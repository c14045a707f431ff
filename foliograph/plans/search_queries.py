"""Search, coverage and catalogue queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import contains_folded, fold, phrase_count
from ..operators import coverage, federate, search as s
from ..operators.indexed import search_store
from ..operators.search import Filters
from ..shipping import ship
from .views import SQL_FOLD, WITH, articles, bulletins, indexed, listed, table

PAGE = ["id", "bulletin_number", "date", "extraordinary", "department", "section"]
SQL_PAGE = "id, bulletin_number, date, extraordinary, department, section"
SQL_ORDER = "order by date desc nulls last, bulletin_number desc, number, id"


def _found(terms=(), filters=Filters(), word_start=False):
    """All matching ids with their dates."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return s.matching(articles(spark, sf_dir), bulletins(spark, sf_dir), terms, filters, word_start).select("id", "date", "section")

    return run


def _sql_found(condition: str) -> str:
    return f"{WITH} select id, date, section from joined where {condition}"


def _has(phrase: str) -> str:
    return f"contains(norm, '{phrase}')"


def _page(terms=(), filters=Filters(), **how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if how.get("order") == "relevance":
            return search_store(indexed(spark, sf_dir), bulletins(spark, sf_dir), terms, filters, **how).select(*PAGE, F.round("score", 6).alias("score"))
        return s.search(articles(spark, sf_dir), bulletins(spark, sf_dir), terms, filters, **how).select(*PAGE)

    return run


def _sql_page(condition: str, limit: int = 20, offset: int = 0) -> str:
    return f"{WITH} select {SQL_PAGE} from joined where {condition} {SQL_ORDER} limit {limit} offset {offset}"


def _sql_tf(phrase: str) -> str:
    n = len(phrase)
    return f"len(list_filter(range(1, greatest(length(norm) - {n} + 2, 1)), lambda i: substr(norm, i, {n}) = '{phrase}'))"


def _sql_bm25(phrases: list[str], condition: str) -> str:
    df = ", ".join(f"cast(count(*) filter ({_has(p)}) as double) as df{k}" for k, p in enumerate(phrases))
    tf = ", ".join(f"cast({_sql_tf(p)} as double) as tf{k}" for k, p in enumerate(phrases))
    idf = lambda k: f"case when ln((n - df{k} + 0.5) / (df{k} + 0.5)) > 0 then ln((n - df{k} + 0.5) / (df{k} + 0.5)) else 1e-6 end"
    score = " + ".join(f"({idf(k)}) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * greatest(length(norm) - 2, 0) / mean))" for k in range(len(phrases)))
    return (
        f"{WITH}, stats as (select cast(count(*) as double) as n, avg(greatest(length(norm) - 2, 0)) as mean, {df} from articles where norm <> ''), "
        f"scored as (select *, -({score}) as raw from (select *, {tf} from joined where {condition}), stats) "
        f"select {SQL_PAGE}, round(raw, 6) as score from scored order by raw, date desc nulls last, bulletin_number desc, number, id limit 20"
    )


def term(text: str, operator: str = "and", mode: str = "has") -> dict[str, str]:
    return {"text": text, "operator": operator, "mode": mode}


FLAGSHIP = [term("tión"), term("que", mode="lacks"), term("ción", operator="or")]
_FLAGSHIP_SQL = f"norm <> '' and (({_has('tion')} and not {_has('que')}) or {_has('cion')})"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.search(articles(spark, sf_dir), bulletins(spark, sf_dir), FLAGSHIP).select(*PAGE)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.total(s.matching(articles(spark, sf_dir), bulletins(spark, sf_dir), FLAGSHIP))


#: The same text in other forms: letters apart from their accents, full width, ligatures, invisible characters, other spaces.
WRITTEN = (("á", "a\u0301"), ("e", "\uff45"), ("fi", "\ufb01"), ("t", "t\u00ad"), ("n ", "n\u3000"), ("o", "\u014f"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as another hand would have typed them fold to what the texts fold to."""
    text = F.col("text")
    for k, (plain, other) in enumerate(WRITTEN):
        text = F.when(F.col("doc_id") % 7 == k, F.replace(text, F.lit(plain), F.lit(other))).otherwise(text)
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", fold(text).alias("folded"))


def _found_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searching texts with ligatures, soft hyphens and full width letters."""
    text = F.replace(F.replace(F.replace("text", F.lit("c"), F.lit("\uff43")), F.lit("fi"), F.lit("\ufb01")), F.lit("i"), F.lit("i\u00ad"))
    ship(spark)
    return table(spark, sf_dir, "documents").where(contains_folded(text, "CIÓN")).select("doc_id")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("folded"))


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("id", *(phrase_count(F.col("norm"), p).cast("long").alias(n) for n, p in (("tf_en", "en"), ("tf_anan", "anan"))))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.search(articles(spark, sf_dir), bulletins(spark, sf_dir), FLAGSHIP, highlight=True, limit=200).select("id", "marked")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = indexed(spark, sf_dir)
    return s.through_postings(own.articles, own.postings, "menta").select("id", "section")


def _on_bulletins(make, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = make(bulletins(spark, sf_dir))
        return found.select(*columns) if columns else found

    return run


def _calendar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders are the calendar; every seventh isn't in the index."""
    every = bulletins(spark, sf_dir)
    return every.select("bulletin", "number", "date"), every.where("bulletin % 7 <> 0")


_CALENDAR = f"{WITH}, known as (select * from bulletins where bulletin % 7 <> 0), pending as (select c.bulletin, c.number, c.date, k.state from bulletins c left join known k using (bulletin) where k.state is null or k.state = 'error')"
CUT = date(1995, 1, 1)


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage(*_calendar(spark, sf_dir), CUT)


def _catalogues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = bulletins(spark, sf_dir)
    return every.where("bulletin % 3 <> 0").withColumn("origin", F.lit("new")), every.where("bulletin % 3 <> 1").withColumn("origin", F.lit("old"))


_CATALOGUES = f"{WITH}, first as (select * replace ('new' as origin) from bulletins where bulletin % 3 <> 0), second as (select * replace ('old' as origin) from bulletins where bulletin % 3 <> 1), merged as (select * from first union all select * from second where bulletin not in (select bulletin from first))"


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federate.merged_catalogue(*_catalogues(spark, sf_dir)).select("bulletin", "date", "origin")


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federate.newest(federate.merged_catalogue(*_catalogues(spark, sf_dir))).select("bulletin", "date", "origin")


def _streams_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two queries."""
    hits = None
    for k, phrase in enumerate(("cion", "tion")):
        own = s.matching(articles(spark, sf_dir), bulletins(spark, sf_dir), [phrase]).select("bulletin", "date", "number", F.lit(k).alias("stream"), F.lit(0).alias("page"), F.col("id").alias("pos"))
        hits = own if hits is None else hits.unionByName(own)
    return hits


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federate.merged_streams(_streams_of(spark, sf_dir)).orderBy(*federate.newest_first()).select("bulletin", "date", "stream")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federate.numbering_gaps(listed(spark, sf_dir))


_GAPS = f"{WITH}, gaps as (select bulletin, unnest(range(lo, hi + 1)) as hidden from (select bulletin, min(number) as lo, max(number) as hi from listed group by bulletin) except select bulletin, number from listed)"


def _too_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federate.too_many_gaps(_gaps(spark, sf_dir))


def _drill(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """Orders in sixty groups as bulletins, matches of a phrase in them."""
    group = (F.col("bulletin") % 60).alias("bulletin")
    grouped = bulletins(spark, sf_dir).groupBy(group).agg(F.max("date").alias("date"), F.max("number").alias("number"), (F.min("bulletin") % 7 == 0).alias("failed"))
    rows = s.matching(articles(spark, sf_dir), bulletins(spark, sf_dir), ["cion"]).select(group, "number", "id")
    return federate.drill_down(grouped, rows, 40, 50)[part]


_DRILL = f"""{WITH}, grouped as (
  select bulletin % 60 as bulletin, max(date) as date, max(number) as number, min(bulletin) % 7 = 0 as failed from bulletins group by 1
), found as (select bulletin % 60 as bulletin, number, id from joined where contains(norm, 'cion')
), ranked as (
  select *, row_number() over w as k, coalesce(sum(n) over (w rows between unbounded preceding and 1 preceding), 0) as before
  from (select g.*, case when g.failed then 0 else coalesce(f.n, 0) end as n from grouped g left join (select bulletin, count(*) as n from found group by 1) f using (bulletin))
  window w as (order by date desc nulls last, number desc, bulletin)
), opened as (select * from ranked where k <= 40 and before < 50)
"""


def _drill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drill(spark, sf_dir, 0).select("bulletin", "id", F.col("place").cast("long").alias("place"))


def _drill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drill(spark, sf_dir, 1)


_SINCE, _UNTIL = date(1995, 1, 1), date(1996, 12, 31)
_RANGE = "date between date '1995-01-01' and date '1996-12-31'"

QUERIES = {
    "search_flagship": flagship,
    "search_fragment": _found(["ción"]),
    "search_word_start": _found(["and"], word_start=True),
    "search_and": _found([term("tion"), term("que")]),
    "search_or_groups": _found(FLAGSHIP),
    "search_not": _found([term("tion"), term("the", mode="lacks")]),
    "search_pure_negation": _found([term("the", mode="lacks")]),
    "search_short_term": _found(["de"]),
    "search_trailing_star": _found(["menta*"]),
    "search_no_terms": _page(limit=200),
    "filter_date_range": _found(["cion"], Filters(_SINCE, _UNTIL)),
    "filter_extraordinary": _found(["cion"], Filters(extraordinary=True)),
    "filter_section": _found([], Filters(section="SRC1")),
    "filter_state": _found(["cion"], Filters(state="error")),
    "search_bm25": _page(["cion"], order="relevance"),
    "search_bm25_multi": _page([term("cion"), term("entre", operator="or"), term("que", mode="lacks")], order="relevance"),
    "search_date_order_page": _page(["cion"]),
    "search_page_offset": _page(["cion"], limit=20, offset=40),
    "search_total": _totals,
    "search_postings": _postings,
    "normalize_fold": _folded,
    "normalize_other_forms": _written,
    "search_other_forms": _found_written,
    "phrase_tf_overlapping": _tf,
    "highlight": _marked,
    "status_counts": _on_bulletins(coverage.by_state),
    "status_counts_by_origin": _on_bulletins(lambda b: coverage.by_state(b, "origin")),
    "date_span_by_origin": _on_bulletins(lambda b: coverage.date_span(b, "origin")),
    "articles_with_text": lambda spark, sf_dir: coverage.with_text(articles(spark, sf_dir), "section"),
    "coverage": _coverage,
    "status_snapshot": lambda spark, sf_dir: coverage.snapshot(*_calendar(spark, sf_dir), articles(spark, sf_dir)).select("processed", F.to_json("origins").alias("origins"), F.col("articles.n").alias("n_articles"), F.col("articles.with_text").alias("with_text")),
    "pending_calendar": lambda spark, sf_dir: coverage.pending(*_calendar(spark, sf_dir)).select("bulletin", "date", "state"),
    "pending_before_cutoff": lambda spark, sf_dir: coverage.pending_counts(*_calendar(spark, sf_dir), CUT),
    "catalog_union_anti": _merged,
    "catalog_newest_500": _newest,
    "merge_dedupe_newest": _streams,
    "numbering_gaps": _gaps,
    "numbering_gaps_capped": lambda spark, sf_dir: federate.fetchable_gaps(_gaps(spark, sf_dir)),
    "numbering_gaps_dead_letters": _too_many,
    "drilldown_budget": _drill_rows,
    "drilldown_summary": _drill_summary,
}

ORACLES = {
    "search_flagship": _sql_page(_FLAGSHIP_SQL),
    "search_fragment": _sql_found(f"norm <> '' and {_has('cion')}"),
    "search_word_start": _sql_found("norm <> '' and regexp_matches(norm, '(^|[^\\p{L}\\p{N}])and')"),
    "search_and": _sql_found(f"norm <> '' and {_has('tion')} and {_has('que')}"),
    "search_or_groups": _sql_found(_FLAGSHIP_SQL),
    "search_not": _sql_found(f"norm <> '' and {_has('tion')} and not {_has('the')}"),
    "search_pure_negation": _sql_found(f"norm <> '' and not {_has('the')}"),
    "search_short_term": _sql_found(f"norm <> '' and {_has('de')}"),
    "search_trailing_star": _sql_found(f"norm <> '' and {_has('menta')}"),
    "search_no_terms": _sql_page("true", 200),
    "filter_date_range": _sql_found(f"{_has('cion')} and {_RANGE}"),
    "filter_extraordinary": _sql_found(f"{_has('cion')} and extraordinary"),
    "filter_section": _sql_found("contains(lower(section), 'src1')"),
    "filter_state": _sql_found(f"{_has('cion')} and state = 'error'"),
    "search_bm25": _sql_bm25(["cion"], _has("cion")),
    "search_bm25_multi": _sql_bm25(["cion", "entre"], f"{_has('cion')} or ({_has('entre')} and not {_has('que')})"),
    "search_date_order_page": _sql_page(_has("cion")),
    "search_page_offset": _sql_page(_has("cion"), 20, 40),
    "search_total": f"{WITH} select count(*) as total, case when count(*) > 20 then cast(20 as bigint) end as next_offset from joined where {_FLAGSHIP_SQL}",
    "search_postings": f"{WITH} select id, section from articles where {_has('menta')}",
    "normalize_fold": f"select doc_id, {SQL_FOLD.format('text')} as folded from documents",
    "normalize_other_forms": f"select doc_id, {SQL_FOLD.format('text')} as folded from documents",
    "search_other_forms": f"select doc_id from documents where contains({SQL_FOLD.format('text')}, 'cion')",
    "phrase_tf_overlapping": f"{WITH} select id, cast({_sql_tf('en')} as bigint) as tf_en, cast({_sql_tf('anan')} as bigint) as tf_anan from articles",
    "status_counts": f"{WITH} select " + ", ".join(f"count(*) filter (state = '{x}') as {x}" for x in coverage.STATES) + ", count(*) as total from bulletins",
    "status_counts_by_origin": f"{WITH} select origin, " + ", ".join(f"count(*) filter (state = '{x}') as {x}" for x in coverage.STATES) + ", count(*) as total from bulletins group by origin",
    "date_span_by_origin": f"{WITH} select origin, count(*) as n, min(date) as first_date, max(date) as last_date from bulletins group by origin",
    "articles_with_text": f"{WITH} select section, count(*) filter (trim(coalesce(summary, '')) <> '') as with_text, count(*) as n from articles group by section",
    "coverage": f"{_CALENDAR} select count(*) as processed, min(date) as first_date, max(date) as last_date, (select count(*) from pending where date is null or date >= date '1995-01-01') as pending, (select count(*) from pending where date < date '1995-01-01') as pending_before, (select count(*) from known where state = 'roto') as broken from known where state in ('indexado', 'sin_sumarios')",
    "status_snapshot": f"""{_CALENDAR}, per as (select origin, {', '.join(f"count(*) filter (state = '{x}') as {x}" for x in coverage.STATES)}, count(*) as total from known group by origin)
select (select count(*) from known where state in ('indexado', 'sin_sumarios')) as processed,
  (select '[' || string_agg('{{"origin":"' || origin || '"' {' '.join(f"""|| ',"{x}":' || {x}""" for x in (*coverage.STATES, 'total'))} || '}}', ',' order by origin) || ']' from per) as origins,
  (select count(*) from articles) as n_articles, (select count(*) from articles where trim(coalesce(summary, '')) <> '') as with_text""",
    "pending_calendar": f"{_CALENDAR} select bulletin, date, state from pending",
    "pending_before_cutoff": f"{_CALENDAR} select count(*) filter (date is null or date >= date '1995-01-01') as pending, count(*) filter (date < date '1995-01-01') as pending_before from pending",
    "catalog_union_anti": f"{_CATALOGUES} select bulletin, date, origin from merged",
    "catalog_newest_500": f"{_CATALOGUES} select bulletin, date, origin from merged order by date desc nulls last, number desc, bulletin limit 500",
    "merge_dedupe_newest": f"{WITH} select bulletin, date, min(stream) as stream from (select bulletin, date, 0 as stream from joined where {_has('cion')} union all select bulletin, date, 1 from joined where {_has('tion')}) group by bulletin, date",
    "numbering_gaps": f"{_GAPS} select bulletin, hidden from gaps",
    "numbering_gaps_capped": f"{_GAPS} select bulletin, hidden from gaps qualify row_number() over (partition by bulletin order by hidden) <= 20",
    "numbering_gaps_dead_letters": f"{_GAPS} select bulletin, count(*) as missing, 'demasiados_huecos' as error_code, 'articulo' as stage from gaps group by bulletin having count(*) > 20",
    "drilldown_budget": f"{_DRILL} select bulletin, id, cast(place as bigint) as place from (select f.bulletin, f.id, o.before + row_number() over (partition by f.bulletin order by f.number, f.id) as place from found f join opened o using (bulletin) where not o.failed) where place <= 50",
    "drilldown_summary": f"{_DRILL} select count(*) filter (k <= 40 and before < 50) as reviewed, count(*) filter (k <= 40 and before < 50 and not failed and n = 0) as without_match, count(*) filter (k <= 40 and before < 50 and failed) as failed, case when max(case when k <= 40 then before + n end) > 50 or bool_or(k <= 40 and before >= 50) then 'max_articulos' when max(k) > 40 then 'max_bomes' end as reason from ranked where k <= 41",
}
