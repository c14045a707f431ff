"""Queries that a store's postings answer, over one segment and over several that were appended to, deleted from and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.indexed import matching_articles, phrase_hits, search_store
from ..sources.store import KEY, gram_text
from .search_queries import FLAGSHIP, PAGE, _FLAGSHIP_SQL, _has, _sql_bm25, _sql_found, _sql_tf, term
from .views import WITH, appended, bulletins, indexed

PHRASES = ("menta", "anan", "on the", "cion")
#: What is in the store that was appended to.
LEFT = WITH.replace("from documents\n", "from documents where doc_id % 11 <> 0\n")


def _found(terms, word_start: bool = False, store=indexed):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching_articles(store(spark, sf_dir), bulletins(spark, sf_dir), terms, word_start=word_start).select("id", "date", "section")

    return run


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = indexed(spark, sf_dir)
    counts = [F.col(f"tf{k}").cast("long").alias(f"tf{k}") for k in range(len(PHRASES))]
    return phrase_hits(own, PHRASES).join(own.articles.select(*KEY, "id"), KEY).select("id", *counts)


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_store(appended(spark, sf_dir), bulletins(spark, sf_dir), ["cion", term("entre", "or")], order="relevance").select(*PAGE, F.round("score", 6).alias("score"))


def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).grams.groupBy("gram").agg(F.sum("texts").alias("texts"), F.max("most").cast("long").alias("most")).select(gram_text(F.col("gram")).alias("gram"), "texts", "most")


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appended(spark, sf_dir).statistics.select(F.col("n").cast("long").alias("n"), F.round("mean", 6).alias("mean"))


QUERIES = {
    "index_phrase_counts": _phrases,
    "index_word_start": _found(["and"], True),
    "index_or_groups": _found(FLAGSHIP),
    "index_pure_negation": _found([term("the", mode="lacks")]),
    "index_grams": _grams,
    "index_appended_matches": _found(FLAGSHIP, store=appended),
    "index_appended_bm25": _page,
    "index_appended_statistics": _statistics,
}

ORACLES = {
    "index_phrase_counts": f"{WITH} select * from (select id, {', '.join(f'cast({_sql_tf(p)} as bigint) as tf{k}' for k, p in enumerate(PHRASES))} from articles) where tf0 + tf1 + tf2 + tf3 > 0",
    "index_word_start": _sql_found("norm <> '' and regexp_matches(norm, '(^|[^\\p{L}\\p{N}])and')"),
    "index_or_groups": _sql_found(_FLAGSHIP_SQL),
    "index_pure_negation": _sql_found(f"norm <> '' and not {_has('the')}"),
    "index_grams": f"{WITH} select gram, count(*) as texts, max(n) as most from (select id, gram, count(*) as n from (select id, unnest(list_transform(range(1, length(norm) - 1), lambda i: substr(norm, i, 3))) as gram from articles where length(norm) >= 3) group by id, gram) group by gram",
    "index_appended_matches": f"{LEFT} select id, date, section from joined where {_FLAGSHIP_SQL}",
    "index_appended_bm25": _sql_bm25(["cion", "entre"], f"{_has('cion')} or {_has('entre')}").replace(WITH, LEFT),
    "index_appended_statistics": f"{LEFT} select count(*) as n, round(avg(greatest(length(norm) - 2, 0)), 6) as mean from articles where norm <> ''",
}
