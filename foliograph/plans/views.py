"""The engine's relations over the driver's tables, as DataFrames and as the same SQL.

Bulletins and calendar are orders, articles are documents (a document belongs
to the order of its number), listed article numbers are labelled documents in
groups of fifty, outcomes of requests are events, catalogues are orders split
by key, page texts are conversation turns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import shared_folder
from ..sources.store import Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "indexado").when(F.col("o_orderstatus") == "O", "sin_sumarios").otherwise("error")
    return table(spark, sf_dir, "orders").select(
        key.alias("bulletin"),
        key.alias("number"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.col("o_orderpriority") == "1-URGENT").alias("extraordinary"),
        state.alias("state"),
        F.when(key % 3 == 0, "old").otherwise("new").alias("origin"),
    )


_stores: dict[tuple, Store] = {}


def _kept(kind: str, make: Callable[[SparkSession, str], Store]) -> Callable[[SparkSession, str], Store]:
    """A store of ``kind`` for the documents of a folder: written once per application, and anew where their files are others than they were."""

    def get(spark: SparkSession, sf_dir: str) -> Store:
        key = (spark.sparkContext.applicationId, kind, sf_dir, stamp(spark, f"{sf_dir}/documents.parquet"))
        if key not in _stores:
            _stores[key] = make(spark, sf_dir)
        return _stores[key]

    return get


def stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = own.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(own)
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def _new(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_folder(spark)}/articles-{uuid.uuid4().hex}")


#: The documents taken in as articles, in one batch.
store = _kept("whole", lambda spark, sf_dir: _new(spark).take_in(raw_articles(spark, sf_dir)))
#: The same with postings.
indexed = _kept("indexed", lambda spark, sf_dir: store(spark, sf_dir).index())


def _appended(spark: SparkSession, sf_dir: str) -> Store:
    """Four batches, the last of which replaces what the first ones had of it; every eleventh document deleted; two segments merged."""
    raw = raw_articles(spark, sf_dir)
    own = _new(spark)
    own.take_in(raw.where("id % 3 = 0").withColumn("summary", F.when(F.col("id") % 5 == 0, F.lit("menta que luego cambia")).otherwise(F.col("summary"))))
    own.take_in(raw.where("id % 3 = 1")).index()
    own.take_in(raw.where("id % 3 = 2")).delete(raw.where("id % 11 = 0"))
    own.take_in(raw.where("id % 15 = 0 and id % 11 <> 0")).index()
    return own.merge(sorted(own.version().segments)[:2])


appended = _kept("appended", _appended)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).articles


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(key.alias("id"), key.alias("bulletin"), key.alias("number"), F.col("text").alias("summary"), F.col("lang").alias("department"), F.col("source").alias("section"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.expr("doc_id div 50").alias("bulletin"), F.col("doc_id").alias("number"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", 500).when(kind == "signup", 503).when(kind == "view", F.lit(None)).otherwise(200)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), "ts", F.col("event_id").alias("seq"), status.cast("int").alias("status"), F.col("value").cast("double").alias("retry_after"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a log of attempts on the bulletins of their part numbers."""
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    outcome = F.when(F.col("l_returnflag") == "A", "indexado").when(F.col("l_returnflag") == "R", "sin_sumarios").otherwise("error")
    status = F.when(F.col("l_linenumber") % 3 == 0, 503).when(F.col("l_linenumber") % 3 == 1, 500).otherwise(F.lit(None))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("bulletin"),
        n.alias("seq"),
        F.when(F.col("l_suppkey") % 4 == 0, "old").otherwise("new").alias("origin"),
        outcome.alias("outcome"),
        F.when(outcome == "error", status).cast("int").alias("status"),
        F.lit(False).alias("blocked"),
        F.lit(None).cast("string").alias("message"),
    )


def page_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.length("text").cast("long").alias("length"))


#: Folding in SQL; equal to ``fold`` on the driver's tables.
SQL_FOLD = "trim(regexp_replace(replace(strip_accents(lower({0})), 'ß', 'ss'), '\\s+', ' ', 'g'))"

WITH = f"""
with bulletins as (
  select o_orderkey as bulletin, o_orderkey as number, cast(o_orderdate as date) as date, o_orderpriority = '1-URGENT' as extraordinary,
    case o_orderstatus when 'F' then 'indexado' when 'O' then 'sin_sumarios' else 'error' end as state,
    case when o_orderkey % 3 = 0 then 'old' else 'new' end as origin
  from orders
), articles as (
  select doc_id as id, doc_id as bulletin, doc_id as number, text as summary, {SQL_FOLD.format('text')} as norm, lang as department, source as section
  from documents
), joined as (
  select a.*, b.number as bulletin_number, b.date, b.extraordinary, b.state, b.origin from articles a join bulletins b using (bulletin)
), listed as (
  select doc_id // 50 as bulletin, doc_id as number from labels
), outcomes as (
  select user_id as site, ts, event_id as seq, case event_type when 'error' then 500 when 'signup' then 503 when 'view' then null else 200 end as status, value as retry_after
  from events
), attempts as (
  select l_partkey as bulletin, l_orderkey * 10 + l_linenumber as seq, case when l_suppkey % 4 = 0 then 'old' else 'new' end as origin,
    case l_returnflag when 'A' then 'indexado' when 'R' then 'sin_sumarios' else 'error' end as outcome,
    case when l_returnflag in ('A', 'R') then null when l_linenumber % 3 = 0 then 503 when l_linenumber % 3 = 1 then 500 end as status
  from lineitem
)
"""
