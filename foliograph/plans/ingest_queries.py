"""Ingestion, planning, location, guard and paging queries."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import guard, ingest, locate, paging
from ..shipping import shared_folder
from ..sources.states import StateTable
from .views import WITH, attempts, bulletins, listed, outcomes, page_lengths, table

TODAY = date(1998, 1, 1)


def _fold(spark: SparkSession, sf_dir: str, single: bool) -> DataFrame:
    log = attempts(spark, sf_dir)
    if single:
        log = log.withColumn("origin", F.lit("new"))
    return ingest.current_state(log).select("bulletin", "origin", "state", "failures", "status", "stored_seq")


#: The fold as recursive SQL: attempts of a bulletin one after another.
def _sql_fold(origin: str) -> str:
    rank = lambda c: f"case {c} when 'indexado' then 2 when 'sin_sumarios' then 1 else 0 end"
    return f"""{WITH.replace('with bulletins', 'with recursive bulletins')}, log as (
  select bulletin, seq, {origin} as origin, outcome, status, row_number() over (partition by bulletin order by seq) as k,
    coalesce(status between 500 and 599 and status <> 503, false) as broken
  from attempts
), fold as (
  select bulletin, k, origin, case when outcome = 'error' then 'error' else outcome end as state,
    case when outcome = 'error' and broken then 1 else 0 end as failures, status, case when outcome <> 'error' then seq end as stored_seq
  from log where k = 1
  union all
  select bulletin, k, case when ignored then o else n end, case when ignored then old_state when outcome <> 'error' then outcome when done_before then old_state when new_failures >= 2 then 'roto' else 'error' end,
    case when ignored then old_failures when outcome <> 'error' then 0 else new_failures end,
    case when ignored then old_status else status end,
    case when ignored then old_stored when outcome <> 'error' then seq when done_before then old_stored end
  from (
    select *, not fresh and not ignored and old_state in ('indexado', 'sin_sumarios') as done_before, case when fresh then 0 else old_failures end + case when broken then 1 else 0 end as new_failures
    from (
      select l.*, l.origin as n, f.origin as o, f.state as old_state, f.failures as old_failures, f.status as old_status, f.stored_seq as old_stored,
        l.origin <> f.origin and not (case when l.outcome = 'error' then l.origin = 'new' and {rank('f.state')} = 0
          else {rank('l.outcome')} > {rank('f.state')} or ({rank('l.outcome')} = {rank('f.state')} and l.origin = 'new') end) as ignored,
        l.origin <> f.origin as fresh
      from fold f join log l on l.bulletin = f.bulletin and l.k = f.k + 1)))
select bulletin, origin, state, failures, status, stored_seq from fold qualify k = max(k) over (partition by bulletin)
"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known: orders but every seventh, with one in eleven given up."""
    return bulletins(spark, sf_dir).where("bulletin % 7 <> 0").withColumn("state", F.when(F.col("bulletin") % 11 == 0, "roto").otherwise(F.col("state")))


_STATES = f"{WITH}, known as (select * replace (case when bulletin % 11 = 0 then 'roto' else state end as state) from bulletins where bulletin % 7 <> 0)"
_PLAN = f"{_STATES}, plan as (select c.bulletin, c.number, c.date, k.state from bulletins c left join known k using (bulletin) where k.state is distinct from 'roto' and (k.state is null or c.date >= date '1997-12-25' or k.state = 'error'))"


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.plan(bulletins(spark, sf_dir).select("bulletin", "number", "date"), _states(spark, sf_dir), TODAY)


def _plan_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.plan_old(bulletins(spark, sf_dir).select("bulletin", "number", "date"), _states(spark, sf_dir)).select("bulletin", "date", "state")


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ingest.run_counters(attempts(spark, sf_dir).withColumn("run", F.expr("seq div 1000")), "run")
    return runs.select("*", ingest.remaining_seconds(F.col("done") * 2.5, F.col("done"), F.lit(250)).alias("eta"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article versions: each line item is an attempt's article; its identifier is shared by bulletins."""
    return attempts(spark, sf_dir).select("bulletin", "seq", F.lit(0).alias("pos"), F.expr("seq div 20").alias("article"))


def _standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ingest.current_state(attempts(spark, sf_dir).withColumn("origin", F.lit("new")))
    return ingest.current_articles(_versions(spark, sf_dir), states).select("article", "bulletin", "seq")


def _events(spark: SparkSession, sf_dir: str, pick) -> DataFrame:
    return pick(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys of an old catalogue: customers' nations as identifiers, their numbers as record ids."""
    from pyspark.sql.window import Window

    from ..functions.identifiers import catalogue_key, synthetic_article_key

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"), F.concat(F.lit("BOME-B-2000-"), F.expr("c_custkey div 2").cast("string")).alias("cve"), F.col("c_nationkey").cast("long").alias("number"))
    times = F.count("*").over(Window.partitionBy("cve")) > 1
    order = F.row_number().over(Window.partitionBy("number").orderBy("record"))
    return rows.select("record", catalogue_key(F.col("cve"), F.col("record"), times).alias("key"), synthetic_article_key(F.lit(7), F.col("number"), order).alias("article_key"))


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.federate import repeated

    return repeated(table(spark, sf_dir, "customer"), "c_nationkey")


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"))
    return locate.locate(targets, locate.spans(listed(spark, sf_dir)))


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ranges that crowd in one corner, and one far away; documents' numbers as targets."""
    key, lo = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_orderkey") % 3000
    ranges = table(spark, sf_dir, "lineitem").select(key.alias("bulletin"), lo.alias("lo"), (lo + F.col("l_linenumber") % 2).alias("hi"))
    far = spark.range(1).select(F.lit(10**15).alias("bulletin"), F.lit(10**12).alias("lo"), F.lit(10**12).alias("hi"))
    targets = table(spark, sf_dir, "documents").select((F.col("doc_id") * 4 - 100).alias("number"))
    return locate.locate(targets, ranges.unionByName(far))


_CROWDED = """with spans as (select l_orderkey * 10 + l_linenumber as bulletin, l_orderkey % 3000 as lo, l_orderkey % 3000 + l_linenumber % 2 as hi from lineitem union all select 1000000000000000, 1000000000000, 1000000000000),
asked as (select doc_id * 4 - 100 as number from documents),
holders as (select number, arg_max(bulletin, (hi, bulletin)) as holder from asked join spans on number between lo and hi group by number)
select number, holder, case when holder is null then (select max(bulletin) from spans where hi < number) end as below, case when holder is null then (select min(bulletin) from spans where lo > number) end as above
from asked left join holders using (number)"""


def _from_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States folded batch by batch, as a stream's batches come, the second of them twice."""
    log = attempts(spark, sf_dir)
    own = StateTable(spark, f"{shared_folder(spark)}/states-{uuid.uuid4().hex}", buckets=8)
    quarter = F.floor(F.percent_rank().over(Window.partitionBy("bulletin").orderBy("seq")) * 3).cast("int")
    parts = log.withColumn("batch", quarter)
    for batch in (0, 1, 1, 2, 3):
        own.take_in(parts.where(F.col("batch") == batch).drop("batch"), batch)
    return own.vacuum().states.select("bulletin", "origin", "state", "failures", "status", "stored_seq")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("bulletin")).distinct()
    empty = every.join(listed(spark, sf_dir).select("bulletin").distinct(), "bulletin", "left_anti")
    return locate.candidates(_located(spark, sf_dir), empty).select("number", "bulletin", F.col("turn").cast("long").alias("turn"))


_LOCATED = f"""{WITH}, spans as (select bulletin, min(number) as lo, max(number) as hi from listed group by bulletin), located as (
  select d.doc_id as number, h.bulletin as holder,
    case when h.bulletin is null then (select max(bulletin) from spans where hi < d.doc_id) end as below,
    case when h.bulletin is null then (select min(bulletin) from spans where lo > d.doc_id) end as above
  from documents d left join spans h on d.doc_id between h.lo and h.hi)"""
_CANDIDATES = f"""{_LOCATED}, unlisted as (select distinct doc_id // 50 as b from documents where doc_id // 50 not in (select bulletin from listed)), tries as (
  select number, holder as bulletin, 0 as grade from located where holder is not null
  union all select l.number, u.b, 1 from located l join unlisted u on (l.below is null or u.b > l.below) and (l.above is null or u.b < l.above) where l.holder is null
  union all select number, below, 2 from located where holder is null and below is not null
  union all select number, above, 3 from located where holder is null and above is not null)"""


def _chunk_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.first_chunk(page_lengths(spark, sf_dir), budget=1500)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.all_chunks(page_lengths(spark, sf_dir), budget=1500)


def _leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = table(spark, sf_dir, "events").select(F.col("event_type").alias("owner"), "ts")
    return guard.lease_sessions(beats)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lives by Spark's own session windows."""
    beats = table(spark, sf_dir, "events").select(F.col("event_type").alias("owner"), "ts")
    lives = beats.groupBy("owner", F.session_window("ts", "180 seconds").alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("last_beat"), F.count("*").alias("beats"))
    return lives.drop("w")


_LIVES = """with b as (select event_type as owner, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over w <= 180000000 then 0 else 1 end as fresh from events window w as (partition by event_type order by ts)),
n as (select *, sum(fresh) over (partition by owner order by ts rows unbounded preceding) as life from b)
select owner, min(ts) as started, max(ts) as last_beat, count(*) as beats from n group by owner, life"""

_CLOSINGS = f"""{WITH}, marked as (
  select *, sum(case when status is null then 0 else 1 end) over (partition by site order by ts, seq rows unbounded preceding) as island from outcomes
), streaks as (
  select *, case when status is null then sum(case when status is null then 1 else 0 end) over (partition by site, island order by ts, seq rows unbounded preceding) else 0 end as streak from marked
), closings as (
  select site, ts, seq, status, streak, case when status = 503 then greatest(coalesce(case when retry_after > 0 then least(retry_after, 86400) end, 0), 4500) else 4500 end as for_seconds
  from streaks where status = 503 or (status is null and streak % 2 = 0)
), deadlines as (
  select *, make_timestamp(cast(epoch_us(ts) + for_seconds * 1000000 as bigint)) as own, case when status = 503 then 'HTTP 503' else 'no_answer' end as own_cause from closings
)"""

#: Greedy cutting as recursive SQL: what a chunk holds after each page, and the pieces that a page is cut into.
_CHUNKS = """with recursive p as (select conv_id as doc, turn as page, cast(length(text) as bigint) as n, row_number() over (partition by conv_id order by turn) as k from conversations where turn is not null), fold as (
  select doc, k, page, n, n <= 1500 as fits, 1 as start, 1 + case when n <= 1500 then 0 else cast(ceil(n / 1500.0) as int) - 1 end as chunk, case when n <= 1500 then n when n % 1500 = 0 then 1500 else n % 1500 end as used from p where k = 1
  union all
  select doc, k, page, n, fits, start, case when fits then chunk else start + greatest(cast(ceil(n / 1500.0) as int) - 1, 0) end, case when fits then used + n when n % 1500 = 0 then case when n > 0 then 1500 else 0 end else n % 1500 end
  from (select l.doc, l.k, l.page, l.n, f.chunk, f.used, l.n <= 1500 - f.used or (f.used = 0 and l.n <= 1500) as fits, case when f.used = 0 then f.chunk else f.chunk + 1 end as start from fold f join p l on l.doc = f.doc and l.k = f.k + 1))
select doc, cast(case when fits then chunk else start + i end as int) as chunk, page, i * 1500 as start, case when fits then n else least(1500, n - i * 1500) end as taken
from (select *, unnest(range(case when fits then 1 else greatest(cast(ceil(n / 1500.0) as bigint), 1) end)) as i from fold)"""

QUERIES = {
    "failure_state_fold": lambda spark, sf_dir: _fold(spark, sf_dir, True),
    "origin_precedence": lambda spark, sf_dir: _fold(spark, sf_dir, False),
    "standing_articles": _standing,
    "last_write_wins": lambda spark, sf_dir: _events(spark, sf_dir, ingest.latest_by_key),
    "first_write_wins": lambda spark, sf_dir: _events(spark, sf_dir, ingest.first_by_key),
    "sync_plan": lambda spark, sf_dir: _plan(spark, sf_dir).select("bulletin", "date", "state"),
    "sync_plan_old": _plan_old,
    "sync_plan_cap": lambda spark, sf_dir: ingest.capped(_plan(spark, sf_dir)).select("bulletin", "date", "state"),
    "sync_plan_deferred": lambda spark, sf_dir: ingest.deferred(_plan(spark, sf_dir)),
    "run_counters_eta": _counters,
    "catalogue_keys": _keys,
    "repeated_keys": _repeated,
    "range_locate": _located,
    "range_locate_crowded": _crowded,
    "state_from_batches": _from_batches,
    "neighbour_locate": _candidates,
    "error_budget_window": lambda spark, sf_dir: guard.errors_in_window(outcomes(spark, sf_dir)).select("site", "seq", "errors"),
    "error_budget_wait": lambda spark, sf_dir: guard.budget_wait(outcomes(spark, sf_dir), 86_400).select("site", "seq", F.round("wait_seconds", 3).alias("wait_seconds")),
    "no_answer_streak": lambda spark, sf_dir: guard.closings(outcomes(spark, sf_dir)).where("status is null").select("site", "seq", F.col("streak").cast("long").alias("streak")),
    "cooldown_deadline": lambda spark, sf_dir: guard.cooldown_deadline(outcomes(spark, sf_dir)).select("site", "seq", "deadline", "closed", "cause"),
    "lease_sessions": _leases,
    "lease_session_window": _sessions,
    "chunk_at_cursor": _chunk_first,
    "chunks_of_document": _chunks,
}

ORACLES = {
    "failure_state_fold": _sql_fold("'new'"),
    "origin_precedence": _sql_fold("origin"),
    "standing_articles": f"{WITH}, stored as (select bulletin, max(seq) as seq from attempts where outcome <> 'error' group by bulletin) select a.seq // 20 as article, a.bulletin, a.seq from attempts a join stored using (bulletin, seq) qualify row_number() over (partition by a.seq // 20 order by a.seq desc, a.bulletin) = 1",
    "last_write_wins": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "first_write_wins": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id) = 1",
    "sync_plan": f"{_PLAN} select bulletin, date, state from plan",
    "sync_plan_old": f"{_STATES} select c.bulletin, c.date, k.state from bulletins c left join known k using (bulletin) where not coalesce(k.state = 'indexado' or (k.origin = 'old' and k.state in ('sin_sumarios', 'roto')), false)",
    "sync_plan_cap": f"{_PLAN} select bulletin, date, state from plan order by state is not null, date desc, number desc, bulletin limit 250",
    "sync_plan_deferred": f"{_PLAN} select count(*) as planned, greatest(count(*) - 250, 0) as deferred from plan",
    "run_counters_eta": f"{WITH} select seq // 1000 as run, count(*) as done, count(*) filter (outcome = 'indexado') as indexado, count(*) filter (outcome = 'sin_sumarios') as sin_sumarios, count(*) filter (outcome = 'error') as error, count(*) filter (status between 500 and 599) as broken, round(cast(2.5 * greatest(250 - count(*), 0) as double)) as eta from attempts group by 1",
    "catalogue_keys": "select c_custkey as record, case when count(*) over (partition by c_custkey // 2) > 1 then 'BOME-B-2000-' || (c_custkey // 2) || '~' || c_custkey else 'BOME-B-2000-' || (c_custkey // 2) end as key, 'MEL-7-' || c_nationkey || case when row_number() over w > 1 then '-' || row_number() over w else '' end as article_key from customer window w as (partition by c_nationkey order by c_custkey)",
    "repeated_keys": "select c_nationkey, count(*) as n from customer group by 1 having count(*) > 1",
    "range_locate_crowded": _CROWDED,
    "state_from_batches": _sql_fold("origin"),
    "range_locate": f"{_LOCATED} select number, holder, below, above from located",
    "neighbour_locate": f"{_CANDIDATES} select number, bulletin, row_number() over (partition by number order by grade, bulletin) as turn from tries",
    "error_budget_window": f"{WITH} select site, seq, count(*) filter (status >= 400) over (partition by site order by epoch_us(ts) range between 599999999 preceding and current row) as errors from outcomes",
    "error_budget_wait": f"{WITH} select site, seq, round(coalesce(greatest((lag(epoch_us(ts), 2) over (partition by site order by ts, seq) + 86400000000 - epoch_us(ts)) / 1000000.0, 0.0), 0.0), 3) as wait_seconds from outcomes where status >= 400",
    "no_answer_streak": f"{_CLOSINGS} select site, seq, cast(streak as bigint) as streak from closings where status is null",
    "cooldown_deadline": f"{_CLOSINGS}, run as (select o.site, o.ts, o.seq, max(d.own) over w as deadline, arg_max(d.own_cause, d.own) over w as cause from outcomes o left join deadlines d using (site, ts, seq) window w as (partition by site order by ts, seq rows unbounded preceding)) select site, seq, deadline, coalesce(deadline > ts, false) as closed, case when deadline > ts then cause end as cause from run",
    "lease_sessions": _LIVES,
    "lease_session_window": _LIVES,
    "chunks_of_document": _CHUNKS,
    "chunk_at_cursor": "select doc, page, least(length, 1500) as taken, length > 1500 as cut from (select conv_id as doc, turn as page, cast(length(text) as bigint) as length, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as upto, row_number() over (partition by conv_id order by turn) as k from conversations) where k = 1 or upto <= 1500",
}
