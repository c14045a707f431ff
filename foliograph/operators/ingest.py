"""The index as a fold over an append-only log of attempts, and the plan of what to fetch next.

Attempts: seq, bulletin, origin (new or old), outcome (indexado, sin_sumarios,
error), status, blocked, message.  Nothing is updated in place: the current
state is an aggregate over a key's attempts, so a run that is repeated or that
loses an executor gives the same state.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

# Origins, and when a bulletin is given up, recent, or left for the next run.
NEW, OLD = "new", "old"
#: Broken answers in a row after which a bulletin is given up.
GIVE_UP = 2
RECENT_DAYS, PER_RUN = 7, 250
STATE = "struct<origin:string,state:string,failures:int,status:int,message:string,stored_seq:bigint>"


def _rank(state: Column) -> Column:
    return F.when(state == "indexado", 2).when(state == "sin_sumarios", 1).otherwise(0)


def _step(old: Column, e: Column) -> Column:
    """One attempt ``e`` folded into the state ``old`` (null before the first)."""
    failed = e["outcome"] == "error"
    other = old.isNotNull() & (old["origin"] != e["origin"])
    takes_over = F.when(failed, (e["origin"] == NEW) & (_rank(old["state"]) == 0)).otherwise(
        (_rank(e["outcome"]) > _rank(old["state"])) | ((_rank(e["outcome"]) == _rank(old["state"])) & (e["origin"] == NEW))
    )
    ignored = other & ~takes_over
    fresh = old.isNull() | (other & takes_over)
    broken = F.coalesce(e["status"].between(500, 599) & (e["status"] != 503) & ~F.coalesce(e["blocked"], F.lit(False)), F.lit(False))
    failures = F.when(fresh, F.lit(0)).otherwise(old["failures"]) + broken.cast("int")
    done_before = ~fresh & old["state"].isin("indexado", "sin_sumarios")
    def make(origin, state, n, status, message, stored):
        return F.struct(origin.alias("origin"), state.alias("state"), n.cast("int").alias("failures"), status.cast("int").alias("status"), message.alias("message"), stored.cast("bigint").alias("stored_seq"))
    after_failure = make(
        e["origin"],
        F.when(done_before, old["state"]).when(failures >= GIVE_UP, F.lit("roto")).otherwise(F.lit("error")),
        failures,
        e["status"],
        e["message"],
        F.when(done_before, old["stored_seq"]),
    )
    after_success = make(e["origin"], e["outcome"], F.lit(0), F.lit(None), e["message"], e["seq"])
    return F.when(ignored, old).when(failed, after_failure).otherwise(after_success).cast(STATE)


def current_state(attempts: DataFrame, key: str = "bulletin") -> DataFrame:
    """(bulletin, origin, state, failures, status, message, stored_seq) from the log, in order of ``seq``.

    A success of the other origin replaces a state of lower rank, and of equal
    rank if it is the new one's; its failures count only against failures.  A
    failure leaves a stored success as it is and counts if the page is broken
    (5xx but 503, not blocked); GIVE_UP of them without a success make ``roto``.
    ``stored_seq`` is the attempt whose articles stand.
    """
    folded = _logs(attempts, key).select(key, F.aggregate("log", F.lit(None).cast(STATE), _step).alias("s"))
    return folded.select(key, "s.*")


def _logs(attempts: DataFrame, key: str) -> DataFrame:
    """(key, log): a key's attempts, in order."""
    event = F.struct("seq", "origin", "outcome", F.col("status").cast("int").alias("status"), F.col("blocked").cast("boolean").alias("blocked"), F.col("message").cast("string").alias("message"))
    return attempts.groupBy(key).agg(F.array_sort(F.collect_list(event)).alias("log"))


def fold_onto(states: DataFrame, attempts: DataFrame, key: str = "bulletin") -> DataFrame:
    """``current_state`` of all attempts from the state of the earlier ones and the attempts since, which must have greater ``seq``."""
    fields = [f.split(":")[0] for f in STATE[len("struct<") : -1].split(",")]
    # nothing was attempted where the state is null; a state's own fields may all be
    known = states.select(key, F.struct(*fields).cast(STATE).alias("s"))
    both = known.join(_logs(attempts, key), key, "full")
    log = F.coalesce("log", F.array().cast(_logs(attempts, key).schema["log"].dataType))
    return both.select(key, F.aggregate(log, F.col("s"), _step).alias("s")).select(key, "s.*")


def current_articles(versions: DataFrame, states: DataFrame, key: str = "bulletin") -> DataFrame:
    """The articles that stand: those of the stored attempt of their bulletin, each identifier once.

    ``versions``: article rows with the bulletin and ``seq`` that brought them
    and ``pos`` within it.  An article's identifier is unique over all
    bulletins: the latest writer has it, and within one write the last row.
    """
    standing = versions.join(states.where("stored_seq is not null").select(key, F.col("stored_seq").alias("seq")), [key, "seq"], "left_semi")
    latest = Window.partitionBy("article").orderBy(F.desc("seq"), F.desc("pos"), key)
    return standing.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")


def state_from_texts(has_text: Column) -> Column:
    """What a success is: ``indexado`` if any article has a summary that isn't blank."""
    return F.when(has_text, "indexado").otherwise("sin_sumarios")


def latest_by_key(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Replace by key: the row of the greatest ``seq``."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_k = 1").drop("_k")


def first_by_key(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Keep the first by key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.asc(seq)))).where("_k = 1").drop("_k")


# --- planning ----------------------------------------------------------------


def plan(calendar: DataFrame, states: DataFrame, today: date, recent_days: int = RECENT_DAYS, retry_errors: bool = True, retry_broken: bool = False) -> DataFrame:
    """Calendar entries to fetch: never seen, recent, or failed.  A given-up one needs its own switch, even if it is recent."""
    recent = F.coalesce(F.col("date") >= F.date_sub(F.lit(today), recent_days), F.lit(False)) if recent_days > 0 else F.lit(False)
    given_up = F.coalesce(F.col("state") == "roto", F.lit(False))
    wanted = F.when(given_up, F.lit(retry_broken)).otherwise(F.col("state").isNull() | recent | (F.lit(retry_errors) & (F.coalesce("state", F.lit("")) == "error")))
    return calendar.join(states.select("bulletin", "state"), "bulletin", "left").where(wanted)


def plan_old(catalogue: DataFrame, states: DataFrame, retry_errors: bool = True, retry_broken: bool = False) -> DataFrame:
    """The same for the old catalogue: skip what any origin has indexed, and what is empty, failed or given up here."""
    known = states.select("bulletin", "state", F.col("origin").alias("by"))
    own = F.when(F.col("by") == OLD, F.col("state"))
    skip = (F.col("state") == "indexado") | (own == "sin_sumarios") | ((own == "roto") & F.lit(not retry_broken)) | ((own == "error") & F.lit(not retry_errors))
    return catalogue.join(known, "bulletin", "left").where(~F.coalesce(skip, F.lit(False))).drop("by")


def capped(planned: DataFrame, cap: int = PER_RUN) -> DataFrame:
    """The newest ``cap`` of a plan, never-seen ones before retries, so that lasting failures can't starve the rest."""
    return planned.orderBy(F.col("state").isNotNull(), F.desc("date"), F.desc("number"), F.asc("bulletin")).limit(cap)


def old_order() -> list[Column]:
    """The order of the old catalogue's plan: newest first, and of one day and number the greatest record."""
    return [F.desc("date"), F.desc("number"), F.desc("record")]


def sync_summaries(runs: DataFrame) -> DataFrame:
    """(origin, summary): what the last run of each origin came to, as JSON.  runs: origin, ended, and whatever a run tells."""
    told = F.to_json(F.struct(*(c for c in runs.columns if c != "origin")))
    return runs.groupBy("origin").agg(F.max_by(told, "ended").alias("summary"))


def deferred(planned: DataFrame, cap: int = PER_RUN) -> DataFrame:
    return planned.agg(F.count("*").alias("planned"), F.greatest(F.count("*") - cap, F.lit(0)).alias("deferred"))


def run_counters(attempts: DataFrame, *keys: str) -> DataFrame:
    """Per run: how many were done, by outcome, and how many answers were broken."""
    kinds = [F.count_if(F.col("outcome") == s).alias(s) for s in ("indexado", "sin_sumarios", "error")]
    return attempts.groupBy(*keys).agg(F.count("*").alias("done"), *kinds, F.count_if(F.col("status").between(500, 599)).alias("broken"))


def remaining_seconds(elapsed: Column, done: Column, planned: Column) -> Column:
    """Seconds to go at the pace so far, rounded; null before anything is done."""
    return F.when(done > 0, F.round(elapsed / done * F.greatest(planned - done, F.lit(0))))


# --- pauses ------------------------------------------------------------------


def pause_after_error(status: int | None, jitter: float, least: float = 30.0) -> float:
    """Seconds to wait after a broken answer: ``least`` to twice that, by ``jitter`` in 0..1; else none."""
    return least * (1 + jitter) if status is not None and 500 <= status < 600 else 0.0


def stops_run(storage_failures_in_a_row: int, preventive_pauses_in_a_row: int) -> bool:
    """A run ends after three failed writes or six pauses in a row."""
    return storage_failures_in_a_row >= 3 or preventive_pauses_in_a_row >= 6
