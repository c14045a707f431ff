"""Runs that take bulletins in: an inbox that nothing is lost from, runs with a cap, a lease, states, progress and an end.

What arrives is appended to an inbox by a stream.  A run plans what the inbox
holds and no run before it has taken in, newest first, up to its cap; the rest
waits for the next run.  All logs are append-only tables, written by number, so
that a run that is repeated after a crash writes the same place again.
"""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException, StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.guard import BLOCKING, LEASE_SECONDS
from ..operators.ingest import PER_RUN, capped, pause_after_error, stops_run
from ..shipping import shared_folder
from ..sources.ledger import Ledger, create_once, names, read_text

# States of a run, and outcomes of an attempt.
RUNNING, DONE, CANCELLED, FAILED, BLOCKED, ELSEWHERE = "en_curso", "completado", "cancelado", "fallido", "bloqueado", "en_curso_en_otro_proceso"
OUTCOMES = ("indexado", "sin_sumarios", "error")
#: What the table of summaries says of a run.
SUMMARY = {"origin": "string", "state": "string", "message": "string", "planned": "long", "deferred": "long", "done": "long", "indexado": "long", "sin_sumarios": "long", "error": "long", "broken": "long", "started": "double", "ended": "double"}
#: Bulletins between two looks at the lease, the site's guard and the wish to cancel.
STEP = 25
#: Seconds that an orderly end waits for all runs.
PATIENCE = 10


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


# --- inbox -------------------------------------------------------------------


def append_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch into the table ``folder`` by its number, so that a batch that comes again is the same one."""

    def take_in(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return take_in


def sync_stream(arriving: DataFrame, checkpoint: str, take_in: Callable[[DataFrame, int], None]):
    """Run ``take_in`` on each micro-batch until all that is there is taken in.

    The checkpoint is the memory of what was done, so a stopped run goes on
    where it was; ``take_in`` gets a batch again after a crash and must write by
    batch number (``append_batches``).  How much a micro-batch holds is set where
    the source is read (``maxFilesPerTrigger``); no row is left out.
    """
    return arriving.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class Inbox:
    """Rows that arrived (``folder``/inbox) and what runs have taken in of them (``folder``/taken), known by ``key``.

    The rows have ``date`` and ``number``, by which the newest go first.
    """

    spark: SparkSession
    folder: str
    schema: str
    key: tuple[str, ...] = ("bulletin", "seq")

    def receive(self, arriving: DataFrame):
        """A stream of rows into the inbox."""
        return sync_stream(arriving, f"{self.folder}/checkpoint", append_batches(f"{self.folder}/inbox"))

    @property
    def taken(self) -> DataFrame:
        return _table(self.spark, f"{self.folder}/taken", f"{self.schema}, batch int")

    def waiting(self) -> DataFrame:
        rows = _table(self.spark, f"{self.folder}/inbox", self.schema).dropDuplicates(list(self.key))
        return rows.join(self.taken.select(*self.key), list(self.key), "left_anti")

    def take(self, cap: int | None = None) -> int:
        """Take in the newest ``cap`` waiting rows (all, without a cap); the number of rows left for later runs.

        One write by number is the whole step: what it holds is taken, all else waits.
        """
        number = (self.taken.agg(F.max("batch")).first()[0] or 0) + 1
        rows = self.waiting()
        chosen = rows if cap is None else rows.orderBy(F.desc("date"), F.desc("number"), *self.key).limit(cap)
        append_batches(f"{self.folder}/taken")(chosen, number)
        return self.waiting().count()


# --- lease -------------------------------------------------------------------

LEASE = "owner string, at double, kind string, origin string, id string"
HELD = "struct<owner:string,origin:string,started:double,heartbeat:double>"


def _lease_step(held: Column, e: Column, seconds: float) -> Column:
    """One entry of the log onto who holds the lease (null: nobody)."""
    own = F.coalesce(held["owner"] == e["owner"], F.lit(False))
    free = held.isNull() | (e["at"] - held["heartbeat"] > seconds)
    mine = F.struct(e["owner"].alias("owner"), e["origin"].alias("origin"), F.when(own, held["started"]).otherwise(e["at"]).alias("started"), e["at"].alias("heartbeat"))
    beat = F.struct(held["owner"].alias("owner"), held["origin"].alias("origin"), held["started"].alias("started"), e["at"].alias("heartbeat"))
    nobody = F.lit(None).cast(HELD)
    return F.when((e["kind"] == "acquire") & (own | free), mine).when((e["kind"] == "renew") & own, beat).when((e["kind"] == "release") & own, nobody).otherwise(held).cast(HELD)


def lease_state(log: DataFrame, seconds: float = LEASE_SECONDS, *keys: str) -> DataFrame:
    """(keys, owner, origin, started, heartbeat): who holds each lease after all entries of the log (owner, at, kind, origin, id), no row if nobody.

    An acquire succeeds if the lease is free, one's own, or without a heartbeat
    for more than ``seconds``; renew and release count for the holder only.
    """
    entries = log.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "id", "owner", "kind", "origin"))).alias("log"))
    held = F.aggregate("log", F.lit(None).cast(HELD), lambda held, e: _lease_step(held, e, seconds))
    return entries.select(*keys, held.alias("held")).where("held is not null").select(*keys, "held.*")


@dataclass(frozen=True)
class Lease:
    """One lease per index, in a ledger that all processes see: each change is a note that follows the last one, so of two that ask at once only one gets it."""

    spark: SparkSession
    folder: str
    seconds: float = LEASE_SECONDS
    clock: Callable[[], float] = time.time

    #: Notes that are kept.
    KEPT = 16

    @property
    def _ledger(self) -> Ledger:
        return Ledger(self.spark, f"{self.folder}/lease")

    def _change(self, owner: str, step: Callable[[dict | None, float], dict | None]) -> dict | None:
        """Who holds the lease after ``step`` (holder, now) has had its say; notes are tidied up now and then."""
        number, held = self._ledger.change(lambda note: step(note if note and note["owner"] else None, self.clock()))
        if number % self.KEPT == 0:
            self._ledger.forget(self.KEPT)
        return held if held and held["owner"] else None

    def _live(self, held: dict | None, now: float) -> bool:
        return held is not None and now - held["heartbeat"] <= self.seconds

    def holder(self) -> dict | None:
        """The live holder, None if the lease is free or stale."""
        held, now = self._ledger.last()[1], self.clock()
        if not held or not held["owner"] or not self._live(held, now):
            return None
        return {"owner": held["owner"], "origin": held["origin"], "started": held["started"], "idle_seconds": now - held["heartbeat"]}

    def acquire(self, owner: str, origin: str | None = None) -> dict | None:
        """None if ``owner`` has the lease now, else its live holder."""

        def step(held, now):
            own = held is not None and held["owner"] == owner
            if self._live(held, now) and not own:
                return None
            return {"owner": owner, "origin": origin, "started": held["started"] if own else now, "heartbeat": now}

        held = self._change(owner, step)
        return None if held is not None and held["owner"] == owner else self.holder() or held

    def renew(self, owner: str) -> bool:
        """A heartbeat; False if ``owner`` doesn't hold the lease any more."""
        held = self._change(owner, lambda held, now: held | {"heartbeat": now} if held and held["owner"] == owner else None)
        return held is not None and held["owner"] == owner

    def release(self, owner: str) -> None:
        self._change(owner, lambda held, now: {"owner": None} if held and held["owner"] == owner else None)

    @contextmanager
    def kept(self, owner: str):
        """Heartbeats from the side, as long as the block runs."""
        done = threading.Event()

        def beat():
            while not done.wait(self.seconds / 6):
                if not self.renew(owner):
                    return

        beats = threading.Thread(target=beat, daemon=True)
        beats.start()
        try:
            yield
        finally:
            done.set()
            beats.join()


# --- runs --------------------------------------------------------------------


def until_blocked(attempts: DataFrame) -> DataFrame:
    """Attempts of a step up to the first that the site blocked: those behind it were never made.  attempts: place, status, blocked, ...

    A step is a few rows, and looking at them twice would ask the site twice, so
    a window over all of them finds the block.
    """
    stop = F.coalesce("blocked", F.col("status").isin(*BLOCKING), F.lit(False))
    first = F.min(F.when(stop, F.col("place"))).over(Window.partitionBy(F.lit(0)))
    return attempts.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col("place") <= F.col("_stop"))).drop("_stop")


def counters() -> list[Column]:
    """What is counted of a step's attempts while they are written."""
    outcome, blocking = F.col("outcome"), F.coalesce("blocked", F.col("status").isin(*BLOCKING), F.lit(False))
    kinds = (F.count_if(outcome == k).alias(k) for k in OUTCOMES)
    return [F.count("*").alias("done"), *kinds, F.count_if(F.col("status").between(500, 599)).alias("broken"), F.count_if(blocking).alias("blocked")]


@dataclass
class SyncRun:
    """One run over a plan, as a stream: ``fetch`` answers a step of it (a DataFrame with ``place``) with attempts, ``store`` writes them by the step's number.

    The plan is cut to ``cap`` rows, the newest first, numbered, and written in
    steps of STEP rows; the stream takes a step a micro-batch.  Before a step the
    run looks whether it was asked to stop, still has its lease (which is beaten
    from the side while a step is at work), and what the site's guard says:
    ``closed`` ends it, ``wait_needed`` seconds are waited.  After a broken answer
    it pauses.  A site that blocks ends the run; attempts behind the block aren't
    stored, and the next run plans them again, as it does those of a step that
    couldn't be stored.  What a step came to is observed while it is written and
    noted in the run's folder, so any process can tell how far the run is; how
    it ended is also added to the table ``summaries``.
    """

    plan: DataFrame
    fetch: Callable[[DataFrame], DataFrame]
    store: Callable[[DataFrame, int], None]
    origin: str = "new"
    cap: int = PER_RUN
    lease: Lease | None = None
    closed: Callable[[], bool] = lambda: False
    wait_needed: Callable[[], float] = lambda: 0.0
    summaries: str | None = None
    clock: Callable[[], float] = time.time
    pause: Callable[[float], None] = time.sleep
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        self.folder = f"{shared_folder(self.plan.sparkSession)}/run-{self.owner}"
        self.query, self._size, self._failures = None, {}, 0

    @property
    def _steps(self) -> Ledger:
        return Ledger(self.plan.sparkSession, f"{self.folder}/steps")

    def _note(self, name: str) -> dict | None:
        spark = self.plan.sparkSession
        return json.loads(read_text(spark, f"{self.folder}/{name}")) if name in names(spark, self.folder) else None

    # --- as others see it ---

    def progress(self) -> dict:
        """State, counts, and the seconds left at the pace so far."""
        end, size = self._note("end") or {}, self._size
        told = [self._steps.read(n) for n in self._steps.numbers()]
        sums = {k: sum(t[k] for t in told) for k in ("done", *OUTCOMES, "broken")}
        state, message = end.get("state"), end.get("message")
        if state is None and self.query is not None:
            failed = None if self.query.isActive else self.query.exception()
            state, message = (FAILED, str(failed)) if failed else (RUNNING, None)
        planned, began = size.get("planned", 0), size.get("started")
        pace = ((end.get("ended") or self.clock()) - began) / sums["done"] if sums["done"] else None
        return {"state": state, "message": message, "origin": self.origin, "planned": planned, "deferred": size.get("deferred", 0), "started": began, "ended": end.get("ended"), **sums, "seconds_left": None if pace is None else round(pace * max(planned - sums["done"], 0))}

    def start(self) -> dict:
        """Write the plan down and begin; another process's live run is reported instead."""
        other = self.lease.acquire(self.owner, self.origin) if self.lease else None
        if other:
            return {"state": ELSEWHERE, "holder": other}
        spark = self.plan.sparkSession
        self._size = {"planned": 0, "deferred": 0, "started": self.clock()}
        try:
            if self.closed():
                return self._end(BLOCKED, "the site is closed")
            seen = Observation()
            newest = Window.orderBy(F.col("state").isNotNull(), F.desc("date"), F.desc("number"), F.asc("bulletin"))
            # cap rows at most, so one task can number them
            numbered = capped(self.plan.observe(seen, F.count("*").alias("n")), self.cap).withColumn("place", F.row_number().over(newest) - 1)
            numbered.withColumn("step", F.floor(F.col("place") / STEP).cast("int")).write.partitionBy("step").parquet(f"{self.folder}/plan")
            planned = min(seen.get["n"], self.cap)
            self._size |= {"planned": planned, "deferred": seen.get["n"] - planned}
        except Exception as error:  # a run must always report how it ended
            return self._end(FAILED, f"{type(error).__name__}: {error}")
        if not planned:
            return self._end(DONE, None)
        self._schema = numbered.schema
        steps = spark.readStream.schema(self._schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/plan")
        # a file is a step; which one comes doesn't matter, as micro-batch k takes step k
        self.query = steps.writeStream.foreachBatch(lambda _, k: self._take(k)).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        return self.progress()

    def cancel(self) -> dict:
        """Ask the run to stop after the step that it is in; any process may."""
        create_once(self.plan.sparkSession, f"{self.folder}/stop", "{}")
        return self.progress()

    def wait(self, seconds: float | None = None) -> dict:
        """How the run is when it has ended, or after so many seconds."""
        if self.query is not None:
            try:
                self.query.awaitTermination(seconds) if seconds is not None else self.query.awaitTermination()
            except StreamingQueryException as error:
                self._end(FAILED, str(error))
        return self.progress()

    def abandon(self) -> dict:
        """End the run though a step may be at work; whoever waits for the lease gets it."""
        told = self._end(CANCELLED, "the run was still at work when all was shut down")
        if self.query is not None:
            self.query.stop()
        return told

    # --- at work ---

    def _end(self, state: str, message: str | None) -> dict:
        """Note once how the run ended, add that to the summaries, and give the lease back."""
        spark = self.plan.sparkSession
        if create_once(spark, f"{self.folder}/end", json.dumps({"state": state, "message": message, "ended": self.clock()})):
            if self.summaries:
                told = self.progress()
                spark.createDataFrame([tuple(told[k] for k in SUMMARY)], ", ".join(f"{k} {t}" for k, t in SUMMARY.items())).write.mode("append").parquet(self.summaries)
            if self.lease:
                self.lease.release(self.owner)
        return self.progress()

    def _take(self, number: int) -> None:
        """One micro-batch; nothing after the run's end."""
        if self._note("end"):
            return
        try:
            ending = self._before_step() or self._step(number)
        except Exception as error:
            ending = FAILED, f"{type(error).__name__}: {error}"
        if ending is None and (number + 1) * STEP >= self._size["planned"]:
            left = self._size["deferred"]
            ending = DONE, f"{left} are left for the next run" if left else None
        if ending:
            self._end(*ending)

    def _before_step(self) -> tuple[str, str] | None:
        pauses = 0
        while True:
            if self._note("stop") is not None:
                return CANCELLED, "the run was asked to stop"
            if self.lease and not self.lease.renew(self.owner):
                return FAILED, "another process has the lease now"
            if self.closed():
                return BLOCKED, "the site is closed"
            seconds = self.wait_needed()
            if seconds <= 0:
                return None
            pauses += 1
            if stops_run(0, pauses):
                return BLOCKED, "the error budget stays full"
            self.pause(seconds)

    def _step(self, number: int) -> tuple[str, str] | None:
        spark = self.plan.sparkSession
        rows = spark.read.schema(self._schema).parquet(f"{self.folder}/plan/step={number}")
        seen = Observation()
        with self.lease.kept(self.owner) if self.lease else nullcontext():
            answers = until_blocked(self.fetch(rows.drop("step"))).observe(seen, *counters())
            try:
                self.store(answers, number)
            except PySparkException as error:
                self._failures += 1
                if stops_run(self._failures, 0):
                    return FAILED, f"attempts couldn't be stored: {error}"
                return None
        self._failures = 0
        self._steps.write(number + 1, seen.get)
        if seen.get["blocked"]:
            return BLOCKED, "the site blocked the run"
        if seconds := pause_after_error(500 if seen.get["broken"] else None, random.random()):
            self.pause(seconds)
        return None


def shutdown(runs=(), queries=(), seconds: float = PATIENCE) -> list[dict]:
    """An orderly end: all runs are asked to stop and waited for together, ``seconds`` at most; what is still at work then is said to be (``alive``) and gives its lease back.  Then the streams are stopped."""
    until = time.monotonic() + seconds
    for run in runs:
        run.cancel()
    told = []
    for run in runs:
        now = run.wait(max(0.0, until - time.monotonic()))
        alive = now["state"] == RUNNING
        told.append((run.abandon() if alive else now) | {"alive": alive})
    for query in queries:
        query.stop()
    return told


class ProgressListener(StreamingQueryListener):
    """Keeps the latest progress of every stream of a session, for a status call."""

    def __init__(self):
        self._lock, self._seen = threading.Lock(), {}

    def _note(self, key, **facts) -> None:
        with self._lock:
            self._seen[str(key)] = self._seen.get(str(key), {"batches": 0, "rows": 0}) | facts

    def onQueryStarted(self, event) -> None:
        self._note(event.runId, name=event.name, state=RUNNING)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = self.snapshot().get(str(p.runId), {"rows": 0})
        self._note(p.runId, name=p.name, batches=p.batchId + 1, rows=seen["rows"] + p.numInputRows)

    def onQueryTerminated(self, event) -> None:
        self._note(event.runId, state=FAILED if event.exception else DONE, message=event.exception)

    def onQueryIdle(self, event) -> None:
        pass

    def snapshot(self) -> dict[str, dict]:
        with self._lock:
            return {k: dict(v) for k, v in self._seen.items()}


__all__ = ["Inbox", "Lease", "ProgressListener", "SyncRun", "append_batches", "counters", "lease_state", "shutdown", "sync_stream", "until_blocked"]
