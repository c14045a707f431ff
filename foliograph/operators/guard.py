"""A site's error budget and cooldown over a log of request outcomes.

Outcomes: site, ts, seq, status (null: no answer), retry_after (seconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

# Budget, cooldown and lease.
WINDOW_SECONDS, MAX_ERRORS = 600, 3
COOLDOWN_SECONDS, RETRY_AFTER_MOST = 4500, 86_400
SILENT_FAILURES = 2
BLOCKING = (403, 429, 503)
LEASE_SECONDS = 180
MICRO = 1_000_000


def _micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def is_error() -> Column:
    return F.coalesce(F.col("status") >= 400, F.lit(False))


def errors_in_window(outcomes: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Each outcome with ``errors``: error answers of its site in the window that ends with it.

    The window leaves out its old end; outcomes of one instant see each other.
    """
    frame = Window.partitionBy("site").orderBy(_micros()).rangeBetween(-(seconds * MICRO - 1), 0)
    return outcomes.withColumn("errors", F.count_if(is_error()).over(frame))


def budget_wait(outcomes: DataFrame, seconds: int = WINDOW_SECONDS, most: int = MAX_ERRORS) -> DataFrame:
    """Each error with ``wait_seconds``: how long until under ``most`` errors are left in the window (0: there is room).

    The error ``most - 1`` before it must leave the window.
    """
    oldest = F.lag(_micros(), most - 1).over(Window.partitionBy("site").orderBy("ts", "seq"))
    errors = outcomes.where(is_error()).withColumn("oldest", oldest)
    left = F.greatest((F.col("oldest") + seconds * MICRO - _micros()) / MICRO, F.lit(0.0))
    return errors.withColumn("wait_seconds", F.coalesce(left, F.lit(0.0))).drop("oldest")


def closings(outcomes: DataFrame) -> DataFrame:
    """Outcomes that close a site, with ``deadline`` and ``cause``.

    A blocking answer closes for its Retry-After (a day at most), or for the
    cooldown if that is longer; so does every second request in a row without
    an answer.
    """
    line = Window.partitionBy("site").orderBy("ts", "seq")
    silent = F.col("status").isNull()
    island = F.sum(F.when(silent, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    streak = F.sum(silent.cast("int")).over(Window.partitionBy("site", "island").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    marked = outcomes.withColumn("island", island).withColumn("streak", F.when(silent, streak).otherwise(0))
    blocked = F.coalesce(F.col("status").isin(*BLOCKING), F.lit(False))
    asked = F.when((F.col("retry_after") > 0) & (F.col("retry_after") < float("inf")), F.least(F.col("retry_after").cast("double"), F.lit(float(RETRY_AFTER_MOST))))
    for_seconds = F.when(blocked, F.greatest(F.coalesce(asked, F.lit(0.0)), F.lit(float(COOLDOWN_SECONDS)))).when(silent & (F.col("streak") % SILENT_FAILURES == 0), F.lit(float(COOLDOWN_SECONDS)))
    closing = marked.withColumn("for_seconds", for_seconds).where("for_seconds is not null")
    deadline = F.timestamp_micros((_micros() + F.col("for_seconds") * MICRO).cast("long")).cast(outcomes.schema["ts"].dataType)
    return closing.withColumn("deadline", deadline).withColumn("cause", F.when(blocked, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).otherwise("no_answer")).drop("island")


def cooldown_deadline(outcomes: DataFrame) -> DataFrame:
    """Each outcome with ``deadline``: until when its site is closed as of it (the latest so far), and ``closed``: whether that is still to come."""
    shut = closings(outcomes).select("site", "ts", "seq", F.col("deadline").alias("own"), F.col("cause").alias("own_cause"))
    line = Window.partitionBy("site").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = outcomes.join(shut, ["site", "ts", "seq"], "left")
    last = joined.withColumn("deadline", F.max("own").over(line)).withColumn("cause", F.max_by("own_cause", "own").over(line))
    closed = F.coalesce(F.col("deadline") > F.col("ts"), F.lit(False))
    return last.withColumn("closed", closed).withColumn("cause", F.when(closed, F.col("cause"))).drop("own", "own_cause")


def merged_states(states: DataFrame) -> DataFrame:
    """One state a site from several writers' (site, writer, stamps, deadline, cause): per stamp the greatest multiplicity, and the latest deadline."""
    stamps = states.select("site", "writer", F.explode("stamps").alias("stamp")).groupBy("site", "stamp", "writer").agg(F.count("*").alias("n"))
    most = stamps.groupBy("site", "stamp").agg(F.max("n").alias("n"))
    lists = most.groupBy("site").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("stamp", F.col("n").cast("int"))))).alias("stamps"))
    return states.groupBy("site").agg(F.max("deadline").alias("deadline"), F.max_by("cause", "deadline").alias("cause")).join(lists, "site", "left")


def lease_sessions(beats: DataFrame, owner: str = "owner", seconds: int = LEASE_SECONDS) -> DataFrame:
    """A lease's lives: (owner, started, last_beat, beats).  One is live as long as beats are ``seconds`` apart or less."""
    line = Window.partitionBy(owner).orderBy("ts")
    fresh = F.coalesce((_micros() - F.lag(_micros()).over(line)) > seconds * MICRO, F.lit(True))
    numbered = beats.withColumn("life", F.sum(fresh.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(owner, "life").agg(F.min("ts").alias("started"), F.max("ts").alias("last_beat"), F.count("*").alias("beats")).drop("life")


def lease_holder(beats: DataFrame, now: Column, seconds: int = LEASE_SECONDS) -> DataFrame:
    """The owner of the latest beat, if the lease is live at ``now``."""
    last = beats.agg(F.max_by("owner", "ts").alias("owner"), F.max("ts").alias("ts"))
    return last.where((F.unix_micros(now) - _micros()) <= seconds * MICRO)
