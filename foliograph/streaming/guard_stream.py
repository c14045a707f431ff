"""The error budget and the cooldown over streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.guard import BLOCKING, COOLDOWN_SECONDS, MAX_ERRORS, MICRO, RETRY_AFTER_MOST, SILENT_FAILURES, WINDOW_SECONDS
from ..shipping import ship

DECISIONS = "site long, seq long, ts timestamp, errors int, wait_seconds double, deadline timestamp, closed boolean"
STATE = "stamps array<long>, silent int, deadline long"
FIELDS = ("ts", "seq", "status", "retry_after")


def _columns(frames: Iterator[pd.DataFrame]) -> list[np.ndarray]:
    """The outcomes of a micro-batch as four columns of numbers in order of time; frames are let go one by one."""
    taken = [(f["ts"].astype("datetime64[us]").astype("int64").to_numpy(), *(f[c].to_numpy(dtype=np.float64 if c != "seq" else np.int64) for c in FIELDS[1:])) for f in frames]
    columns = [np.concatenate(c) for c in zip(*taken, strict=True)]
    order = np.lexsort((columns[1], columns[0]))
    return [c[order] for c in columns]


class Decisions:
    """What is known of a site, and what it decides of the outcomes that come."""

    def __init__(self, stamps: list[int], silent: int, deadline: int):
        self.stamps, self.silent, self.deadline, self.now = list(stamps), silent, deadline, max(stamps, default=0)

    def take(self, key: tuple, frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """A decision for each outcome of a micro-batch, in order of time."""
        window, out = WINDOW_SECONDS * MICRO, []
        for now, seq, status, retry_after in zip(*(c.tolist() for c in _columns(frames)), strict=True):
            self.now = now
            self.stamps = [s for s in self.stamps if s > now - window]
            if status != status:
                self.silent += 1
                if self.silent == SILENT_FAILURES:
                    self.silent, self.deadline = 0, max(self.deadline, now + COOLDOWN_SECONDS * MICRO)
            else:
                self.silent = 0
                if status >= 400:
                    self.stamps.append(now)
                if status in BLOCKING:
                    asked = retry_after if 0 < retry_after < float("inf") else 0
                    self.deadline = max(self.deadline, now + int(max(min(asked, RETRY_AFTER_MOST), COOLDOWN_SECONDS) * MICRO))
            wait = max(0, self.stamps[-MAX_ERRORS] + window - now) / MICRO if len(self.stamps) >= MAX_ERRORS else 0.0
            out.append((key[0], seq, now, len(self.stamps), wait, self.deadline or None, self.deadline > now))
        told = pd.DataFrame(out, columns=["site", "seq", "ts", "errors", "wait_seconds", "deadline", "closed"])
        told["ts"], told["deadline"] = pd.to_datetime(told["ts"], unit="us"), pd.to_datetime(told["deadline"], unit="us")
        return told

    def matters_until(self) -> int:
        """Milliseconds: the longest that an outcome can matter is its window, or the deadline that it set; a silent one only to the next."""
        return max(self.now + WINDOW_SECONDS * MICRO, self.deadline, self.now + RETRY_AFTER_MOST * MICRO if self.silent else 0) // 1000 + 1


def _decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One site's outcomes of a micro-batch onto what is known of it; a site that was idle until nothing of it matters is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    decided = Decisions(*(state.get if state.exists else ([], 0, 0)))
    told = decided.take(key, frames)
    state.update((decided.stamps, decided.silent, decided.deadline))
    state.setTimeoutTimestamp(decided.matters_until())
    yield told


def guard_stream(outcomes: DataFrame) -> DataFrame:
    """A decision for each outcome (site, ts, seq, status, retry_after), with state kept per site.

    State is a few stamps inside the budget's window, and goes when the
    watermark has passed all that it can decide, so it stays small however long
    the stream runs and however many sites come and go.  (One answer missed
    counts for a day towards the next.)  The watermark is the window: an outcome
    later than that can't change a live decision.
    """
    ship(outcomes.sparkSession)
    timed = outcomes.withWatermark("ts", f"{WINDOW_SECONDS} seconds")
    return timed.groupBy("site").applyInPandasWithState(_decide, DECISIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_errors(outcomes: DataFrame, length: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Errors by site in sliding windows, for dashboards; late outcomes count until the watermark has passed."""
    errors = F.count_if(F.col("status") >= 400).alias("errors")
    return outcomes.withWatermark("ts", "10 minutes").groupBy("site", F.window("ts", length, slide)).agg(errors, F.count("*").alias("n")).select("site", F.col("window.start").alias("start"), "errors", "n")


# --- with timers -------------------------------------------------------------

#: The store that keeps lists and timers apart from one another.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SiteGuard(StatefulProcessor):
    """A site's error stamps as a list, its silent requests and deadline as a value, and a timer for when none of them matters any more.

    The list is only appended to and cut, a batch's outcomes are taken frame by
    frame as they come, and a site's end doesn't wait for another outcome.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stamps = handle.getListState("stamps", "stamp long")
        self.state = handle.getValueState("state", "silent int, deadline long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        decided = Decisions([s[0] for s in self.stamps.get()], *(self.state.get() or (0, 0)))
        told = decided.take(key, frames)
        self.stamps.put([(s,) for s in decided.stamps]) if decided.stamps else self.stamps.clear()
        self.state.update((decided.silent, decided.deadline))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(decided.matters_until())
        yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stamps.clear()
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def known_before(outcomes: DataFrame) -> DataFrame:
    """What a log of outcomes leaves of each site (site, stamps, silent, deadline), for ``guard_with_timers`` to begin with."""
    ship(outcomes.sparkSession)

    def left(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        decided = Decisions([], 0, 0)
        decided.take(key, [frame])
        return pd.DataFrame([(key[0], decided.stamps, decided.silent, decided.deadline)], columns=["site", "stamps", "silent", "deadline"])

    return outcomes.groupBy("site").applyInPandas(left, "site long, stamps array<long>, silent int, deadline long")


class SiteGuardFrom(SiteGuard):
    """The same, beginning with what an earlier log has left."""

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        stamps, silent, deadline = initialState[["stamps", "silent", "deadline"]].iloc[0]
        if len(stamps):
            self.stamps.put([(int(s),) for s in stamps])
        self.state.update((int(silent), int(deadline)))
        decided = Decisions([int(s) for s in stamps], int(silent), int(deadline))
        self.handle.registerTimer(decided.matters_until())


def guard_with_timers(outcomes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``guard_stream`` by ``transformWithState``: the same decisions; ``before`` (``known_before`` of an earlier log) is what sites begin with.

    The session's state store must be STATE_STORE.
    """
    ship(outcomes.sparkSession)
    timed = outcomes.withWatermark("ts", f"{WINDOW_SECONDS} seconds").groupBy("site")
    if before is None:
        return timed.transformWithStateInPandas(SiteGuard(), DECISIONS, "Append", "EventTime", eventTimeColumnName="")
    return timed.transformWithStateInPandas(SiteGuardFrom(), DECISIONS, "Append", "EventTime", before.groupBy("site"), eventTimeColumnName="")
