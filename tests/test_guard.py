import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliograph.operators import guard
from foliograph.streaming import sync
from foliograph.streaming.guard_stream import STATE_STORE, guard_stream, guard_with_timers, known_before, windowed_errors
from foliograph.streaming.sync import Inbox, Lease, ProgressListener, SyncRun, append_batches, shutdown, sync_stream

START = datetime(2026, 1, 1)
SCHEMA = "site long, ts timestamp, seq long, status int, retry_after double"


@pytest.fixture(scope="module")
def log():
    rng, rows, now = random.Random(8), [], START
    for k in range(300):
        now += timedelta(seconds=rng.choice([1, 30, 200, 400, 3000]))
        rows.append((rng.randrange(2), now, k, rng.choice([None, 200, 200, 404, 500, 503, None]), rng.choice([None, 10.0, 9000.0, 1e9, -1.0])))
    return rows


def simulate(rows):
    out = {}
    for site in {r[0] for r in rows}:
        stamps, silent, deadline = [], 0, None
        for _, ts, seq, status, retry in (r for r in rows if r[0] == site):
            stamps = [s for s in stamps if (ts - s).total_seconds() < 600]
            until = None
            if status is None:
                silent += 1
                if silent == 2:
                    silent, until = 0, ts + timedelta(seconds=4500)
            else:
                silent = 0
                if status >= 400:
                    stamps.append(ts)
                if status in (403, 429, 503):
                    until = ts + timedelta(seconds=max(4500, min(retry, 86400) if retry and retry > 0 else 0))
            deadline = max(filter(None, (deadline, until)), default=None)
            wait = max(0.0, 600 - (ts - stamps[-3]).total_seconds()) if len(stamps) >= 3 else 0.0
            out[seq] = (len(stamps), wait, deadline, bool(deadline and deadline > ts))
    return out


def test_batch(spark, log):
    df, want = spark.createDataFrame(log, SCHEMA), simulate(log)
    assert {r["seq"]: r["errors"] for r in guard.errors_in_window(df).collect()} == {k: v[0] for k, v in want.items()}
    waits = {r["seq"]: r["wait_seconds"] for r in guard.budget_wait(df).collect()}
    assert waits == {k: pytest.approx(want[k][1]) for k in waits} and len(waits) == sum(1 for r in log if r[3] and r[3] >= 400)
    assert {r["seq"]: (r["deadline"], r["closed"]) for r in guard.cooldown_deadline(df).collect()} == {k: v[2:] for k, v in want.items()}


def test_stream_decides_like_batch(spark, log, tmp_path):
    want = simulate(log)
    for k in range(3):
        spark.createDataFrame(log[k * 100 : (k + 1) * 100], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = guard_stream(stream).writeStream.format("memory").queryName("decisions").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["seq"]: (r["errors"], pytest.approx(r["wait_seconds"]), r["deadline"], r["closed"]) for r in spark.table("decisions").collect()}
    assert got == want


def test_windowed_stream_and_sync(spark, log, tmp_path):
    spark.createDataFrame(log, SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    query = windowed_errors(stream).writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("errors")).first()[0] == 2 * sum(1 for r in log if r[3] and r[3] >= 400)
    for _ in range(2):  # a second run finds nothing new
        sync_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", append_batches(f"{tmp_path}/log")).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/log").count() == len(log)


def test_states_of_several_writers(spark):
    rows = [(1, "a", [1, 1, 2], 10, "x"), (1, "b", [1, 3], 12, "y"), (2, "a", [], 5, "z")]
    got = {r["site"]: r for r in guard.merged_states(spark.createDataFrame(rows, "site long, writer string, stamps array<long>, deadline long, cause string")).collect()}
    assert Counter(got[1]["stamps"]) == Counter([1, 1, 2, 3]) and (got[1]["deadline"], got[1]["cause"]) == (12, "y") and got[2]["stamps"] is None


def test_leases(spark):
    beats = spark.createDataFrame([("a", START + timedelta(seconds=s)) for s in (0, 180, 361, 400)], "owner string, ts timestamp")
    assert sorted(r["beats"] for r in guard.lease_sessions(beats).collect()) == [2, 2]
    at = lambda s: F.lit(START + timedelta(seconds=s))
    assert guard.lease_holder(beats, at(580)).count() == 1 and guard.lease_holder(beats, at(581)).count() == 0


def test_idle_sites_are_forgotten(spark, tmp_path):
    """State goes once the watermark has passed all it can decide; a site that comes back starts anew."""
    late = START + timedelta(days=3)
    batches = [[(1, START, 1, 500, None), (2, START, 2, None, None)], [(3, late, 3, 200, None)], [(3, late + timedelta(seconds=1), 4, 200, None)], [(1, late + timedelta(seconds=2), 5, 500, None), (2, late + timedelta(seconds=2), 6, None, None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = guard_stream(stream).writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["seq"]: (r["errors"], r["closed"]) for r in spark.table("idle").collect()}
    assert got == {1: (1, False), 2: (0, False), 3: (0, False), 4: (0, False), 5: (1, False), 6: (0, False)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


@pytest.fixture
def timers(spark):
    """Sessions that keep state in the store that lists and timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, STATE_STORE)
    yield
    spark.conf.unset(key)


def replayed(spark, log, tmp_path, name, make, parts=3):
    """A log as a stream of micro-batches."""
    ordered = sorted(log, key=lambda r: r[1])
    for k in range(parts):
        spark.createDataFrame(ordered[k * len(log) // parts : (k + 1) * len(log) // parts], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
        time.sleep(0.05)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name).collect(), query


def test_timers_decide_as_the_log_does(spark, log, tmp_path, timers):
    batch = spark.createDataFrame(log, SCHEMA)
    errors = {r["seq"]: r["errors"] for r in guard.errors_in_window(batch).collect()}
    closed = {r["seq"]: r["closed"] for r in guard.cooldown_deadline(batch).collect()}
    rows, _ = replayed(spark, log, tmp_path, "timed", guard_with_timers)
    same = Counter(r[1] for r in log)
    assert len(rows) == len(log) and {r["seq"]: r["closed"] for r in rows} == closed
    assert {r["seq"]: r["errors"] for r in rows if same[[x[1] for x in log if x[2] == r["seq"]][0]] == 1} == {k: v for k, v in errors.items() if same[[x[1] for x in log if x[2] == k][0]] == 1}


def test_timers_begin_with_what_a_log_has_left_and_clear_state(spark, tmp_path, timers):
    early = [(1, START, 1, 500, None), (1, START + timedelta(seconds=5), 2, 500, None), (2, START, 3, None, None), (9, START, 4, 429, 9000.0)]
    late = START + timedelta(days=3)
    log = [(1, START + timedelta(seconds=60), 5, 500, None), (2, START + timedelta(seconds=61), 6, None, None), (9, START + timedelta(seconds=62), 7, 200, None)]
    log += [(3, late, 8, 200, None), (3, late + timedelta(seconds=1), 9, 200, None), (1, late + timedelta(seconds=2), 10, 500, None), (2, late + timedelta(seconds=3), 11, None, None)]
    before = known_before(spark.createDataFrame(early, SCHEMA))
    rows, query = replayed(spark, log, tmp_path, "begun", lambda s: guard_with_timers(s, before), parts=7)
    got = {r["seq"]: (r["errors"], r["closed"]) for r in rows}
    assert got == {5: (3, False), 6: (0, True), 7: (1, True), 8: (0, False), 9: (0, False), 10: (1, False), 11: (0, False)}
    assert {r["seq"]: r["wait_seconds"] for r in rows}[5] == 540.0
    # what sites 1, 2 and 9 had in the log's days was cleared by their timers: of each site that came back one stamp or value is left
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(sizes[:4]) >= 5 and min(sizes[4:]) <= 1 and max(sizes[4:]) <= 4


ROWS = "bulletin long, seq long, number long, date date, outcome string"


def test_capped_runs_take_everything_in(spark, tmp_path):
    from datetime import date

    inbox = Inbox(spark, f"{tmp_path}/box", ROWS)
    rows = [(k, 1, k, date(2020, 1, 1 + k), "indexado") for k in range(10)]
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, ROWS).write.mode("append").parquet(f"{tmp_path}/in")
        inbox.receive(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")).awaitTermination(120)
        assert inbox.take(2) == (4 if part[0][0] == 0 else 6)
    left = [inbox.take(4) for _ in range(3)]
    assert left == [2, 0, 0]
    taken = [(r["batch"], r["bulletin"]) for r in inbox.taken.orderBy("batch", "bulletin").collect()]
    assert sorted(b for _, b in taken) == list(range(10)) and [b for n, b in taken if n == 1] == [4, 5] and [b for n, b in taken if n == 2] == [8, 9]
    assert inbox.waiting().count() == 0 and inbox.take() == 0


def test_lease_of_several_processes(spark, tmp_path):
    now = [1000.0]
    lease = Lease(spark, str(tmp_path), clock=lambda: now[0])
    assert lease.holder() is None and lease.acquire("a", "new") is None and lease.acquire("a") is None
    now[0] += 100
    assert lease.acquire("b")["owner"] == "a" and not lease.renew("b") and lease.renew("a")
    now[0] += 180
    assert lease.holder()["idle_seconds"] == 180 and lease.acquire("b") is not None
    now[0] += 1
    assert lease.holder() is None and lease.acquire("b", "old") is None and lease.holder()["origin"] == "old" and not lease.renew("a")
    lease.release("a")
    assert lease.holder()["owner"] == "b"
    lease.release("b")
    assert lease.holder() is None


def simulate_lease(log):
    held = None
    for owner, at, kind in log:
        free = held is None or at - held[2] > 180
        own = held is not None and held[0] == owner
        if kind == "acquire" and (own or free):
            held = (owner, held[1] if own else at, at)
        elif kind == "renew" and own:
            held = (owner, held[1], at)
        elif kind == "release" and own:
            held = None
    return held


def test_lease_log_against_a_simulation(spark):
    rng, rows, want = random.Random(4), [], {}
    for k in range(40):
        at, log = 0.0, []
        for _ in range(rng.randint(1, 12)):
            at += rng.choice([1.0, 90.0, 180.0, 181.0, 400.0])
            log.append((rng.choice("abc"), at, rng.choice(["acquire", "acquire", "renew", "release"])))
        rows += [(k, o, t, kind, None, str(t)) for o, t, kind in log]
        want[k] = simulate_lease(log)
    got = {r["key"]: (r["owner"], r["started"], r["heartbeat"]) for r in sync.lease_state(spark.createDataFrame(rows, f"key long, {sync.LEASE}"), 180, "key").collect()}
    assert got == {k: v for k, v in want.items() if v}


PLAN = "bulletin long, number long, date date, state string"


def run_over(spark, tmp_path, n=60, answer=lambda place: ("indexado", None, False), **how):
    from datetime import date

    plan = spark.createDataFrame([(k, k, date(2020, 1, 1), None) for k in range(n)], PLAN)

    def fetch(step):
        rows = [(r["place"], r["bulletin"], *answer(r["place"])) for r in step.collect()]
        return spark.createDataFrame(rows, "place int, bulletin long, outcome string, status int, blocked boolean")

    return SyncRun(plan, fetch, append_batches(f"{tmp_path}/attempts"), **{"pause": lambda seconds: None} | how)


def test_runs_end_as_they_should(spark, tmp_path):
    run = run_over(spark, tmp_path / "a", cap=50, lease=Lease(spark, str(tmp_path / "a")))
    assert run.start()["state"] == sync.RUNNING
    end = run.wait(120)
    assert (end["state"], end["planned"], end["deferred"], end["done"], end["indexado"], end["seconds_left"]) == (sync.DONE, 50, 10, 50, 50, 0) and run.lease.holder() is None
    newest = [r["bulletin"] for r in spark.read.parquet(f"{tmp_path}/a/attempts").collect()]
    assert sorted(newest) == list(range(10, 60))
    blocked = run_over(spark, tmp_path / "b", answer=lambda p: ("error", 403, True) if p == 30 else ("error", 500, False) if p == 3 else ("sin_sumarios", None, False))
    blocked.start()
    end = blocked.wait(120)
    assert (end["state"], end["done"], end["broken"]) == (sync.BLOCKED, 31, 1) and spark.read.parquet(f"{tmp_path}/b/attempts").count() == 31
    shut = run_over(spark, tmp_path / "c", closed=lambda: True)
    shut.start()
    assert shut.wait(60)["state"] == sync.BLOCKED and shut.progress()["done"] == 0
    broken = run_over(spark, tmp_path / "d", answer=lambda p: 1 / 0)
    broken.start()
    assert broken.wait(60)["state"] == sync.FAILED and "ZeroDivisionError" in broken.progress()["message"]


def test_runs_are_cancelled_and_lose_their_lease(spark, tmp_path):
    lease = Lease(spark, str(tmp_path / "l"))
    run = run_over(spark, tmp_path / "e", lease=lease)
    store, run.store = run.store, lambda rows, n: (store(rows, n), run.cancel())
    assert lease.acquire("other") is None and run.start()["state"] == "en_curso_en_otro_proceso"
    lease.release("other")
    run.start()
    assert run.wait(60)["state"] == sync.CANCELLED and run.progress()["done"] == 25 and lease.holder() is None
    assert shutdown([run])[0]["state"] == sync.CANCELLED
    late = run_over(spark, tmp_path / "f", lease=Lease(spark, str(tmp_path / "m")))
    keep, late.store = late.store, lambda rows, n: (keep(rows, n), late.lease.release(late.owner))
    late.start()
    assert late.wait(60)["state"] == sync.FAILED and "lease" in late.progress()["message"]


def test_only_one_of_two_gets_the_lease(spark, tmp_path):
    """Both see it free; the slower one's note has a number that is taken, whatever its clock says."""
    first = Lease(spark, str(tmp_path), clock=lambda: 100.0)
    told = []

    def late_clock():
        if not told:  # between B's look and its note A gets the lease
            told.append(first.acquire("a"))
        return 99.5

    second = Lease(spark, str(tmp_path), clock=late_clock)
    assert second.acquire("b")["owner"] == "a" and told == [None]
    assert first.renew("a") and not second.renew("b") and first.holder()["owner"] == "a"


def test_lease_notes_are_tidied(spark, tmp_path):
    now = [0.0]
    lease = Lease(spark, str(tmp_path), clock=lambda: now[0])
    assert lease.acquire("a") is None
    for _ in range(3 * lease.KEPT):
        now[0] += 1
        assert lease.renew("a")
    assert len(lease._ledger.numbers()) <= 2 * lease.KEPT and lease.holder()["started"] == 0.0
    # who read the ledger long ago can't write a number that was forgotten since
    stale, seen = Lease(spark, str(tmp_path), clock=lambda: now[0]), []
    ledger = stale._ledger
    assert ledger.write(2, {"owner": "late"}) and ledger.last()[1]["owner"] == "a"

    def step(note):
        seen.append(note)
        return None if len(seen) > 1 else {"owner": "late", "origin": None, "started": 0.0, "heartbeat": 0.0}

    last = type(ledger).last
    answers = iter([(2, {"owner": None})])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(ledger), "last", lambda self: next(answers, None) or last(self))
        assert ledger.change(step)[1]["owner"] == "a"
    assert len(seen) == 2 and 3 not in ledger.numbers()


def test_a_run_waits_pauses_and_sums_up(spark, tmp_path):
    from foliograph.operators.ingest import run_counters, sync_summaries

    waits, rested = [5.0, 0.0, 0.0, 0.0], []
    run = run_over(spark, tmp_path / "w", n=60, answer=lambda p: ("error", 502, False) if p == 3 else ("indexado", 200, False), wait_needed=lambda: waits.pop(0) if waits else 0.0, pause=rested.append, summaries=f"{tmp_path}/summaries", lease=Lease(spark, str(tmp_path / "w")))
    run.start()
    end = run.wait(120)
    assert end["state"] == sync.DONE and rested[0] == 5.0 and 30 <= rested[1] <= 60 and len(rested) == 2
    kept = run_counters(spark.read.parquet(f"{tmp_path}/w/attempts")).first().asDict()
    assert {k: end[k] for k in kept} == kept  # observed while written, equal to a second pass
    assert '"done":60' in sync_summaries(spark.read.parquet(f"{tmp_path}/summaries")).first()["summary"]
    full = run_over(spark, tmp_path / "x", wait_needed=lambda: 1.0, summaries=f"{tmp_path}/summaries")
    full.start()
    assert full.wait(60)["state"] == sync.BLOCKED and full.progress()["done"] == 0
    lost = run_over(spark, tmp_path / "y", n=100)
    lost.store = lambda rows, n: rows.write.parquet("/proc/no/such/place")
    lost.start()
    assert lost.wait(120)["state"] == sync.FAILED and lost.progress()["done"] == 0
    none = run_over(spark, tmp_path / "z", n=0)
    assert none.start()["state"] == sync.DONE


def test_shutdown_says_what_is_still_alive(spark, tmp_path):
    lease = Lease(spark, str(tmp_path))
    run = run_over(spark, tmp_path / "s", lease=lease)
    store = run.store
    run.store = lambda rows, n: (time.sleep(6), store(rows, n))
    run.start()
    time.sleep(2)
    [told] = shutdown([run], seconds=0.5)
    assert told["alive"] and told["state"] == sync.CANCELLED and lease.holder() is None


def test_progress_of_streams(spark, log, tmp_path):
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        spark.createDataFrame(log, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
        query = sync_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", append_batches(f"{tmp_path}/log"))
        query.awaitTermination(60)
        for _ in range(50):
            seen = listener.snapshot().get(str(query.runId), {})
            if seen.get("state") == sync.DONE:
                break
            time.sleep(0.2)
        assert seen["state"] == sync.DONE and seen["rows"] == len(log) and seen["batches"] == 1
    finally:
        spark.streams.removeListener(listener)
