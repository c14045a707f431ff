from datetime import date

import pytest
from pyspark.sql import functions as F

from foliograph.operators import ingest

LOG = "bulletin string, seq long, origin string, outcome string, status int, blocked boolean, message string"
CASES = {
    "broken twice": ([("new", "error", 500), ("new", "error", None), ("new", "error", 502)], ("new", "roto", 2)),
    "success stands": ([("new", "indexado", None), ("new", "error", 500), ("new", "error", 500)], ("new", "indexado", 2)),
    "unavailable doesn't count": ([("new", "error", 503), ("new", "error", 503)], ("new", "error", 0)),
    "success resets": ([("new", "error", 500), ("new", "indexado", None), ("new", "error", 404)], ("new", "indexado", 0)),
    "old failure is ignored": ([("new", "error", 500), ("old", "error", 500)], ("new", "error", 1)),
    "old success beats failure": ([("new", "error", 500), ("old", "sin_sumarios", None)], ("old", "sin_sumarios", 0)),
    "tie goes to new": ([("old", "indexado", None), ("new", "indexado", None)], ("new", "indexado", 0)),
    "tie stays with new": ([("new", "indexado", None), ("old", "indexado", None)], ("new", "indexado", 0)),
    "better old one wins": ([("new", "sin_sumarios", None), ("old", "indexado", None)], ("old", "indexado", 0)),
    "new failure against success": ([("old", "indexado", None), ("new", "error", 500)], ("old", "indexado", 0)),
    "new failure takes a failure over": ([("old", "error", 500), ("new", "error", 500)], ("new", "error", 1)),
}


def test_states(spark):
    rows = [(name, k, o, r, st, False, None) for name, (events, _) in CASES.items() for k, (o, r, st) in enumerate(events)]
    got = {r["bulletin"]: (r["origin"], r["state"], r["failures"]) for r in ingest.current_state(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {name: want for name, (_, want) in CASES.items()}


def test_blocked_answers_do_not_count(spark):
    rows = [("a", 1, "new", "error", 500, True, None), ("a", 2, "new", "error", 500, None, None)]
    assert ingest.current_state(spark.createDataFrame(rows, LOG)).first()["failures"] == 1
    assert ingest.current_state(spark.createDataFrame([], LOG)).collect() == []


def test_standing_articles(spark):
    log = [("a", 1, "new", "indexado", None, False, None), ("a", 3, "new", "indexado", None, False, None), ("b", 2, "new", "indexado", None, False, None)]
    versions = spark.createDataFrame([("a", 1, 0, "x"), ("a", 1, 1, "y"), ("a", 3, 0, "y"), ("a", 3, 1, "y"), ("b", 2, 0, "x"), ("b", 2, 1, "y")], "bulletin string, seq long, pos int, article string")
    got = {(r["article"], r["bulletin"], r["pos"]) for r in ingest.current_articles(versions, ingest.current_state(spark.createDataFrame(log, LOG))).collect()}
    assert got == {("x", "b", 0), ("y", "a", 1)}


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([(1, 1, date(2020, 1, 1)), (2, 2, date(2020, 1, 9)), (3, 3, None), (4, 4, date(2020, 1, 8)), (5, 5, date(2019, 1, 1))], "bulletin long, number long, date date")


def test_plan(spark, calendar):
    states = spark.createDataFrame([(2, "indexado", "new"), (3, "error", "new"), (4, "roto", "new"), (5, "indexado", "new")], "bulletin long, state string, origin string")
    plan = lambda **how: {r["bulletin"] for r in ingest.plan(calendar, states, date(2020, 1, 10), **how).collect()}
    assert plan() == {1, 2, 3}
    assert plan(recent_days=0) == {1, 3} and plan(retry_errors=False) == {1, 2} and plan(retry_broken=True) == {1, 2, 3, 4}
    capped = [r["bulletin"] for r in ingest.capped(ingest.plan(calendar, states, date(2020, 1, 10)), 2).collect()]
    assert capped == [1, 2]
    assert tuple(ingest.deferred(ingest.plan(calendar, states, date(2020, 1, 10)), 2).first()) == (3, 1)


def test_plan_old(spark, calendar):
    states = spark.createDataFrame([(1, "indexado", "new"), (2, "sin_sumarios", "new"), (3, "sin_sumarios", "old"), (4, "roto", "old")], "bulletin long, state string, origin string")
    assert {r["bulletin"] for r in ingest.plan_old(calendar, states).collect()} == {2, 5}
    assert {r["bulletin"] for r in ingest.plan_old(calendar, states, retry_broken=True).collect()} == {2, 4, 5}


def test_pauses_and_pace(spark):
    assert ingest.pause_after_error(500, 0.5) == 45 and ingest.pause_after_error(404, 1) == 0 and ingest.pause_after_error(None, 1) == 0
    assert ingest.stops_run(3, 0) and ingest.stops_run(0, 6) and not ingest.stops_run(2, 5)
    row = spark.range(1).select(ingest.remaining_seconds(F.lit(10.0), F.lit(4), F.lit(7)), ingest.remaining_seconds(F.lit(10.0), F.lit(0), F.lit(7))).first()
    assert tuple(row) == (8.0, None)


def test_states_from_batches_are_those_of_the_log(spark, tmp_path):
    """A stream's batches folded onto buckets of states; a batch that comes again changes nothing, a reader keeps its version."""
    import random

    from foliograph.sources.states import StateTable
    from foliograph.streaming.sync import sync_stream

    rng, schema = random.Random(2), "seq long, bulletin long, origin string, outcome string, status int, blocked boolean, message string"
    log = [(k, rng.choice([1, 1, 1, 2, 3, 50, 51]), rng.choice(["new", "old"]), o := rng.choice(["indexado", "sin_sumarios", "error", "error"]), rng.choice([500, 503, None, 404]) if o == "error" else None, False, f"m{k}") for k in range(300)]
    for k in range(0, 300, 100):
        spark.createDataFrame(log[k : k + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        table = StateTable(spark, f"{tmp_path}/own", buckets=4)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        sync_stream(stream, f"{tmp_path}/cp", table.take_in).awaitTermination(120)
    want = sorted(map(str, ingest.current_state(spark.createDataFrame(log, schema)).collect()))
    assert sorted(map(str, table.states.collect())) == want
    old = table.states
    table.take_in(spark.createDataFrame(log[:9], schema), 2)
    assert sorted(map(str, table.states.collect())) == want
    table.take_in(spark.createDataFrame([(999, 777, "new", "indexado", None, False, None)], schema), 3)
    assert old.count() == len(want) and table.vacuum().states.count() == len(want) + 1
    table.take_in(spark.createDataFrame([], schema), 4)
    assert table.states.count() == len(want) + 1
    late = spark.createDataFrame([(1000, 777, "new", "error", 500, False, "x"), (1001, 778, "old", "error", 500, False, "y")], schema)
    assert sorted(map(str, table.take_in(late, 5).states.where("bulletin > 700").collect())) == sorted(map(str, ingest.fold_onto(ingest.current_state(spark.createDataFrame([(999, 777, "new", "indexado", None, False, None)], schema)), late).collect()))
