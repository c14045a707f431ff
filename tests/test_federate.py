import bisect
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from foliograph.operators import federate, locate


def test_gaps(spark):
    listed = spark.createDataFrame([("a", n) for n in (744, 746, 746, 750)] + [("b", 5)], "bulletin string, number long")
    gaps = federate.numbering_gaps(listed)
    assert sorted(tuple(r) for r in gaps.collect()) == [("a", n) for n in (745, 747, 748, 749)]
    assert sorted(r["hidden"] for r in federate.fetchable_gaps(gaps, most=2).collect()) == [745, 747]
    assert [tuple(r)[:2] for r in federate.too_many_gaps(gaps, most=3).collect()] == [("a", 4)]


def test_merging(spark):
    schema = "bulletin string, number long, date date"
    one, two = spark.createDataFrame([("a", 1, date(2020, 1, 1))], schema), spark.createDataFrame([("a", 9, None), ("b", 2, None)], schema)
    assert {tuple(r) for r in federate.merged_catalogue(one, two).collect()} == {("a", 1, date(2020, 1, 1)), ("b", 2, None)}
    assert [r["bulletin"] for r in federate.newest(federate.merged_catalogue(one, two)).collect()] == ["a", "b"]
    hits = spark.createDataFrame([("a", 1, 0, 0), ("a", 0, 1, 3), ("b", 1, 0, 1)], "bulletin string, stream int, page int, pos int")
    assert {(r["bulletin"], r["stream"]) for r in federate.merged_streams(hits).collect()} == {("a", 0), ("b", 1)}


def simulate(bulletins, articles, most_b, most_a):
    out, reviewed, without, reason = [], 0, 0, None
    for b, _, _, failed in sorted(bulletins, key=lambda x: (x[1] or date.min, x[2]), reverse=True):
        if reviewed >= most_b:
            reason = "max_bomes"
            break
        if len(out) >= most_a:
            reason = "max_articulos"
            break
        reviewed += 1
        if failed:
            continue
        own = sorted(a for a in articles if a[0] == b)
        for a in own:
            if len(out) >= most_a:
                reason = "max_articulos"
                break
            out.append(a[2])
        without += not own
        if reason:
            break
    return out, reviewed, without, reason


@pytest.mark.parametrize("seed", range(6))
def test_drill_down(spark, seed):
    rng = random.Random(seed)
    bulletins = [(k, rng.choice([None, date(2020, 1, rng.randint(1, 28))]), k, rng.random() < 0.2) for k in range(8)]
    articles = [(rng.randrange(8), k, 100 + k) for k in range(rng.randint(0, 12))]
    b = spark.createDataFrame(bulletins, "bulletin long, date date, number long, failed boolean")
    a = spark.createDataFrame(articles, "bulletin long, number long, id long")
    for most_b, most_a in ((20, 100), (3, 100), (20, 4), (8, len(articles) or 1), (5, 2)):
        rows, summary = federate.drill_down(b, a, most_b, most_a)
        out, reviewed, without, reason = simulate(bulletins, articles, most_b, most_a)
        got = summary.first()
        assert ([r["id"] for r in rows.orderBy("place").collect()], got["reviewed"], got["without_match"], got["reason"]) == (out, reviewed, without, reason)


def test_budgets_are_checked(spark):
    empty = spark.createDataFrame([], "bulletin long, date date, number long, failed boolean"), spark.createDataFrame([], "bulletin long, number long, id long")
    with pytest.raises(ValueError):
        federate.drill_down(*empty, 0)
    assert federate.drill_down(*empty)[1].first()["reason"] is None


def test_site_parameters():
    got = federate.site_parameters([("sumario", "has", " a ")], "2020-01-01", "2020-02-01", [("bome", 7)])
    assert got[:4] == [("from", "2020-01-01"), ("to", "2020-02-01"), ("contenido[0][type]", "sumario"), ("contenido[0][like]", "like")]
    assert ("numero[0][number]", "7") in got


def test_locate_against_search(spark):
    rng = random.Random(3)
    edges = sorted(rng.sample(range(2000), 60))
    spans = list(zip(edges[::2], edges[1::2], strict=True))
    ranges = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(spans)], "bulletin long, lo long, hi long")
    targets = spark.range(-5, 2100, 7).withColumnRenamed("id", "number")
    for r in locate.locate(targets, ranges).collect():
        holder = next((k for k, (lo, hi) in enumerate(spans) if lo <= r["number"] <= hi), None)
        below = max((k for k, (_, hi) in enumerate(spans) if hi < r["number"]), default=None)
        above = min((k for k, (lo, _) in enumerate(spans) if lo > r["number"]), default=None)
        assert tuple(r)[1:] == ((holder, None, None) if holder is not None else (None, below, above)), r
    tries = locate.candidates(locate.locate(spark.createDataFrame([(25,)], "number long"), spark.createDataFrame([(1, 10, 20), (4, 30, 40)], "bulletin long, lo long, hi long")), spark.createDataFrame([(2,), (3,), (9,)], "bulletin long"))
    assert [r["bulletin"] for r in tries.orderBy("turn").collect()] == [2, 3, 1, 4]
    tried = spark.createDataFrame([(25,), (5,), (99,)], "number long")
    two = spark.createDataFrame([(1, 10, 20), (4, 30, 40)], "bulletin long, lo long, hi long")
    some = locate.candidates(locate.locate(tried, two), spark.createDataFrame([(0,), (2,), (3,), (9,)], "bulletin long"), most=2)
    assert sorted((r["number"], r["turn"], r["bulletin"], r["untried"]) for r in some.collect()) == [(5, 1, 0, 0), (5, 2, 1, 0), (25, 1, 2, 2), (25, 2, 3, 2), (99, 1, 9, 0), (99, 2, 4, 0)]
    short = locate.with_shortcuts(some.where("number = 25"), spark.createDataFrame([(25, 3, 0), (25, 7, 1)], "number long, bulletin long, rank int"), most=2)
    assert sorted((r["turn"], r["bulletin"], r["untried"]) for r in short.collect()) == [(1, 3, 3), (2, 7, 3)]
    pages = spark.createDataFrame([(2, 25, 26), (3, 25, 25), (2, 5, 5)], "bulletin long, asked long, shows long")
    assert [tuple(r) for r in locate.verified(some, pages).collect()] == [(25, 3, 2)]
    assert locate.locate(targets, ranges.limit(0)).where("holder is not null or below is not null or above is not null").count() == 0
    assert [locate.attempts_allowed(n) for n in (1, 2, 3, 9)] == [1, 1, 2, 2]


@pytest.mark.parametrize("seed", range(4))
def test_locate_in_ranges_that_overlap(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(locate, "ROWS", 3)
    spans = [(k, lo, lo + rng.choice([0, 3, 40, 400])) for k, lo in enumerate(rng.randrange(1500) for _ in range(50))]
    rng.shuffle(spans)
    asked = [rng.randrange(-20, 2000) for _ in range(150)] + [700] * 30 + [None]
    got = locate.locate(spark.createDataFrame([(n,) for n in asked], "number long"), spark.createDataFrame(spans, "bulletin long, lo long, hi long"))
    want = []
    for n in asked[:-1]:
        holders = [(hi, k) for k, lo, hi in spans if lo <= n <= hi]
        below, above = max((k for k, _, hi in spans if hi < n), default=None), min((k for k, lo, _ in spans if lo > n), default=None)
        want.append((n, max(holders)[1], None, None) if holders else (n, None, below, above))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan


def test_splits_are_even_where_numbers_crowd(spark):
    """Ten times as many ranges in one corner, one number that many rows have, and one far outlier: no split is above three times the median."""
    rng = random.Random(9)
    numbers = [rng.randrange(10**6) for _ in range(3000)] + [rng.randrange(500, 560) * 1000 + rng.randrange(40) for _ in range(30_000)] + [10**12]
    line = spark.createDataFrame([(n,) for n in set(numbers)], "at long")
    points = locate.split_points(line, "at")
    sizes = sorted(r["count"] for r in line.groupBy(locate.split_of(F.col("at"), points).alias("split")).count().collect())
    assert len(sizes) == len(points) + 1 > 30 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    told = {r["at"]: r["split"] for r in line.select("at", locate.split_of(F.col("at"), points).alias("split")).collect()}
    assert all(split == bisect.bisect_right(points, at) for at, split in told.items())
    assert locate.split_points(line.limit(0), "at") == []
