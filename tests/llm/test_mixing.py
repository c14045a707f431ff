import itertools
import random

import numpy as np
import pytest

from foliograph.llm import source_mixing as sm


@pytest.mark.parametrize("seed", range(20))
def test_subset_sum_is_best(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 40), rng.randint(1, 4))
    counts = [rng.randint(0, 3) for _ in lengths]
    budget = rng.randint(0, 90)
    took = sm.subset_sum(lengths, counts, budget)
    sums = {sum(n * w for n, w in zip(c, lengths, strict=True)) for c in itertools.product(*(range(c + 1) for c in counts))}
    assert all(0 <= t <= c for t, c in zip(took, counts, strict=True))
    assert int(np.dot(took, lengths)) == max(s for s in sums if s <= budget)


def test_fit_keeps_the_spread_of_lengths():
    lengths, counts = np.arange(1, 200), np.full(199, 50)
    total = int((lengths * counts).sum())
    passes, more = sm.fit_lengths(lengths, counts, 1.5 * total)
    assert passes == 1 and abs(int((more * lengths).sum()) - total // 2) <= 1
    long = lengths > 100
    assert 0.4 < more[long].sum() / counts[long].sum() < 0.6 and 0.4 < more[~long].sum() / counts[~long].sum() < 0.6
    assert sm.fit_lengths(lengths, counts, 2.0 * total)[0] == 2 and sm.fit_lengths(lengths, counts, 2.0 * total)[1].sum() == 0
    big = np.array([3_000_000, 5, 7])
    assert abs(int((sm.fit_lengths(big, np.array([9, 3, 3]), 13_000_012.0)[1] * big).sum()) - 13_000_012) < 3_000_000


def water(sizes, weights, budget, most=2.0):
    """Deal the budget by weight, cap, deal the excess again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = budget
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > most * sizes[s]}
        if not full:
            return target | {s: share * weights[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_against_rules(edge_docs, edge_rows):
    rows = sm.mix(edge_docs, keep=["doc_id", "source", "text"]).collect()
    words = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, text, _, source, _ in edge_rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = water(sizes, weights, 1.5 * sum(sizes.values()))
    taken = {}
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert r["_size"] == words(r["text"]) and r["_source_size"] == sizes[r["source"]] and r["_target"] == pytest.approx(want[r["source"]])
        assert r["_times"] in (0, 1, 2)
        taken[r["source"]] = taken.get(r["source"], 0) + r["_size"] * r["_times"]
    again = sm.mix(edge_docs.repartition(3), keep=["doc_id", "source", "text"]).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), str(r["text"]), r["_times"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    for s in sizes:
        longest = max(words(t) for _, t, _, x, _ in edge_rows if x == s)
        assert abs(taken[s] - want[s]) <= longest


def test_many_documents_come_near_their_targets(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.choice([1, 2, 5, 30, 30, 77]), "en", "hot" if k % 3 else f"s{k % 7}", 0) for k in range(3000)]
    out = sm.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), keep=["source"])
    for r in out.groupBy("source", "_target").agg({"*": "count"}).collect():
        own = out.where(out.source == r["source"]).selectExpr("sum(_size * _times)").first()[0]
        assert abs(own - r["_target"]) <= 1


def test_rows_alike_are_taken_one_by_one(spark):
    """A third of all rows are one row, repeated; another source has two such groups of one length."""
    rows = [(1, "w " * 10, "en", "a", 0)] * 1000 + [(k, "w " * 10, "en", "a", k) for k in range(2, 500)]
    rows += [(7000 + k % 2, f"b{k % 2} " * 7, "en", "b", 0) for k in range(900)] + [(8000 + k, "w " * (1 + k % 9), "en", "c", 0) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    want = water({"a": 14_980, "b": 6300, "c": sum(1 + k % 9 for k in range(700))}, {"a": 3, "b": 1, "c": 2}, 1.5 * (14_980 + 6300 + sum(1 + k % 9 for k in range(700))))
    out = sm.mix(df, keep=["doc_id", "source", "lang"])
    assert out.count() == len(rows) and {r["_times"] for r in out.collect()} <= {0, 1, 2}
    for r in out.groupBy("source").agg({"_target": "max"}).collect():
        taken = out.where(out.source == r["source"]).selectExpr("sum(_size * _times)").first()[0]
        assert r["max(_target)"] == pytest.approx(want[r["source"]]) and abs(taken - want[r["source"]]) <= 10
    tally = lambda d: sorted(map(tuple, d.groupBy("doc_id", "_times").count().collect()))
    assert tally(out) == tally(sm.mix(df.repartition(3), keep=["doc_id", "source", "lang"]))
    assert sm.mixing_stage(spark, df, "").count() == sum(r["_times"] for r in out.collect())


def test_sources_in_turn_and_their_level(spark):
    rng = random.Random(9)
    names = ["".join(rng.choices("aZé~1 日", k=rng.randint(0, 3))) for _ in range(150)]
    sizes = {n: rng.choice([1, 5, 40, 1000]) for n in names}
    df = spark.createDataFrame([("=" + n, 1, v) for n, v in sizes.items()] + [("", 3, 4)], "skey string, size long, n long").repartition(5)
    order = [*sorted(sizes, key=lambda s: [ord(c) for c in s]), None]
    want = water(sizes | {None: 12}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * (sum(sizes.values()) + 12))
    got = {r["skey"][1:] if r["skey"] else None: r["target"] for r in sm.targets(df).collect()}
    assert got == pytest.approx(want)


def test_stage(spark, edge_docs, no_docs):
    out = sm.mixing_stage(spark, edge_docs, "")
    assert out.columns == edge_docs.columns
    times = {}
    for r in sm.mix(edge_docs, keep=["doc_id", "text"]).collect():
        times[(r["doc_id"], r["text"])] = times.get((r["doc_id"], r["text"]), 0) + r["_times"]
    got = {}
    for r in out.collect():
        got[(r["doc_id"], r["text"])] = got.get((r["doc_id"], r["text"]), 0) + 1
    assert got == {k: v for k, v in times.items() if v}
    assert sm.mix(no_docs).collect() == [] and sm.mixing_stage(spark, no_docs, "").collect() == []
