import math

import numpy as np
import pytest

from foliograph.llm import neighbour_search as ns

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10, every=100):
    """(query_id, rank, vec_id, score) of every query row against every other row."""
    dim, out = 4, []
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for n, (q, v) in enumerate(good):
        if q % every == 0:
            found = sorted((math.sqrt(((x - v) ** 2).sum()), i) for m, (i, x) in enumerate(good) if m != n)[:k]
            out += [(q, rank, i, round(d, 9)) for rank, (d, i) in enumerate(found, 1)]
    return sorted(out)


def answers(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ns.search(df).collect())


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4).astype(np.float32)], 0) for k in range(0, 400, 5)]
    rows += [(k, [1.0, 1.0, 1.0, 1.0], 0) for k in range(1000, 1030)]  # ties
    rows += [(500, None, 0), (600, [0.0] * 4, 0), (700, [1.0, None, 0.0, 0.0], 0), (800, [float("nan"), 1.0, 1.0, 1.0], 0), (900, [float("inf"), 1.0, 1.0, 1.0], 0), (1100, [1.0, 2.0], 0), (None, [1.0] * 4, 0), (200, [9.0] * 4, 0), (5, [1.0] * 4, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as p", "4 as c", "5 as q", "6 as rank")
    assert answers(df) == brute(rows)
    # rows of one id ask and are found, each for itself
    alike = [(100, [1.0, 0.0, 0.0, 0.0], 0), (100, [5.0, 5.0, 0.0, 0.0], 0), (7, [1.0, 1.0, 0.0, 0.0], 0), (7, [1.0, 1.0, 0.0, 0.0], 0)]
    assert answers(spark.createDataFrame(alike, SCHEMA)) == brute(alike) and len(brute(alike)) == 6
    assert ns.search(df.limit(0)).collect() == [] and ns.search(df.where("vec_id = 200").limit(1)).collect() == []


def test_recall_and_scores(spark):
    import duckdb

    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = duckdb.sql(f"select vec_id, embedding from '{path}'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    got = {}
    for r in ns.search(spark.read.parquet(path)).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = wanted = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = {int(ids[k]) for k in np.lexsort((ids, d))[:10]}
        hits, wanted = hits + len(best & set(got[q])), wanted + 10
        assert len(got[q]) == 10 and all(abs(d[ids == v][0] - s) < 1e-9 for v, s in got[q].items())
    assert hits / wanted >= 0.9


def test_partitions_are_balanced_and_keep_neighbours_together():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (150, 8)) for c in rng.normal(0, 3, (12, 8))])
    graph = ns.graph_of(x, 10)
    part = ns.balanced_partition(x, graph, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() <= math.ceil(1.15 * len(x) / 8) and sizes.min() > 0
    assert (part[graph] == part[:, None]).mean() > 0.6


def test_nearest_breaks_ties_by_id():
    ids = np.array([9, 3, 7, 5])
    found = list(ns.nearest(np.array([3]), np.zeros((1, 2)), np.arange(4), ids, np.ones((4, 2)), 2))
    assert ids[found[0][0]].tolist() == [3, 7]


@pytest.mark.parametrize("scale", [1.0, 1e-160, 1e160, 1e200])
def test_nearest_is_exact_at_any_scale(scale):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (300, 6)) * scale
    rows, ids = np.arange(300), rng.integers(0, 50, 300)
    for q, (at, d) in zip(range(0, 300, 7), ns.nearest(rows[::7], x[::7], rows, ids, x, 12), strict=True):
        with np.errstate(over="ignore"):
            want = sorted((np.sqrt(((x[r] - x[q]) ** 2).sum()), ids[r], r) for r in range(300) if r != q)[:12]
        assert [(a, b) for a, b, _ in want] == list(zip(d, ids[at], strict=True))


def test_structure_is_used():
    """With structure a small share of the rows is looked at; without it most are, at the same recall."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 32))
    made = {"structured": centres[rng.integers(0, 200, 20_000)] + 0.3 * rng.normal(size=(20_000, 32)), "none": rng.normal(size=(20_000, 32))}
    shares = {}
    for name, x in made.items():
        router = ns.fit(x[:4096], ns.partitions_for(len(x)))
        filed, routes = router.ranked(x, 1)[:, 0], router.ranked(x[::100], router.probes)
        graph = np.argsort((x**2).sum(1)[None] - 2 * x[::100] @ x.T, axis=1)[:, 1:11]
        recall = (filed[graph][:, :, None] == routes[:, None, :]).any(2).mean()
        shares[name] = np.bincount(filed, minlength=router.b2.size)[routes].sum(1).mean() / len(x)
        assert recall >= 0.93
    assert shares["structured"] < 0.2 < shares["none"]


def test_small_partitions_are_widened(spark, monkeypatch):
    """Partitions of three rows each, one probe: a query still gets ten rows, or all there are."""
    centres = np.eye(32) * 50
    router = ns.Router(np.zeros(32), 1.0, np.eye(32), np.zeros(32), np.eye(32), np.zeros(32), 1)
    monkeypatch.setattr(ns, "fit", lambda x, parts: router)
    rng = np.random.default_rng(3)
    rows = [(100 * c + j, [float(x) for x in np.abs(centres[c] + rng.normal(size=32))], 0) for c in range(32) for j in range(3)]
    for df, n in ((rows, 10), (rows[:6], 5)):
        got = ns.search(spark.createDataFrame(df, SCHEMA)).groupBy("query_id").count().collect()
        assert got and {r["count"] for r in got} == {n}
