import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from foliograph.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, words = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in counted:
            m = 50 + 50 * c.total() * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def key(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_terms_piece_by_piece(monkeypatch):
    text = "Ab-cd_9É ﬁn\x7f日本 x" * 50
    monkeypatch.setattr(ls, "PIECE", 7)
    assert ls.term_counts(text.encode()) == Counter(t.encode() for t in terms(text))


def test_edges_against_brute_force(spark, edge_rows, edge_docs):
    items = [(1, "same CHANGED w1a w2b"), (2, "日本語 ñandú no-id"), (3, None), (4, ""), (5, "..."), (None, "no id"), (6, "a b"), (6, "c d"), (7, "nowhere")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as score", "2 as doc_id", "3 as block")
    got = ls.search(edge_docs.selectExpr("*", "'i' as ids", "1 as rank"), asked).collect()
    assert key(got) == key(brute([r[:2] for r in edge_rows], items))


def test_shards_and_blocks(spark, monkeypatch):
    """Many small shards, few items in a pass, ties, and a third of all rows alike."""
    rng = random.Random(5)
    words = [f"t{k}" for k in range(60)]
    skewed = [1 / (k + 1) for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, skewed, k=rng.randint(1, 60)))) for k in range(1200)] + [(5000 + k, "t7 t8 t50 t7") for k in range(600)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for k in range(25)]
    monkeypatch.setattr(ls, "BLOCK_BYTES", 200)
    shards = []
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = ls.search(frame, spark.createDataFrame(items, "item_id long, text string"), k=7, seen=lambda s: shards.append(s.count())).collect()
    assert key(got) == key(brute(docs, items, 7)) and len(shards) > 1


def test_wand_skips_and_loses_nothing():
    rng = np.random.default_rng(6)
    n = 4000
    lists = []
    for share, ceiling in ((0.9, 40), (0.8, 50), (0.5, 100), (0.05, 900), (0.01, 3000)):
        docs = np.flatnonzero(rng.random(n) < share)
        impacts = rng.integers(1, ceiling + 1, len(docs))
        lists.append(ls.Posting(docs, impacts, int(impacts.max())))
    whole = np.zeros(n, np.int64)
    for p in lists:
        whole[p.docs] += p.impacts
    ids = rng.permutation(n)
    heap = ls.Heap(10)
    ls.wand(lists, ids, np.ones(n, bool), heap)
    best = sorted(zip(-whole, ids, strict=True))[:10]
    assert [(-s, i) for s, i in zip(heap.scores, heap.ids, strict=True)] == best and heap.scored < n / 4
    before = heap.scored
    ls.wand(lists[:2], ids, np.ones(n, bool), heap)  # nothing of these can get in
    assert heap.scored == before


def test_empty_tables(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert ls.search(edge_docs, none).collect() == [] and ls.search(no_docs, some).collect() == []


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    assert key(ls.query(spark, small).collect()) == key(con.execute(ls.ORACLE).fetchall())
