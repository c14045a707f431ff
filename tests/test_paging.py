import random

import pytest

from foliograph.operators.paging import InvalidCursor, all_chunks, chunk_at, first_chunk


def whole(texts, budget):
    chunks, cursor = [], (1, 0)
    while cursor:
        pieces, cursor = chunk_at(texts, *cursor, budget)
        chunks.append(pieces)
    return chunks


@pytest.mark.parametrize("seed", range(8))
def test_nothing_is_lost(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab c", k=rng.choice([0, 1, 5, 30, 100]))) for _ in range(rng.randint(1, 9))]
    for budget in (1, 7, 30, 1000):
        chunks = whole(texts, budget)
        assert "".join(p["text"] for c in chunks for p in c) == "".join(texts)
        assert all(sum(len(p["text"]) for p in c) <= budget for c in chunks)


def test_cursors():
    assert chunk_at([], 1, 0) == ([], None)
    for bad in (([], 2, 0), (["ab"], 2, 0), (["ab"], 1, 2), (["ab"], 0, 0), (["ab"], 1, -1)):
        with pytest.raises(InvalidCursor):
            chunk_at(*bad)
    with pytest.raises(InvalidCursor):
        chunk_at(["a"], budget=0)


@pytest.mark.parametrize("budget", [3, 10, 50])
def test_spark_chunks(spark, budget):
    rng = random.Random(budget)
    docs = {d: [rng.choice([0, 1, 4, 10, 23, 60]) for _ in range(rng.randint(1, 8))] for d in range(25)}
    df = spark.createDataFrame([(d, p, n) for d, lengths in docs.items() for p, n in enumerate(lengths, 1)], "doc long, page long, length long")
    got: dict = {}
    for r in all_chunks(df, budget=budget).collect():
        got.setdefault(r["doc"], []).append((r["chunk"], r["page"], r["start"], r["taken"]))
    for d, lengths in docs.items():
        rows = sorted(got[d])
        assert [sum(t for _, p, _, t in rows if p == k) for k in range(1, len(lengths) + 1)] == lengths
        sizes: dict = {}
        for c, _, _, t in rows:
            sizes[c] = sizes.get(c, 0) + t
        assert max(sizes.values()) <= budget
        assert [s for _, p, s, _ in sorted(rows, key=lambda r: (r[1], r[2])) if s == 0].count(0) == len(lengths)
    one = {}
    for r in first_chunk(df, budget=budget).orderBy("doc", "page").collect():
        one.setdefault(r["doc"], []).append((r["page"], r["taken"], r["cut"]))
    for d, lengths in docs.items():
        pieces, _ = chunk_at(["x" * n for n in lengths], 1, 0, budget)
        assert one[d] == [(p["page"], len(p["text"]), p["cut"]) for p in pieces]


def greedy(lengths, budget):
    """Pages put one behind the other, as they come."""
    chunk, used, out = 1, 0, []
    for k, n in enumerate(lengths):
        if n <= budget - used or used == 0 and n <= budget:
            out.append((chunk, k, 0, n))
            used += n
            continue
        first, pieces = chunk + (used > 0), -(-n // budget)
        out += [(first + i, k, i * budget, min(budget, n - i * budget)) for i in range(pieces)]
        chunk, used = first + pieces - 1, (n - 1) % budget + 1
    return out


def test_chunks_by_pointers_are_the_greedy_ones(spark):
    rng = random.Random(6)
    docs = {d: [rng.choice([0, 0, 1, 3, 5, 9, 10, 10, 11, 20, 25, 40]) for _ in range(rng.randint(1, 40))] for d in range(150)}
    docs |= {1000: [7] * 5000, 1001: [0] * 50, 1002: [10**6], 1003: [0, 0, 25, 0, 5, 6]}
    df = spark.createDataFrame([(d, k, n) for d, ns in docs.items() for k, n in enumerate(ns)], "doc long, page long, length long")
    got = [tuple(r) for r in all_chunks(df, budget=10).where("doc <> 1002").collect()]
    assert sorted(got) == sorted((d, *x) for d, ns in docs.items() if d != 1002 for x in greedy(ns, 10))
    assert all_chunks(df.where("doc = 1002"), budget=10).agg({"chunk": "max", "taken": "sum"}).first().asDict() == {"max(chunk)": 100_000, "sum(taken)": 10**6}
    assert all_chunks(df.limit(0)).count() == 0
