import random

import xxhash
from pyspark.sql import functions as F

from foliograph.llm import components, simhash_dedup as sd
from foliograph.llm.components import connected_components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def slow_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) <= width else [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def test_fingerprints_against_counting(edge_rows):
    for _, text, *_ in edge_rows:
        assert sd.simhash64(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_hashes_are_sparks(spark):
    assert spark.sql("select xxhash64('añ b')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("añ b".encode(), 42)


def test_components_against_brute_force(edge_docs, edge_rows):
    got = sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in sd.simhash_components(edge_docs).collect())
    prints = [(d, slow_fingerprint(t)) for d, t, *_ in edge_rows]
    groups = Union()
    for i, (_, x) in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j][1]).bit_count() <= 2:
                groups.join(i, j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            r = groups.find(i)
            least[r] = min(least.get(r, d), d)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert got == sorted((str(d), signed(x), str(least.get(groups.find(i)))) for i, (d, x) in enumerate(prints))


def test_empty_table(no_docs):
    assert sd.simhash_components(no_docs).collect() == []


def test_links_in_dense_and_sparse_space(spark):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(40)}
    for _ in range(6):  # crowds around a centre, and chains
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([3, 10, 60])):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                v ^= 1 << b
            values.add(v)
        for _ in range(8):
            centre ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(centre)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = sd.links_within_two(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 and r["a"] != r["b"] for r in links)
    want, got = Union(), Union()
    for i, x in enumerate(signed):
        for y in signed[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
                want.join(x, y)
    for r in links:
        got.join(r["a"], r["b"])
    assert [got.find(v) for v in signed] == [want.find(v) for v in signed]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(40)] + [(7000, 7000), (None, 3)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    want = Union()
    for a, b in links:
        if a is not None:
            want.join(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: want.find(n) for n in want.up if want.find(n) != n}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words)} if 0 < len(words) <= 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicate_stage_against_brute_force(spark):
    rng = random.Random(9)
    rows, k = [], 0
    for size in (1, 1, 1, 2, 3, 5, 12, 40):
        base = [f"t{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
            rows.append((k := k + 1, " ".join(words), "en", "s", 1))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in sd.near_duplicate_stage(spark, df, "").collect()}
    groups, sets = Union(), [(d, shingles(t)) for d, t, *_ in rows]
    for i, (d, x) in enumerate(sets):
        groups.find(d)
        for e, y in sets[:i]:
            if len(x & y) >= 0.8 * len(x | y):
                groups.join(d, e)
    assert kept == {d for d, _ in sets if groups.find(d) == d}


def test_near_duplicate_stage_edges(spark, edge_docs, no_docs):
    out = sd.near_duplicate_stage(spark, edge_docs, "")
    rows = out.collect()
    assert out.columns == edge_docs.columns and {r["_th"] for r in rows} == {"x"}
    ids = [r["doc_id"] for r in rows]
    assert ids.count(7) == 1 and 8 not in ids and 1 in ids and 2 not in ids and 3 not in ids  # copies of "same", near copy, upper case
    assert [i for i in ids if i in (4, 5, 6)] == [4]  # all without words
    assert ids.count(None) == 1 and {9, 10, 11, 12} <= set(ids)
    assert sd.near_duplicate_stage(spark, no_docs, "").collect() == []


def kept_by_brute_force(rows):
    groups, sets = Union(), [(d, frozenset(map(hash, shingles(t)))) for d, t, *_ in rows]
    for i, (d, x) in enumerate(sets):
        groups.find(d)
        for e, y in sets[:i]:
            shared = len(x & y)
            if shared >= 0.8 * (len(x) + len(y) - shared):
                groups.join(d, e)
    return {d for d, _ in sets if groups.find(d) == d}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_appended_and_truncated_near_copies(spark):
    rng = random.Random(23)
    word = lambda: f"t{rng.randrange(4000)}"
    rows = []
    for k in range(120):
        base = [word() for _ in range(rng.randint(100, 300))]
        n = int(len(base) * rng.choice([0.17, 0.23, 0.3]))
        texts = [base, base + [word() for _ in range(n)]] if k % 2 else [base, base[: len(base) - n * 4 // 5]]
        rows += [(2 * k + i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"] for r in sd.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    want = kept_by_brute_force(rows)
    assert 130 < len(want) < 230 and got == want


def test_large_groups_of_template_texts(spark):
    """Hundreds of texts alike in most words meet in the same buckets; only those of one group are near copies."""
    rng = random.Random(31)
    template, rows = [f"t{rng.randrange(4000)}" for _ in range(300)], []
    for group in range(150):
        base = list(template)
        for at in rng.sample(range(300), 9):
            base[at] = f"own{group}x{at}"
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randint(1, 2)):
                words[rng.randrange(300)] = f"new{rng.randrange(99999)}"
            rows.append((rng.randrange(1 << 40), " ".join(words), "en", "s", 1))
    got = {r["doc_id"] for r in sd.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    want = kept_by_brute_force(rows)
    assert 100 < len(want) <= 150 and got == want


def test_blocks_of_a_group_against_brute_force(spark, monkeypatch):
    """Groups of one block, bundled, and of many; with and without a large component among the members."""
    rng = random.Random(37)
    monkeypatch.setattr(sd, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(sd, "BLOCK_SHINGLES", 600)
    sets, group = {}, {}
    for g, size in enumerate([90, 7, 3, 2, 2, 6, 20]):
        base = rng.sample(range(10**6), 60)
        for _ in range(size):
            cid = len(sets) + 1
            sets[cid], group[cid] = sorted({*rng.sample(base, rng.randint(46, 58)), *rng.sample(range(10**7), rng.randint(0, 6))}), g
    blocks = lambda g: -(-max(sum(x == g for x in group.values()) / 7, sum(len(sets[c]) for c in sets if group[c] == g) / 600) // 1)
    members = spark.createDataFrame([(c, group[c], len(v), int(blocks(group[c])), v) for c, v in sets.items()], "cid long, grp long, m long, blocks int, shingles array<long>")
    close = lambda a, b: len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})
    want = Union()
    for a in sets:
        for b in sets:
            if a < b and group[a] == group[b] and close(a, b):
                want.join(a, b)
    first = sd.first_links(members)
    rest = sd.rest_links(members.drop("blocks"), sd.with_least(sd.connected_components(first)))
    fresh = sd.rest_links(members.drop("blocks"), spark.createDataFrame([], "node long, root long"))
    single = [c for c in sets if blocks(group[c]) == 1]
    assert len(single) > 4
    for links, of in ((first, single), (first.unionByName(rest), sets), (fresh, sets)):
        got, pairs = Union(), links.collect()
        assert all(close(r["a"], r["b"]) and group[r["a"]] == group[r["b"]] for r in pairs)
        for r in pairs:
            got.join(r["a"], r["b"])
        assert [got.find(c) for c in of] == [want.find(c) for c in of]
    assert 20 < len({want.find(c) for c in sets}) < len(sets)


def test_similar_texts_in_the_middle_of_a_large_bucket(spark, monkeypatch):
    """All classes in one bucket: every pair in it has to be found, not only those with its ends."""
    monkeypatch.setattr(sd, "meetings", lambda classes: classes.select(F.lit(classes.agg(F.min("cid")).first()[0]).alias("a"), F.col("cid").alias("b")))
    monkeypatch.setattr(sd, "BLOCK_MEMBERS", 30)
    rng, rows = random.Random(43), []
    for k in range(80):
        base = [f"t{rng.randrange(4000)}" for _ in range(80)]
        rows += [(3 * k + i, " ".join([*base[: 30 + i], f"new{i}", *base[31 + i :]]), "en", "s", 1) for i in range(2)]
    got = {r["doc_id"] for r in sd.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == kept_by_brute_force(rows) == {3 * k for k in range(80)}


def test_few_distinct_words_with_many_new_ones_behind(spark):
    """Nearly every shingle of the first text is another one, though it has few words; the second has many words more."""
    rng = random.Random(41)
    base = [f"t{rng.randrange(150)}" for _ in range(1000)]
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(base + [f"new{k}" for k in range(245)]), "en", "s", 1)]
    assert kept_by_brute_force(rows) == {1}
    assert [r["doc_id"] for r in sd.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()] == [1]


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Without min-wise bands, SimHash variants alone bring near copies of long texts together; what they bring is compared exactly."""
    monkeypatch.setattr(sd, "_bands", lambda classes: classes.select(F.lit(0).cast("long").alias("key"), "cid").limit(0))
    rng, rows = random.Random(47), []
    for k in range(40):
        base = [f"t{rng.randrange(4000)}" for _ in range(1500)]
        rows += [(2 * k + i, " ".join([*base[: 700 + k], f"new{i}", *base[701 + k :]]), "en", "s", 1) for i in range(2)]
    # one shingle outnumbers all others, so fingerprints are equal, but the texts aren't alike
    rows += [(1000 + i, " ".join(["x"] * 200 + [f"own{i}y{j}" for j in range(60)]), "en", "s", 1) for i in range(3)]
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    near = {2 * k for k in range(40) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 2}
    assert len(near) > 20 and len(set(prints[-3:])) == 1
    got = {r["doc_id"] for r in sd.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {d for d, *_ in rows} - {d + 1 for d in near}


def test_rounds_of_few_links_are_not_shuffled(spark, monkeypatch):
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(40)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    want = {**{k: 0 for k in range(1, 61)}, **{1000 + k: 1000 for k in range(1, 40)}}
    plans, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == want
    assert len(plans) > 2 and not any("Exchange hashpartitioning" in p for p in plans[1:])
    # more than a task's links go the other way, to the same roots
    plans.clear()
    monkeypatch.setattr(components, "TASK_LINKS", 20)
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == want
    assert "Exchange hashpartitioning" in plans[1]
