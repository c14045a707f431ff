import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from foliograph.llm import quality_classifier as qc
from foliograph.llm._shared import read_table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = qc.query(spark, sf).join(read_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.97


def test_held_out_labels_are_never_learned_from(spark, small):
    docs, labels = read_table(spark, small, "documents"), read_table(spark, small, "labels")
    wrong = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(qc.train(docs, labels).weight, qc.train(docs, wrong).weight)


def test_whole_texts_count_and_blocks_do_not(monkeypatch):
    text = " ".join(random.Random(3).choices(["alpha", "beta", "ñu", "a", "GAMMA!!", "😀x"], k=3000))
    model = qc.QualityModel(np.random.default_rng(1).normal(size=qc.BUCKETS), 0.1)
    whole = sorted(np.concatenate(list(qc.features(text))).tolist())
    score = model.score(text)
    monkeypatch.setattr(qc, "BLOCK", 500)
    assert sorted(np.concatenate(list(qc.features(text))).tolist()) == whole
    assert abs(model.score(text) - score) < 1e-12
    assert model.score(text + " tail") != score


def test_features_against_counting():
    text, n = "ab ab c", 0
    found = np.concatenate(list(qc.features(text)))
    for w in text.split():
        n += 1 + sum(max(0, len(w) + 2 - g + 1) for g in qc.NGRAMS)
    assert len(found) == n + 1 and (found == qc.REPEAT).sum() >= 1
    assert list(qc.features(None)) == [] and sum(map(len, qc.features(" \n"))) == 0


M64 = (1 << 64) - 1


def slow_bucket(h, salt):
    x = (h ^ salt) * 0x9E3779B97F4A7C15 & M64
    x ^= x >> 29
    return (x * 0x9E3779B97F4A7C15 & M64) >> (64 - qc.BUCKETS.bit_length() + 1)


def slow_features(text):
    """Words, n-grams of " word ", and repeats, one by one."""
    found, last = [], None
    for w in re.split("[ \t\n\x0b\x0c\r]+", text or ""):
        if not w:
            continue
        power, whole = 1, 0
        for c in w:
            power = power * 0x100000001B3 & M64
            whole = whole + ord(c) * power & M64
        found.append(slow_bucket(whole, 1))
        for n in qc.NGRAMS:
            for k in range(len(w) + 3 - n):
                h = 0
                for i, c in enumerate(f" {w} "[k : k + n]):
                    h = ((h * 0x100000001B3 if i else 0) + ord(c)) & M64
                found.append(slow_bucket(h, n))
        if whole == last:
            found.append(qc.REPEAT)
        last = whole
    return found


def slow_score(model, text):
    found = slow_features(text)
    z = model.bias + sum(float(model.weight[k]) for k in found) / (len(found) + qc.STILL)
    return 1 / (1 + math.exp(-z))


TEXTS = [None, "", " \n ", "a", "ab ab c", "one two two two three", "ñandú 日本語 😀  ok\tok", "x" * 300, "a b " * 40]


def test_scores_against_counting_one_by_one():
    rng = random.Random(11)
    model = qc.QualityModel(np.random.default_rng(2).normal(size=qc.BUCKETS) * 5, -0.3)
    for text in TEXTS + ["".join(rng.choices("abcé \n", k=rng.randint(1, 200))) for _ in range(60)]:
        got = sorted(np.concatenate([*qc.features(text), np.zeros(0, np.int64)]).tolist())
        assert got == sorted(slow_features(text)), text
        assert abs(model.score(text) - slow_score(model, text)) < 1e-12


def slow_fit(rows, share, epochs, rate, seed):
    """The same descent with loops over numbers."""
    rng = np.random.default_rng(seed)
    vectors = {k: v.tolist() for k, v in enumerate(rng.normal(0, 1 / qc.DIM, (qc.BUCKETS, qc.DIM)))}
    top, bias = rng.normal(0, 0.1, (qc.DIM, 2)).tolist(), [0.0, 0.0]
    have = [sum(r[0] == k for r in rows) / len(rows) for k in (0, 1)]
    weigh = [share[k] / have[k] for k in (0, 1)]
    weigh = [w / max(1.0, *weigh) for w in weigh]
    done = 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, counts = rows[k]
            total = sum(counts.values()) + qc.STILL
            hidden = [sum(n / total * vectors[b][d] for b, n in counts.items()) for d in range(qc.DIM)]
            z = [sum(hidden[d] * top[d][c] for d in range(qc.DIM)) + bias[c] for c in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            p = [x / sum(e) - (c == label) for c, x in enumerate(e)]
            step = rate * (1 - done / (epochs * len(rows))) * weigh[label]
            back = [sum(top[d][c] * p[c] for c in (0, 1)) for d in range(qc.DIM)]
            for d in range(qc.DIM):
                for c in (0, 1):
                    top[d][c] -= step * hidden[d] * p[c]
            for c in (0, 1):
                bias[c] -= step * 0.1 * p[c]
            for b, n in counts.items():
                for d in range(qc.DIM):
                    vectors[b][d] -= step * min(50.0, len(counts)) * n / total * back[d]
            done += 1
    return [sum(vectors[b][d] * (top[d][1] - top[d][0]) for d in range(qc.DIM)) for b in range(qc.BUCKETS)], bias[1] - bias[0]


def test_training_against_loops():
    texts = [(k % 2, f"{'good' if k % 2 else 'bad'} w{k} w{k % 3} tail") for k in range(9)]
    model = qc.fit(np.array([label for label, _ in texts]), [qc.document_counts(text) for _, text in texts], {0: 0.3, 1: 0.7}, epochs=3)
    weight, bias = slow_fit([(label, collections.Counter(slow_features(text))) for label, text in texts], {0: 0.3, 1: 0.7}, 3, 0.8, 7)
    assert np.allclose(model.weight, weight, atol=1e-6) and abs(model.bias - bias) < 1e-6
    assert model.score("good tail") > model.score("bad tail")


def test_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (None, 1, 0), (9, None, 0), (100, 0, 1), (101, 5, 0), (777, 1, 0)], "doc_id long, quality int, toxic int")
    model = qc.train(edge_docs, labels)
    rows = qc.score(edge_docs, model, keep=["doc_id", "lang"]).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}
    assert len(empty) == 1
    assert {r["score"] for r in qc.score(edge_docs, qc.train(edge_docs, labels.limit(0))).collect()} == {0.5}
    assert qc.score(no_docs, model).collect() == []


def test_stage_keeps_columns_and_good_documents(spark, small):
    docs = read_table(spark, small, "documents")
    kept = qc.quality_stage(spark, docs, small)
    assert kept.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, small, "labels").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(q == 1 and d not in ids for d, q in labels.items()) == 0 and sum(q == 0 and d in ids for d, q in labels.items()) <= 2
