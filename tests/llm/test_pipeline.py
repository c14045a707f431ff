import zlib

import corpus_pipeline
import numpy as np
from foliograph.llm import catalog, sequence_packing as sp
from foliograph.llm._shared import read_table
from foliograph.llm.quality_classifier import train

from test_mixing import water
from test_quality import slow_score
from test_simhash import kept_by_brute_force

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "packing"]
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_run_is_its_stages_one_after_another(spark, small, tmp_path):
    docs, kept = read_table(spark, small, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
    assert all(d.columns == DOCUMENTS for d in kept[:-1])
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").distinct().collect()) for d in kept]
    assert set(ids[1]) < set(ids[0]) and set(ids[2]) <= set(ids[1]) and ids[3] == ids[2]
    # each document of the mix is packed whole, as often as the mix took it
    times = {r["doc_id"]: r["count"] for r in kept[2].groupBy("doc_id").count().collect()}
    for r in kept[3].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect():
        assert r["sum(length)"] == times[r["doc_id"]] * r["max(doc_tokens)"]
    pieces = lambda d: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in d.collect())
    assert pieces(corpus_pipeline.run(spark, small)) == pieces(kept[3])


def test_stages_on_edges(spark, edge_docs, no_docs, small, tmp_path):
    for name, rows in (("edge", edge_docs), ("none", no_docs)):
        docs = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert (docs.count() > 0) == (name == "edge")


def test_run_against_brute_force(spark, small):
    """Every stage done once more, document by document: scores, all pairs of texts, the deal of words, the tokenizer."""
    docs, labels = read_table(spark, small, "documents"), read_table(spark, small, "labels")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    model = train(docs, labels)
    good = [r for r in rows if slow_score(model, r[1]) >= 0.5]
    left = kept_by_brute_force(good)
    kept = {r[0]: r for r in good if r[0] in left}
    pieces = corpus_pipeline.run(spark, small).collect()
    # the mix: sources near their targets, no document more than twice
    ids = sp.TokenIds(sp.vocabulary_path())
    tokens = {d: np.array([*ids.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, r in kept.items()}
    assert {p["doc_id"] for p in pieces} <= set(kept)
    times = {d: 0 for d in kept}
    for p in pieces:
        own = tokens[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        times[p["doc_id"]] += p["length"]
    assert all(n % len(tokens[d]) == 0 and n // len(tokens[d]) <= 2 for d, n in times.items())
    words = {d: len((r[1] or "").encode().split()) for d, r in kept.items()}
    sizes, taken = {}, {}
    for d, r in kept.items():
        sizes[r[3]] = sizes.get(r[3], 0) + words[d]
        taken[r[3]] = taken.get(r[3], 0) + words[d] * times[d] // len(tokens[d])
    order = [*sorted(s for s in sizes if s is not None), *[None] * (None in sizes)]
    want = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(words[d] for d, r in kept.items() if r[3] == s)
    # the packing: no gap, no overlap, little padding
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= sum(ends.values()) / 2048 + 1
