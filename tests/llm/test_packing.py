import random
import zlib

import numpy as np
import pytest

from foliograph.llm import sequence_packing as sp

STRANGE = list("abABÉñŉſĳIJ'’é́İΣςK  \t\n\x0b\x1c 　<|>endoftext19½中😀-_,.") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'S", "'re", "\r\n"]


@pytest.fixture(scope="module")
def ids():
    return sp.TokenIds(sp.vocabulary_path())


def reference(ids, text):
    return np.array([*ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_ids_are_the_tokenizers(ids):
    rng = random.Random(5)
    for _ in range(6000):
        text = "".join(rng.choices(STRANGE, k=rng.randint(0, 14)))
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(10))
def test_assignment(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randint(1, 2047) for _ in range(rng.randint(1, 200))])
    pieces = sp.assign(lengths)
    fill, got = {}, dict.fromkeys(range(len(lengths)), 0)
    for k, start, n, s in pieces:
        assert start == got[k] and n > 0
        got[k] += n
        fill[s] = fill.get(s, 0) + n
    assert [got[k] for k in range(len(lengths))] == lengths.tolist()
    assert max(fill.values()) <= 2048 and len(fill) == -(-lengths.sum() // 2048)


def test_costs_are_more_even_than_first_fit():
    rng = random.Random(1)
    lengths = np.array(sorted((rng.choice([30, 200, 900, 1500]) for _ in range(400)), reverse=True))
    load = {}
    for _, _, n, s in sp.assign(lengths):
        load[s] = load.get(s, 0) + sp.cost(n)
    room, first = [], []
    for n in lengths:
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            k = len(room)
            room.append(2048)
            first.append(0.0)
        room[k] -= n
        first[k] += sp.cost(n)
    assert np.std(list(load.values())) < np.std(first)


def test_pieces_against_tokenizing_whole_texts(ids, edge_docs, edge_rows):
    rows = sp.pack(edge_docs, sp.vocabulary_path()).collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    want = {}
    for doc, text, *_ in edge_rows:
        want.setdefault((doc, len(reference(ids, text))), []).append(text)
    assert set(by) == set(want)
    for key, texts in want.items():
        got = sorted((r["start"], r["length"], r["ids_crc32"]) for r in by[key])
        assert sum(n for _, n, _ in got) == sum(len(reference(ids, t)) for t in texts)
        if len(texts) == 1:
            tokens, at = reference(ids, texts[0]), 0
            for start, n, crc in got:
                assert start == at and zlib.crc32(tokens[start : start + n].tobytes()) == crc
                at += n
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
    assert len(ends) <= sum(ends.values()) / 2048 + 1


def test_empty_table(no_docs):
    assert sp.pack(no_docs, sp.vocabulary_path()).collect() == []
