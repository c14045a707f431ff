import random

import pytest

from foliograph.llm import token_counts as tc


def brute(pieces, word):
    """The best segmentation by trying all: (score, -tokens)."""
    text = tc.SPACE + word
    floor = min(pieces.values()) - tc.UNKNOWN_PENALTY
    best = {0: (0, 0)}
    for end in range(1, len(text) + 1):
        options = [(best[end - 1][0] + floor, best[end - 1][1] - len(text[end - 1].encode()))]
        options += [(best[s][0] + pieces[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in pieces]
        best[end] = max(options)
    return -best[len(text)][1]


@pytest.fixture(scope="module")
def pieces():
    return tc.load_pieces(tc.vocabulary_path())


def test_counts_against_brute_force(pieces):
    rng = random.Random(3)
    counts = tc.TrieCounts(pieces)
    for _ in range(1500):
        word = "".join(rng.choices("abcdehinorst", k=rng.randint(1, 14))) + rng.choice(["", ",", "ñ", "中", "😀", "s"])
        assert counts[word.encode()] == brute(pieces, word)
    long = "".join(rng.choices("abcdeé", k=200))
    assert counts[long.encode()] == brute(pieces, long)


def test_shared_prefixes_are_worked_out_once(pieces):
    counts = tc.TrieCounts(pieces)
    for w in (b"national", b"nation", b"nations", b"national"):
        counts[w]
    assert counts.worked == len("▁national") + 1  # the s of nations


def test_scores_are_the_files_own(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tc.vocabulary_path())
    for piece in ("▁the", "▁nation", "s"):
        assert pieces[piece] == round(model.get_score(model.piece_to_id(piece)) * tc.UNIT)
    assert pieces["▁"] == min(pieces.values()) and "▁▁" not in pieces
    assert not {"<s>", "</s>", "<unk>", "<0x41>"} & set(pieces)


@pytest.mark.parametrize("n", [62, 63, 64, 65, 66, 300])
def test_words_deeper_than_the_trie(pieces, n):
    rng = random.Random(n)
    counts = tc.TrieCounts(pieces)
    words = ["".join(rng.choices("abcdeé日", k=n)) for _ in range(20)]
    words += [w[:40] + x for w in words for x in ("s", "tions and more of that")]
    assert [counts[w.encode()] for w in words] == [brute(pieces, w) for w in words]


def test_small_memory_gives_the_same(pieces, monkeypatch):
    words = [f"w{k}x".encode() for k in range(200)]
    want = [tc.TrieCounts(pieces)[w] for w in words]
    monkeypatch.setattr(tc, "NODES", 20)
    monkeypatch.setattr(tc, "WORDS", 5)
    counts = tc.TrieCounts(pieces)
    assert [counts[w] for w in words] == want


def test_documents(edge_docs, edge_rows, no_docs, pieces):
    counts = tc.TrieCounts(pieces)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in tc.token_counts(edge_docs, tc.vocabulary_path()).collect())
    want = [(str(d), len(w := (t or "").encode().split()), sum(counts[x] for x in w)) for d, t, *_ in edge_rows]
    assert got == sorted(want)
    assert tc.token_counts(no_docs, tc.vocabulary_path()).collect() == []
