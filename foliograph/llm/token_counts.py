"""Token counts by a trie-shared dynamic programme.

Distinct pre-tokens go into a trie; the unigram forward score (the best
segmentation of everything up to a node, and its number of tokens) is worked
out once for each node, so words that begin alike share the work, and the
count is stored where a word ends.  Pieces have the scores that the vocabulary
file gives them; nothing is estimated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import python_ready, read_table, worker_memory

#: Stands for the space before a word, as in the vocabulary's pieces.
SPACE = "▁"
#: Scores are whole millionths, so that sums are exact and ties are ties.
UNIT = 1_000_000
#: A character that no piece covers scores so much less than the rarest piece, and counts as its bytes.
UNKNOWN_PENALTY = 10 * UNIT
#: Scores below that are the file's way to say that a piece is never made.
LEAST = -1e8
#: Nodes and words that a worker keeps before it starts anew; how deep the trie is, beyond which a word's work is not shared.
NODES, WORDS, DEPTH = 1_000_000, 600_000, 64
#: Tokens that a value has room for.
PACK = 1 << 40


def load_pieces(path: str) -> dict[str, int]:
    """Piece -> score (in units) as a sentencepiece vocabulary states it.

    Control, byte and unused pieces, and those that are never made, are left
    out; a character of that kind is a piece all the same, below all others.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    scores = {model.id_to_piece(i): model.get_score(i) for i in usable}
    stated = {p: round(s * UNIT) for p, s in scores.items() if s > LEAST}
    floor = min(stated.values()) - UNKNOWN_PENALTY
    return {p: floor for p in scores if len(p) == 1} | stated


class TrieCounts(dict):
    """Word (UTF-8 bytes) -> tokens of its best segmentation; fewest tokens among equally good ones.

    Nodes are numbers; ``ways`` leads from a node and a character to the next
    node.  A node's value is one whole number, score x PACK - tokens, so that
    adding a piece is one sum, and the greater of two values is the better
    score, or with equal scores the fewer tokens.
    """

    def __init__(self, pieces: dict[str, int]):
        #: endings of pieces -> value of the piece, or None if it is no piece itself
        self.gains: dict[str, int | None] = {p[k:]: None for p in pieces for k in range(len(p))}
        self.gains |= {p: score * PACK - 1 for p, score in pieces.items()}
        self.longest = max(map(len, pieces))
        self.unknown = (min(pieces.values()) - UNKNOWN_PENALTY) * PACK
        self.worked = 0
        self._anew()

    def _anew(self) -> None:
        self.clear()
        self.ways: dict[int, int] = {}
        self.best = [0]

    def _step(self, text: str, end: int, before: list[int]) -> int:
        """The value of text[:end]; ``before[-j]`` is that of the text without its last j characters."""
        self.worked += 1
        found, gains = before[-1] + self.unknown - len(text[end - 1].encode("utf-8", "replace")), self.gains
        for j in range(1, min(end, self.longest) + 1):
            gain = gains.get(text[end - j : end], 0)
            if gain == 0:  # no piece ends like that
                break
            if gain is not None and before[-j] + gain > found:
                found = before[-j] + gain
        return found

    def __missing__(self, word: bytes) -> int:
        """Insert a word: nodes that are there give their values, others are worked out; below DEPTH no nodes are made."""
        text = SPACE + word.decode("utf-8", "replace")
        if len(self) >= WORDS or len(self.best) >= NODES:
            self._anew()
        node, ways, best, before = 0, self.ways, self.best, [0]
        for end, char in enumerate(text, 1):
            if end > DEPTH:
                value = self._step(text, end, before)
                if len(before) > 2 * self.longest:
                    del before[: self.longest]
            else:
                key = node << 21 | ord(char)
                node = ways.get(key, 0)
                if not node:
                    node = ways[key] = len(best)
                    best.append(self._step(text, end, before))
                value = best[node]
            before.append(value)
        count = -before[-1] % PACK
        if len(text) <= DEPTH:
            self[word] = count
        return count


def _count_batches(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    counts = worker_memory(f"counts of {vocabulary}", lambda: TrieCounts(load_pieces(vocabulary)))
    for b in batches:
        n_words, n_tokens = [], []
        for text in b.column(1).cast(pa.binary()):
            words = (text.as_py() or b"").split()
            n_words.append(len(words))
            n_tokens.append(sum(map(counts.__getitem__, words)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every whole text; null and empty texts have none.

    Pre-tokens are words between ASCII white space, each with the space mark
    before it.  One pass, no shuffle: a worker's trie, of bounded size, holds
    the distinct pre-tokens of the texts it has read, so that none is sent
    anywhere and a hot one costs a look-up.  Repeated rows come back as often as
    they came, ties score alike and count fewest tokens, a null id stays null,
    an empty table gives an empty result; other columns aren't looked at.
    """
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_count_batches, vocabulary=vocabulary), "doc_id long, n_words long, n_tokens long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: token counts of all documents."""
    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary_path())
