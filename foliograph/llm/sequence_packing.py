"""Cost-balanced packing of tokenised documents into sequences.

Every document is cut into full sequences and a rest.  Rests are assigned in
descending order, each to the sequence of lowest estimated attention cost
(linear plus quadratic in the pieces' lengths) that has room for it; a rest
that no sequence has room for is cut over the emptiest ones.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import WordMemo, python_ready, read_table, worker_memory

CAPACITY = 2048
END_ID = 1
#: Cost of a piece of n tokens: LINEAR x n + QUADRATIC x n^2, in tokens' units.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Documents that are packed together, on average; a task holds their rests.
GROUP = 4096
#: Words that a worker remembers, at most.
KEEP_WORDS = 1_000_000
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class TokenIds:
    """A text's ids as little-endian unsigned 32-bit bytes.

    The vocabulary's tokenizer lower-cases, and drops white space before anything
    crosses it, so a text's ids are those of its words, one after another; words
    are remembered, and ASCII letters with punctuation behind are the ids of
    both.  Texts that hold a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = WordMemo(self._word, KEEP_WORDS)

    def encode(self, text: bytes) -> bytes:
        ids = array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: bytes) -> bytes:
        head = word.rstrip(PUNCTUATION)
        if head.isalpha() and len(head) < len(word):
            return self.known[head] + self.known[word[len(head) :]]
        return self.encode(word)

    def of(self, text: bytes) -> bytes:
        low = text.lower()
        if b"<|" in low and any(s in low for s in self.special):
            return self.encode(text)
        return b"".join(map(self.known.__getitem__, low.split()))


def cost(length):
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) for rests of ``lengths`` < capacity; sequences count from 0.

    As many sequences as the tokens need.  Descending rests go to the sequence
    of lowest cost with room (ties: the first); one that fits nowhere is cut
    over the sequences with most room.
    """
    total = int(lengths.sum())
    if not total:
        return []
    bins = -(-total // capacity)
    room, load = np.full(bins, capacity, dtype=np.int64), np.zeros(bins)
    out = []
    for k in np.argsort(-lengths, kind="stable"):
        n, start = int(lengths[k]), 0
        while n:
            fits = room >= n
            if fits.any():
                s, take = int(np.argmin(np.where(fits, load, np.inf))), n
            else:
                s = int(np.argmax(room))
                take = int(room[s])
            out.append((int(k), start, take, s))
            room[s] -= take
            load[s] += cost(take)
            n, start = n - take, start + take
    return out


def _cut_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int) -> Iterator[pa.RecordBatch]:
    ids_of = worker_memory(f"ids of {vocabulary}", partial(TokenIds, vocabulary))
    end = np.array([END_ID], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest"]
    for b in batches:
        out: list[tuple] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            data = ids_of.of(text.as_py() or b"") + end
            n, view = len(data) // 4, memoryview(data)
            full = n // capacity * capacity
            out += [(doc, s, capacity, zlib.crc32(view[4 * s : 4 * (s + capacity)]), n, None) for s in range(0, full, capacity)]
            if full < n:
                out.append((doc, full, n - full, None, n, bytes(view[4 * full :])))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 5 + (pa.binary(),), strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 5 + (pa.binary(),), strict=True)], names)


def _pack_batches(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """One task packs its rests; full pieces pass through, a sequence each."""
    first = TaskContext.get().partitionId() << 32
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rests, n = [], 0
    for b in batches:
        full = b.filter(b.column(5).is_null())
        if full.num_rows:
            at = pa.array(np.arange(first + n, first + n + full.num_rows))
            n += full.num_rows
            yield pa.RecordBatch.from_arrays([*full.columns[:5], at, pa.array(np.zeros(full.num_rows, dtype=np.int64))], names)
        rest = b.filter(b.column(5).is_valid())
        rests += zip(*(rest.column(k).to_pylist() for k in (0, 1, 2, 4, 5)), strict=True)
    rests.sort(key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[4]))
    used: dict[int, int] = {}
    out = []
    for k, start, take, s in assign(np.array([r[2] for r in rests], dtype=np.int64), capacity):
        doc, at, _, tokens, ids = rests[k]
        out.append((doc, at + start, take, zlib.crc32(ids[4 * start : 4 * (start + take)]), tokens, first + n + s, used.get(s, 0)))
        used[s] = used.get(s, 0) + take
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids and a closing id 1; null text is empty, so every row has
    at least one piece.  Repeated rows are packed as often as they come; a null
    doc_id stays null; an empty table gives an empty result; other columns
    aren't looked at.  Texts are read once and never shuffled: full pieces
    travel as checksums, rests with their ids, dealt evenly over groups of about
    GROUP documents that one task packs.  A group leaves at most one sequence
    with room, so padding stays below one sequence in some hundreds.
    """
    spark = docs.sparkSession
    python_ready(spark)
    groups = max(1, -(-docs.count() // GROUP))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(partial(_cut_batches, vocabulary=vocabulary, capacity=capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rest binary")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.repartition(groups).mapInArrow(partial(_pack_batches, capacity=capacity), schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents packed."""
    return pack(read_table(spark, sf_dir, "documents"), vocabulary_path())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of everything that came, as ``pack`` gives them (nulls, empty texts, repeated rows, no rows too)."""
    return pack(docs, vocabulary_path())
