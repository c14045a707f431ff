"""Quality classifier: supervised subword embeddings.

Words, their character n-grams and "a word follows itself" are hashed into
buckets; a learned vector stands in each bucket, a document is the average of
its features' vectors, and a softmax over two classes is learned on top, all by
numpy stochastic gradient descent on a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ._shared import python_ready, read_table

#: Buckets of hashed features, their vectors' width, and lengths of character n-grams.
BUCKETS = 1 << 15
DIM = 16
NGRAMS = (2, 3, 4)
#: Labelled documents of each class to learn from, at most; the ones of least hash are taken.
PER_CLASS = 2000
#: Zero vectors that every average takes in besides, so that a few letters don't decide alone.
STILL = 10
#: Bucket of "this word is the one before it".
REPEAT = 0
#: Characters that are looked at in one go; blocks end between words, and a longer word is cut there.
BLOCK = 1 << 20
_SPREAD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def _buckets(hashes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(salt)) * _SPREAD
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _SPREAD) >> _SHIFT).astype(np.int64)


def features(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a whole text's features, repeats included, block by block.

    Features are words, the n-grams of characters of each word with a space
    before and behind, and words that repeat the one before.
    """
    text, at, last = text or "", 0, None
    while at < len(text):
        end = min(len(text), at + BLOCK)
        if end < len(text):
            end = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end)) if text.find(" ", at + 1, end) > 0 or text.find("\n", at + 1, end) > 0 else end
        points = np.frombuffer(f" {text[at:end]} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        at = end
        gap = (points == 32) | ((points >= 9) & (points <= 13))
        points[gap] = 32
        inside = ~gap
        found = []
        for n in NGRAMS:
            if len(points) < n:
                continue
            size = len(points) - n + 1
            h, whole = points[:size].copy(), np.ones(size, dtype=bool) if n > 2 else inside[:size] | inside[1 : size + 1]
            for k in range(1, n):
                h *= _STEP
                h += points[k : size + k]
                if k < n - 1:
                    whole &= inside[k : size + k]
            found.append(_buckets(h[whole], n))
        starts = np.flatnonzero(inside[1:] & gap[:-1]) + 1
        if len(starts):
            letters = np.flatnonzero(inside)
            lengths = np.flatnonzero(gap[1:] & inside[:-1]) + 1 - starts
            place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            powers = np.cumprod(np.full(int(lengths.max()), _STEP, dtype=np.uint64))
            words = np.add.reduceat(points[letters] * powers[place], np.cumsum(lengths) - lengths)
            found.append(_buckets(words, 1))
            again = int((words[1:] == words[:-1]).sum()) + int(last is not None and words[0] == last)
            found.append(np.full(again, REPEAT, dtype=np.int64))
            last = words[-1]
        if found:
            yield np.concatenate(found)


def document_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) over the whole text."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for ids in features(text):
        counts += np.bincount(ids, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found.astype(np.uint16), counts[found].astype(np.float32)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [document_counts(t.as_py()) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x, _ in pairs], pa.binary()), pa.array([y.tobytes() for _, y in pairs], pa.binary())], ["doc_id", "quality", "at", "n"])


@dataclass(frozen=True)
class QualityModel:
    """``weight[k]``: how far bucket k's vector moves the log-odds of class 1; ``bias``: the log-odds of an empty text."""

    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for ids in features(text):
            total, n = total + float(self.weight[ids].sum()), n + len(ids)
        z = self.bias + total / (n + STILL)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def fit(labels: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], share: dict[int, float], epochs: int = 12, rate: float = 0.8, seed: int = 7) -> QualityModel:
    """Learn from documents' labels and (buckets, counts); ``share``: the classes' shares of all training labels, which weigh the sample."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    top, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    have = np.bincount(labels, minlength=2) / max(1, len(labels))
    weigh = [share.get(k, 0) / have[k] if have[k] else 0.0 for k in (0, 1)]
    weigh = [w / max(1.0, *weigh) for w in weigh]
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for k in rng.permutation(len(labels)):
            label, ids, part = labels[k], counts[k][0].astype(np.int64), counts[k][1].astype(np.float64)
            part /= part.sum() + STILL
            hidden = part @ vectors[ids] if len(ids) else np.zeros(DIM)
            z = hidden @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            step = rate * (1 - done / steps) * weigh[label]
            back = top @ p
            top -= step * np.outer(hidden, p)
            bias -= step * 0.1 * p
            if len(ids):
                # features are averaged, so a bucket's share of the gradient is tiny; it is scaled up by the features' number, at most 50
                vectors[ids] -= step * min(50.0, float(len(ids))) * np.outer(part, back)
            done += 1
    log_odds = vectors @ (top[:, 1] - top[:, 0])
    return QualityModel(log_odds, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Learn from at most ``per_class`` labelled documents of each class, whole texts.

    Labels other than 0 and 1, and null ids, are not used; of an id with several
    labels the least counts; of rows that share an id one is learned from.  Only
    that bounded sample reaches the driver, as bucket counts.  Without labels,
    or without documents of them, the model scores everything 0.5.
    """
    python_ready(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    taken = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    sample = F.broadcast(taken[0].unionByName(taken[1]))  # 2 x per_class rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.join(sample, "doc_id").select("doc_id", "quality", "text").mapInArrow(_count_batches, "doc_id long, quality int, at binary, n binary")
    first = counted.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "n"))).where("k = 1")
    # as columns, not as rows: the driver holds the sample's bytes once
    rows = first.select("doc_id", "quality", "at", "n").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return QualityModel(np.zeros(BUCKETS), 0.0)
    numbers = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) if x.as_buffer() else np.zeros(0, kind) for x in rows[name]]
    return fit(rows["quality"].to_numpy(), list(zip(numbers("at", np.uint16), numbers("n", np.float32), strict=True)), {k: v / total for k, v in share.items()})


def probability(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    """Probability of class 1, over whole texts.  Only texts go to Python and only numbers come back; a row's other columns wait in the JVM."""
    python_ready(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([held.value.score(t.as_py()) for t in texts], pa.float64())

    return of(text.cast("string"))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document and its ``score`` (probability of class 1) over its whole text.

    Null and empty texts are scored by the bias alone.  No other column is an
    input.  Equal texts have equal scores, repeated rows come back as often as
    they came, an empty table gives an empty result; columns that aren't kept
    don't matter, whatever their names.  Of a word longer than BLOCK the parts
    are words.
    """
    return docs.select(*(F.col(f"`{c}`") for c in keep), probability(docs.sparkSession, model, F.col(f"`{text_col}`")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document's score; learned from rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    found = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored 0.5 or more; all columns, whole texts.

    As ``score``: null and empty texts go by the bias, repeated rows stay or go
    together, an empty table stays empty, columns of any name come back.
    """
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(probability(spark, model, F.col("text")) >= 0.5)
