"""Ranked lexical search: WAND over shards of documents.

A task deals its documents into shards of bounded size.  A shard is one row: its
documents' ids and lengths, and for each term that a query asks for the
documents that hold it, in order, and how often.  When all shards are written
and counted, each term has its weight, and each of a shard's lists the greatest
score it can give (its ceiling).  A query goes through a shard with the score of
its k-th best document so far as the floor: the lists whose ceilings together
stay below it can't lift a document by themselves, so the pivot is where the
ceilings of what follows fall below the floor, and only documents of lists
before it are looked at; of those, the ones whose own lists' ceilings don't
reach the floor are skipped, and the others are scored, most promising first,
while the floor rises.  A task's heaps live on from shard to shard; the heaps of
all tasks are merged in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._shared import cut, python_ready, read_table

#: Documents and postings of a shard at most (a document's own postings aren't parted), and documents that are scored at once.
SHARD_DOCS, SHARD_POSTINGS, TOGETHER = 4096, 1 << 18, 256
#: Bytes of query texts that one pass over the documents answers; more go in further blocks.
BLOCK_BYTES = 8 << 20
#: Characters of a text that are split into words at once.
PIECE = 1 << 20

#: Byte -> itself, its lower case if it is one of A-Z, or a space if it parts terms.
FOLDED = bytes(c | 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

SHARD = "ids array<long>, lengths array<long>, terms array<int>, sizes array<int>, docs array<int>, counts array<int>"
HITS = "item_id long, doc_id long, score long"


def term_counts(text: bytes) -> Counter:
    """Term -> occurrences in a UTF-8 text, piece by piece."""
    folded, found, start = text.translate(FOLDED), Counter(), 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        found.update(folded[start:end].split())
        start = end
    return found


@dataclass
class _Filling:
    """A shard that documents are being put into."""

    ids: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    terms: list = field(default_factory=list)
    docs: list = field(default_factory=list)
    counts: list = field(default_factory=list)

    def add(self, doc_id, length: int, held: list[tuple[int, int]]) -> None:
        for term, count in held:
            self.terms.append(term)
            self.docs.append(len(self.ids))
            self.counts.append(count)
        self.ids.append(doc_id)
        self.lengths.append(length)

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.terms) >= SHARD_POSTINGS

    def row(self) -> pa.RecordBatch:
        terms = np.array(self.terms, np.int32)
        order = np.argsort(terms, kind="stable")  # documents stay in order
        names, sizes = np.unique(terms, return_counts=True)
        columns = [pa.array(self.ids, pa.int64()), pa.array(self.lengths, pa.int64()), *(pa.array(np.asarray(x, np.int32)) for x in (names, sizes, np.array(self.docs, np.int32)[order], np.array(self.counts, np.int32)[order]))]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["ids", "lengths", "terms", "sizes", "docs", "counts"])


def _fill(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    number = vocabulary.value
    shard = _Filling()
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            found = term_counts(text.as_py() or b"")
            if found:
                shard.add(doc_id, found.total(), [(number[t], c) for t, c in found.items() if t in number])
            if shard.full:
                yield shard.row()
                shard = _Filling()
    if shard.ids:
        yield shard.row()


# --- WAND in a shard ---------------------------------------------------------


@dataclass
class Heap:
    """The best k documents that a query has met: scores and ids, best first; a null id stands before others."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    named: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    #: how many documents were scored
    scored: int = 0

    @property
    def floor(self) -> int:
        """The least score that can still get in; an equal one can, by its id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def push(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        self.scored += len(scores)
        fit = scores >= self.floor
        scores, ids, named = (np.concatenate(x) for x in ((self.scores, scores[fit]), (self.ids, ids[fit]), (self.named, named[fit])))
        best = np.lexsort((ids, named, -scores))[: self.k]
        self.scores, self.ids, self.named = scores[best], ids[best], named[best]


@dataclass(frozen=True)
class Posting:
    """A term's list in a shard: documents in order, what the term adds to each one's score, and the most it adds."""

    docs: np.ndarray
    impacts: np.ndarray
    ceiling: int

    def at(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``docs`` the list holds, and where."""
        place = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return self.docs[place] == docs, place


def wand(lists: Sequence[Posting], ids: np.ndarray, named: np.ndarray, heap: Heap) -> None:
    """Put the documents of a shard that belong among the query's best into ``heap``."""
    lists = sorted(lists, key=lambda p: -p.ceiling)
    after = np.cumsum([0, *(p.ceiling for p in reversed(lists))])[::-1]  # what lists k, k+1, ... can add together
    pivot = int((after >= heap.floor).sum())  # a document of none of the lists before it stays below the floor
    if not pivot:
        return
    bounds = np.zeros(len(ids), np.int64)
    for p in lists[:pivot]:
        bounds[p.docs] += p.ceiling
    docs = np.flatnonzero(bounds)
    bounds = bounds[docs]
    for k, p in enumerate(lists[pivot:], pivot):
        near = bounds + after[k] >= heap.floor
        docs, bounds = docs[near], bounds[near]
        if not len(docs):
            return
        bounds = bounds + np.where(p.at(docs)[0], p.ceiling, 0)
    order = np.argsort(-bounds, kind="stable")
    docs, bounds = docs[order], bounds[order]
    start = 0
    while start < len(docs) and bounds[start] >= heap.floor:
        some = np.sort(docs[start : start + TOGETHER][bounds[start : start + TOGETHER] >= heap.floor])
        scores = np.zeros(len(some), np.int64)
        for p in lists:
            held, place = p.at(some)
            scores += np.where(held, p.impacts[place], 0)
        heap.push(scores, ids[some], named[some])
        start += TOGETHER


@dataclass(frozen=True)
class Plan:
    """What all tasks know: each query's terms, terms' weights, how many documents and terms there are."""

    items: list[tuple[int | None, list[int]]]
    weights: dict[int, int]
    documents: int
    words: int
    k: int


def _numpy(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def postings(shard: dict[str, np.ndarray], plan: Plan) -> dict[int, Posting]:
    """The shard's lists with what they add to scores, by term; terms without weight have none."""
    damp = 50 + (50 * shard["lengths"] * plan.documents) // plan.words
    found, ends = {}, np.cumsum(shard["sizes"])
    for term, size, end in zip(shard["terms"].tolist(), shard["sizes"].tolist(), ends.tolist(), strict=True):
        if weight := plan.weights[term]:
            docs, tf = shard["docs"][end - size : end], shard["counts"][end - size : end].astype(np.int64)
            impacts = weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * damp[docs]))
            found[term] = Posting(docs, impacts, int(impacts.max()))
    return found


def _rank(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    plan = shared.value
    heaps = [Heap(plan.k) for _ in plan.items]
    for b in batches:
        for row in range(b.num_rows):
            shard = {name: _numpy(b.column(k), row) for k, name in enumerate(b.schema.names) if name != "ids"}
            own = b.column(0)[row].values
            ids, named = own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False)
            known = postings(shard, plan)
            for (_, terms), heap in zip(plan.items, heaps, strict=True):
                if lists := [known[t] for t in terms if t in known]:
                    wand(lists, ids, named, heap)
    for (item, _), heap in zip(plan.items, heaps, strict=True):
        if len(heap.ids):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(heap.ids), pa.int64()), pa.array(heap.ids, mask=~heap.named), pa.array(heap.scores)], ["item_id", "doc_id", "score"])


# --- over all documents ------------------------------------------------------


def weight(documents: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def _best(hits: DataFrame, k: int, *by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item_id", *by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def _answered(docs: DataFrame, items: dict[int | None, set[bytes]], k: int, seen: Callable[[DataFrame], None] | None) -> DataFrame:
    """One block of queries against all documents."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    number = {t: i for i, t in enumerate(sorted(set().union(*items.values())))}
    index = cut(docs.mapInArrow(partial(_fill, vocabulary=sc.broadcast(number)), SHARD))
    if seen:
        seen(index)
    size = index.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    # as many rows as the block's queries have terms
    held = {r["term"]: r["n"] for r in index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("n")).collect()}
    plan = Plan([(i, sorted(number[t] for t in terms)) for i, terms in items.items()], {t: weight(size[0], n) for t, n in held.items()}, size[0] or 0, size[1] or 1, k)
    hits = index.mapInArrow(partial(_rank, shared=sc.broadcast(plan)), HITS)
    groups = math.ceil(math.sqrt(max(1, index.rdd.getNumPartitions())))
    hits = hits.withColumn("group", F.spark_partition_id() % groups)
    return _best(_best(hits, k, "group").drop("rank"), k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seen: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The k best documents for each item: item_id, rank (int, from 1), doc_id, score (long).

    Terms are runs of letters, digits and what isn't ASCII, A-Z lower-cased; an
    item's terms count once each.  All documents are looked at, whole, and all
    items, as many in a pass as BLOCK_BYTES of their texts hold, so that what is
    broadcast is bounded.  Documents without a score above 0 have no row, so
    null and empty texts have none, nor have items without terms; rows that
    repeat an id or each other are documents of their own; of equal scores the
    least id comes first, a null id before all; rows of one item_id are one
    item, with all their terms; an empty table gives an empty result; other
    columns aren't looked at.  ``seen`` is shown the shards of each block.
    """
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text <> ''")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size / BLOCK_BYTES)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
    answers = []
    for block in range(blocks):
        terms: dict[int | None, set[bytes]] = {}
        for r in asked.where(F.col("block") == block).orderBy("item_id").toLocalIterator():
            terms.setdefault(r["item_id"], set()).update(term_counts(r["text"].encode()))
        if terms := {i: t for i, t in terms.items() if t}:
            answers.append(_answered(rows, terms, k, seen))
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, answers) if answers else empty


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the 50 best of all documents for each item of the benchmark."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term"

ORACLE = f"""
with words as (select r, doc_id, {_TERMS} from (select row_number() over () as r, doc_id, text from documents where text is not null)),
total as (select count(distinct r) as docs, count(*) as words from words),
lengths as (select r, doc_id, count(*) as n from words group by r, doc_id),
tfs as (select r, term, count(*) as tf from words group by r, term),
dfs as (select term, count(*) as df from tfs group by term),
asked as (select distinct item_id, term from (select item_id, {_TERMS} from benchmark where text is not null)),
weighed as (select item_id, term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1))) as bigint) as w from asked join dfs using (term), total),
damped as (select r, doc_id, 50 + ((50 * n * docs) // words) as m from lengths, total),
scored as (
  select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from weighed join tfs using (term) join damped using (r) group by item_id, r, doc_id
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
where rank <= 50
"""
