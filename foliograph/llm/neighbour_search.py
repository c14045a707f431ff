"""Approximate nearest neighbours over learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced partitions
that keep neighbours together; a small classifier learns to tell a vector's
partition.  It files every vector under its most probable partition and routes
each query to several of them, where candidates are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ._shared import cut, python_ready, read_table

#: Partitions grow with the root of the table's rows, GROW of them for a root of 1, up to PARTITIONS.
GROW, PARTITIONS = 0.25, 1024
#: Vectors to a partition, and in all at least, that partitions are learned from (those of least hash): 65,536 at most.
PER_PARTITION, SAMPLE = 64, 4096
#: Neighbours in the graph, and the share of them that routed queries must find again on the sample.
GRAPH, WANTED = 10, 0.97
#: Candidates and queries that meet in one task, at most about; queries that are worked out in one go.
CANDIDATES, QUERIES, CHUNK = 8192, 2048, 128


def graph_of(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k`` nearest other rows, by blocks."""
    norms, out = (x * x).sum(1), np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.15) -> np.ndarray:
    """A part for each row: halved again and again at the median of the widest direction, then moved to where a row's neighbours are.

    A row moves to the part that most of its neighbours (either way) are in, as
    long as that part keeps below ``slack`` x the mean size.
    """
    part, groups = np.zeros(len(x), dtype=np.int64), [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        own = groups.pop()
        y = x[own] - x[own].mean(0)
        widest = np.linalg.eigh(y.T @ y)[1][:, -1]
        order = own[np.argsort(y @ widest, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for k, own in enumerate(groups):
        part[own] = k
    a, b = np.repeat(np.arange(len(x)), graph.shape[1]), graph.reshape(-1)
    ends = np.concatenate([a, b]), np.concatenate([b, a])
    most, sizes = int(np.ceil(slack * len(x) / parts)), np.bincount(part, minlength=parts)
    for _ in range(rounds):
        seen = np.zeros((len(x), parts))
        np.add.at(seen, (ends[0], part[ends[1]]), 1)
        rows = np.arange(len(x))
        best = seen.argmax(1)
        gain = seen[rows, best] - seen[rows, part]
        moved = 0
        for r in np.argsort(-gain, kind="stable"):
            if gain[r] <= 0:
                break
            if sizes[best[r]] < most and sizes[part[r]] > 1:
                sizes[part[r]] -= 1
                sizes[best[r]] += 1
                part[r] = best[r]
                moved += 1
        if not moved:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer; ``probes``: how many partitions a query goes to."""

    shift: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def partitions_for(rows: int) -> int:
    return max(1, min(PARTITIONS, round(GROW * rows**0.5)))


def fit(x: np.ndarray, parts: int, seed: int = 11, hidden: int = 96, epochs: int = 30, rate: float = 0.003) -> Router:
    """Partition the sample's graph and learn to tell the parts; probes are set so that the sample's own neighbours are found."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    parts = max(1, min(parts, len(x) // PER_PARTITION))
    shift = x.mean(0)
    scale = 1 / max(float((x - shift).std()), 1e-12)
    if parts == 1:
        return Router(shift, scale, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = graph_of(x, GRAPH)
    part = balanced_partition(x, graph, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), GRAPH), part[graph].reshape(-1)), 0.5 / GRAPH)
    soft[np.arange(len(x)), part] += 0.5
    z = (x - shift) * scale
    layers = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            own = order[at : at + 128]
            h = np.maximum(z[own] @ layers[0] + layers[1], 0)
            out = h @ layers[2] + layers[3]
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - soft[own]) / len(own)
            dh = (d @ layers[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((z[own].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    router = Router(shift, scale, *layers, 1)
    filed, needed = router.ranked(x, 1)[:, 0], np.zeros(parts, dtype=np.int64)
    for at in range(0, len(x), 1024):
        routes = router.ranked(x[at : at + 1024], parts)
        place = np.empty_like(routes)
        np.put_along_axis(place, routes, np.arange(parts)[None, :], axis=1)  # place[q, part]: how early q goes there
        needed += np.bincount(np.take_along_axis(place, filed[graph[at : at + 1024]], axis=1).reshape(-1), minlength=parts)
    probes = int(np.searchsorted(np.cumsum(needed) / needed.sum(), WANTED)) + 1
    return Router(shift, scale, *layers, min(parts, probes))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _route_batches(batches: Iterator[pa.RecordBatch], router, dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            parts = router.value.ranked(_matrix(b.column(2), dim), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.int32())], ["row", "id", "v", "p"])


def nearest(asking: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query, the places of the ``k`` nearest vectors of other rows and their distances; ties to the smaller id, then row.

    Squared distances by products of matrices say which vectors may be among the
    nearest, with room for rounding; the distances of those are worked out as
    they are defined.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.einsum("ij,ij->i", vectors, vectors)
        for at in range(0, len(queries), CHUNK):
            block = queries[at : at + CHUNK]
            own = np.einsum("ij,ij->i", block, block)
            rough = norms[None, :] + own[:, None] - 2 * block @ vectors.T
            room = 1e-9 * (norms.max(initial=0.0) + own)
            for q, v, d, slack in zip(asking[at : at + CHUNK], block, rough, room, strict=True):
                other = rows != q
                n = min(k, int(other.sum()))
                if not n:
                    yield np.zeros(0, dtype=np.int64), np.zeros(0)
                    continue
                if np.isfinite(slack):
                    d[~other] = np.inf
                    other &= d <= np.partition(d, n - 1)[n - 1] + slack
                near = np.flatnonzero(other)
                exact = np.sqrt(((vectors[near] - v) ** 2).sum(1))
                first = np.lexsort((rows[near], ids[near], exact))[:n]
                yield near[first], exact[first]


def widened(ranked: np.ndarray, rows: np.ndarray, probes: int, wanted: int) -> list[list[int]]:
    """Each query's first ``probes`` partitions, and further ones in its order until ``wanted`` rows are filed in them or none is left."""
    enough = np.cumsum(rows[ranked], axis=1) >= wanted
    need = np.where(enough.any(1), enough.argmax(1) + 1, ranked.shape[1])
    return [row[: max(probes, n)].tolist() for row, n in zip(ranked, need, strict=True)]


def _ask_batches(batches: Iterator[pa.RecordBatch], router, dim: int, rows: np.ndarray, wanted: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            parts = widened(router.value.ranked(_matrix(b.column(2), dim), len(rows)), rows, router.value.probes, wanted)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.list_(pa.int32()))], ["row", "id", "v", "ps"])


MET = "q_row long, query_id long, row long, vec_id long, score double"


def _rank_block(cands: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest candidates of a block for each of its queries."""
    names = [part.split()[0] for part in MET.split(", ")]
    if not len(cands) or not len(asked):
        return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
    rows, ids, vectors = cands["row"].to_numpy(np.int64), cands["id"].to_numpy(np.int64), np.stack(cands["v"].to_list()).astype(np.float64)
    q_rows, q_ids, queries = asked["row"].to_numpy(np.int64), asked["id"].to_numpy(np.int64), np.stack(asked["v"].to_list()).astype(np.float64)
    found = [(np.full(len(at), r), np.full(len(at), q), rows[at], ids[at], d) for r, q, (at, d) in zip(q_rows, q_ids, nearest(q_rows, queries, rows, ids, vectors, k), strict=True)]
    return pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, zip(*found, strict=True), strict=True)})


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector without null or non-finite components that isn't zero."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows found of each row whose id is divisible by ``every``: query_id, rank, vec_id, score (Euclidean distance).

    Nearest first, ties to the smaller id.  Every row but the query's own is a
    candidate; rows that share an id are rows of their own, as candidates and as
    queries, each with ranks from 1.  Vectors that are null, zero, or hold null
    or non-finite components take no part, nor do rows without an id; nor do
    vectors of another length than most (of several as common, the least), to
    which there is no distance.  An empty table gives an empty result; other
    columns aren't looked at.

    All rows are indexed.  Partitions are dealt out in blocks of about
    CANDIDATES rows and QUERIES queries; a query whose partitions hold too few
    goes to further ones until it has ``k`` candidates or all.  A value that a
    third of all rows share is spread, and pairs of rows are never made outside
    a block's matrix.
    """
    spark = df.sparkSession
    python_ready(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, parts = lengths[0]["n"], partitions_for(lengths[0]["count"])
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(max(SAMPLE, parts * PER_PARTITION)).select("v").toArrow()
    model = fit(np.unique(_matrix(sample.column(0).combine_chunks(), dim), axis=0), parts)
    router, parts = spark.sparkContext.broadcast(model), model.b2.size
    # a row's number is written out with it, so that it stays the same one
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    filed = cut(numbered.mapInArrow(partial(_route_batches, router=router, dim=dim), "row long, id long, v array<double>, p int"))
    has = {r["p"]: r["n"] for r in filed.groupBy("p").agg(F.count("*").alias("n")).collect()}  # PARTITIONS rows at most
    filed_in = np.array([has.get(p, 0) for p in range(parts)], dtype=np.int64)
    asked = filed.where(F.col("id") % every == 0).select("row", "id", "v")
    asked = cut(asked.mapInArrow(partial(_ask_batches, router=router, dim=dim, rows=filed_in, wanted=k + 1), "row long, id long, v array<double>, ps array<int>"))
    asked = asked.select("row", "id", "v", F.explode("ps").alias("p"))
    wants = {r["p"]: r["n"] for r in asked.groupBy("p").agg(F.count("*").alias("n")).collect()}  # PARTITIONS rows at most
    blocks = [(p, -(-has[p] // CANDIDATES), -(-wants[p] // QUERIES)) for p in range(parts) if p in has and p in wants]
    blocks = F.broadcast(spark.createDataFrame(blocks, "p int, cs int, qs int"))
    place = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    cands = filed.join(blocks, "p").select("p", place(F.col("cs")).alias("c"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "row", "id", "v")
    quers = asked.join(blocks, "p").select("p", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), place(F.col("qs")).alias("q"), "row", "id", "v")
    met = cands.groupBy("p", "c", "q").cogroup(quers.groupBy("p", "c", "q")).applyInPandas(lambda a, b: _rank_block(a, b, k), MET)
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy("score", "vec_id", "row"))
    return met.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: ten nearest of each hundredth vector."""
    return search(read_table(spark, sf_dir, "embeddings"))
