"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact word length; per source, the words still wanted
after whole passes over it are fitted by a bounded-knapsack dynamic programme
over lengths, which says how many documents of each length go in once more; a
seeded hash says which ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ._shared import cut, fit_for_broadcast, parts, python_ready, read_table, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST, SEED = 1.5, 2.0, 42
#: The dynamic programme gets the words of about RESERVE of the longest documents, but TABLE words at most; what the
#: proportional shares leave comes on top, which is less than the longest document.
RESERVE, TABLE = 8, 1 << 21


def subset_sum(lengths: Sequence[int], counts: Sequence[int], budget: int, seed: int = SEED) -> np.ndarray:
    """How many of each length to take so that their sum is the largest one not above ``budget``.

    Bounded knapsack: ``counts`` are split into powers of two, each an item that
    goes in once; ``by[s]`` is the item that first reached sum s.
    """
    took = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return took
    by = np.full(budget + 1, -1, dtype=np.int32)
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for k in np.random.default_rng(seed).permutation(len(lengths)):
        left, size = min(int(counts[k]), budget // int(lengths[k])), 1
        while left > 0 and not reached[budget]:
            size = min(size, left)
            w = size * int(lengths[k])
            new = np.flatnonzero(reached[:-w] & ~reached[w:]) + w
            by[new], reached[new] = len(items), True
            items.append((k, size))
            left, size = left - size, size * 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, size = items[by[at]]
        took[k] += size
        at -= size * int(lengths[k])
    return took


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, target: float, seed: int = SEED) -> tuple[int, np.ndarray]:
    """(whole passes, documents of each length taken once more) for one source's target in words.

    Longest lengths first, every length gives its proportional share, and what
    does not divide is carried on, so that the mix keeps the source's spread of
    lengths.  A reserve is left for ``subset_sum``, which fits it together with
    what is carried to the end.
    """
    total = int((lengths * counts).sum())
    more = np.zeros(len(lengths), dtype=np.int64)
    if not total:
        return 0, more
    passes = min(int(target // total), int(MOST))
    budget = max(0, min(round(target - passes * total), total if passes < MOST else 0))
    carried = 0.0
    spread = max(0, budget - min(RESERVE * int(lengths.max()), TABLE))
    for k in np.argsort(-lengths, kind="stable"):
        if lengths[k] <= 0:
            continue
        carried += spread / total * float(counts[k] * lengths[k])
        more[k] = min(int(counts[k]), int(carried // lengths[k]))
        carried -= float(more[k] * lengths[k])
    free = np.flatnonzero((lengths > 0) & (counts > more))
    more[free] += subset_sum(lengths[free], (counts - more)[free], budget - int((more * lengths).sum()), seed)
    return passes, more


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    passes, more = fit_lengths(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["target"].iloc[0]))
    return pdf[["skey", "size", "source_size", "target"]].assign(passes=passes, more=more)


def _facts(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    """skey (never null), size, and the seeded hash that orders documents of one length."""
    skey = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    text = F.col(text_col).cast("string")
    return [skey.alias("skey"), word_count(text).alias("size"), F.xxhash64(F.lit(SEED), F.col(id_col), text).alias("h")]


def in_turn(sources: DataFrame) -> DataFrame:
    """``sources`` (skey, ...) with ``turn``: each one's place by code point, from 0, null (an empty skey) last.

    Sorted by ranges: a task numbers its own range, and the ranges' sizes, one
    row a partition, say where each begins.
    """
    spark = sources.sparkSession
    none = F.col("skey") == ""
    ranged = sources.repartitionByRange(parts(spark), none, "skey").sortWithinPartitions(none, "skey")
    ranged = cut(ranged.withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    sizes, starts = sorted(ranged.groupBy("range").count().collect()), []  # a row a partition
    for k, (at, _) in enumerate(sizes):
        starts.append((at, sum(n for _, n in sizes[:k])))
    begins = spark.createDataFrame(starts, "range long, begins long")
    return ranged.join(F.broadcast(begins), "range").withColumn("turn", F.col("begins") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("range", "at", "begins")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(skey, source_size, target) from (skey, size, n): ``share`` of all words dealt by weight, none above ``most`` x its size.

    Sources weigh ``weights`` in turn.  What goes beyond a source's limit is
    dealt again by weight: the level, a weight of one's words, rises until no
    further source is full.  A round is one aggregate over a row a source.
    """
    by = in_turn(sizes.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    by = cut(by.select("skey", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    budget = float(by.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        at = F.col("cap") <= F.lit(level) * F.col("w")
        now = by.agg(F.count_if(at).alias("full"), F.sum(F.when(at, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(at, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if now["full"] == full or not now["w"]:
            break
        level, full = max(level, (budget - now["caps"]) / now["w"]), now["full"]
    reached = F.col("cap") if not now["w"] else F.least("cap", F.lit(level) * F.col("w"))
    return by.select("skey", "source_size", reached.alias("target"))


PLAN = ["skey", "size", "source_size", "target", "passes", "last", "n_last", "at_last"]


def fit_mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """PLAN from (skey, size, h): a document is taken ``passes`` times, and once more if h < last; of the ``n_last`` rows with h = last, ``at_last`` are.

    One source's lengths are gathered in one task: distinct lengths, of which a
    source of W words has fewer than sqrt(2 W).  Which documents of a length go
    in once more is cut at a value of the hash, found in two steps so that a
    length that a third of all rows share is never sorted in one task: counts
    of 4,096 slices of the hash's range, then the distinct values, counted, of
    the one slice that the cut is in.
    """
    python_ready(rows.sparkSession)
    sliced = cut(rows.groupBy("skey", "size", F.shiftright("h", 52).alias("slice")).agg(F.count("*").alias("n")))
    sizes = sliced.groupBy("skey", "size").agg(F.sum("n").alias("n"))
    fitted = sizes.join(fit_for_broadcast(targets(sizes, weights, share, most)), "skey")
    fitted = cut(fitted.groupBy("skey").applyInPandas(_fit_source, "skey string, size long, source_size long, target double, passes long, more long"))
    upto = F.sum("n").over(Window.partitionBy("skey", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    edge = sliced.withColumn("upto", upto).join(fitted.where("more > 0").select("skey", "size", "more"), ["skey", "size"])
    edge = cut(edge.where("upto - n < more and more <= upto").select("skey", "size", "slice", (F.col("more") - F.col("upto") + F.col("n")).alias("nth")))
    inside = rows.withColumn("slice", F.shiftright("h", 52)).join(fit_for_broadcast(edge), ["skey", "size", "slice"])
    inside = inside.groupBy("skey", "size", "h").agg(F.count("*").alias("n"), F.first("nth").alias("nth"))
    upto = F.sum("n").over(Window.partitionBy("skey", "size").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", upto).where("upto - n < nth and nth <= upto")
    last = last.select("skey", "size", F.col("h").alias("last"), F.col("n").alias("n_last"), (F.col("nth") - F.col("upto") + F.col("n")).alias("at_last"))
    return cut(fitted.join(last, ["skey", "size"], "left").select(PLAN))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, with ``_size``, ``_source_size``, ``_target`` and ``_times`` (how often the mix takes it).

    Null texts have size 0 and are never counted; a null source is a source of
    its own, a null id an id like any other.  Of rows alike in id, text and
    source as many are taken as the fit says, whichever of them.  Reruns agree.
    An empty table gives an empty result; columns of ``docs`` that aren't named
    are not looked at.
    """
    facts = _facts(docs, id_col, source_col, text_col)
    plan = fit_mix(cut(docs.select(*facts)), weights, share, most)
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc")
    return _taken(docs.select(kept, *facts), plan).select("doc.*", "_size", "_source_size", "_target", "_times")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (doc, skey, size, h) with what the plan says of them."""
    out = rows.join(fit_for_broadcast(plan), ["skey", "size"])

    def told(found: DataFrame, once_more: Column) -> DataFrame:
        times = F.when(F.col("size") > 0, F.col("passes") + F.coalesce(once_more.cast("long"), F.lit(0))).otherwise(F.lit(0))
        return found.select("doc", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), times.alias("_times"))

    if not plan.where("at_last < n_last").limit(1).count():
        return told(out, F.col("h") <= F.col("last"))
    split = F.coalesce((F.col("h") == F.col("last")) & (F.col("at_last") < F.col("n_last")), F.lit(False))
    # Rows alike of which some are taken.  They are written out, so that it stays the same ones; each task's share is
    # counted, and a task's rows are numbered among themselves: no group meets in one task.
    alike = cut(out.where(split).withColumn("row", F.monotonically_increasing_id())).withColumn("part", F.shiftright("row", 33))
    before = F.sum("n").over(Window.partitionBy("skey", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shares = alike.groupBy("skey", "size", "part").agg(F.count("*").alias("n"), F.first("at_last").alias("wanted"))
    shares = cut(shares.select("skey", "size", "part", (F.col("wanted") - F.coalesce(before, F.lit(0))).alias("left")))
    place = F.row_number().over(Window.partitionBy("skey", "size", "part").orderBy("row"))
    chosen = alike.join(fit_for_broadcast(shares), ["skey", "size", "part"]).withColumn("place", place)
    return told(out.where(~split), F.col("h") <= F.col("last")).unionByName(told(chosen, F.col("place") <= F.col("left")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: what the mix takes of every document."""
    docs = read_table(spark, sf_dir, "documents")
    rows = cut(docs.select(F.col("doc_id").alias("doc"), *_facts(docs, "doc_id", "source", "text")))
    found = _taken(rows, fit_mix(rows))
    return found.select(F.col("doc").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself; a document taken twice comes back as two rows, one not taken doesn't.

    As ``mix``: null and empty texts have no words and so aren't taken; repeated
    rows are taken each for itself; an empty table stays empty; all columns come
    back unchanged, whatever their names.
    """
    rows = mix(docs.select(F.struct("*").alias("doc"), "doc_id", "source", "text"), keep=["doc"]).where("_times > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("doc.*")
