"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ._shared import cut

#: Links that a task of a round gets, 1 MB of them; no more than that are joined by broadcast.
TASK_LINKS = 1 << 16


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` that isn't its component's least node.

    Alternates large-star and small-star steps until the links are stars around
    the least node of each component.  Each step is one partial aggregate and
    one equi-join; a hub's neighbours stay spread, as only its minimum is
    aggregated and the join may split a hot key.  Rounds are cut through the
    shared checkpoint folder.  A round reads what is left in tasks of TASK_LINKS,
    and links that one task can hold aren't shuffled: each of a round's shuffles
    would else leave files for every partition, however few the links.
    Self-links and nulls are ignored; an empty table gives an empty result.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _digest(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        tasks = math.ceil(before[0] / TASK_LINKS)
        least = F.broadcast if tasks == 1 else lambda low: low
        both = edges.coalesce(tasks).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least(low), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small)
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_least(roots: DataFrame) -> DataFrame:
    """What ``connected_components`` gives, and the least nodes, each its own root."""
    return roots.unionByName(roots.select(F.col("root").alias("node"), F.col("root")).distinct())


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0
