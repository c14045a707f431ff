"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into few segments, so few that of two linked fingerprints
one segment differs by at most one bit.  Every segment is indexed under its
one-wildcard variants (the segment with one bit taken out); two fingerprints
whose segments differ by at most one bit meet under an equal variant, and the
meeting is verified on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._shared import cut, fit_for_broadcast, parts, python_ready, read_table
from .components import connected_components, with_least

SEED = 42
BLOCK = 1 << 15


def word_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the space-joined shingles of ``width`` words, in blocks.

    Fewer words than ``width``: one shingle of them all; no words: nothing.
    """
    if not words:
        return
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    flat, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    pairs = zip(starts, ends[width - 1 :], strict=False)
    n = len(words) - width + 1
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        yield np.fromiter((h(flat[s:e], SEED) for s, e in (next(pairs) for _ in range(size))), dtype=np.uint64, count=size)


def simhash64(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text: bit set if set in over half the shingles' hashes.

    Only A-Z are lower-cased.  Null and texts without words have fingerprint 0.
    """
    return _simhash((text or b"").lower().split(), width)


def _simhash(words: list[bytes], width: int) -> int:
    votes, n = np.zeros(64, dtype=np.int64), 0
    for hashes in word_hashes(words, width):
        n += len(hashes)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = np.fromiter((simhash64(t.as_py(), width) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document, the fingerprint as a signed long."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprint_batches, width=width), "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 2 x 32 one-wildcard variants of the two 32-bit segments of distinct fingerprints."""
    i = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    segment = F.expr("shiftrightunsigned(fp, (i div 32)::int * 32) & 4294967295L")
    hole = F.expr("shiftleft(1L, i % 32)")
    return i.select((segment.bitwiseAND(F.bitwise_not(hole)).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 32))).alias("key"), "fp")


def _verified(x: Column, y: Column, bits: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= bits


def links_within_two(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect just what lies within 2 bits.

    ``fps`` holds distinct values.  Two segments of 32 bits: of two fingerprints
    at distance 2 or less, one segment differs by at most one bit, so they share
    a one-wildcard variant.  A variant with two or three fingerprints gives its
    pairs, verified (count, least, greatest and the xor of all name the three,
    so the aggregate combines before the shuffle and no bucket is ever
    gathered).  A fuller variant would give a square of pairs; its fingerprints
    are linked exactly in another way: two of them are within 2 bits just if
    some value is within one bit of both, so each is filed under itself and its
    64 one-bit neighbours.  At most 65 distinct fingerprints can meet there, all
    within 2 bits of one another, and a star of links connects them.
    """
    meet = cut(
        _variants(fps)
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor("fp").alias("x"))
        .where("n > 1")
    )
    mid = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    pair = lambda p, q: F.struct(p.alias("a"), q.alias("b"))
    lo, hi = F.col("lo"), F.col("hi")
    few = meet.where("n <= 3").select(F.explode(F.when(F.col("n") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, hi), pair(lo, mid), pair(mid, hi)))).alias("p")).select("p.*")
    few = few.where(_verified(F.col("a"), F.col("b"), 2))
    full = meet.where("n > 3").select("key")
    crowded = _variants(fps).join(fit_for_broadcast(full), "key", "left_semi").select("fp").distinct()
    near = crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    near = near.select("fp", F.expr("if(i < 0, fp, fp ^ shiftleft(1L, i))").alias("at"))
    stars = near.groupBy("at").agg(F.collect_list("fp").alias("m")).where("size(m) > 1")
    stars = stars.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return few.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (least doc_id reachable over links of 2 bits or less).

    Equal fingerprints are one class and linked to each other; classes are
    linked by ``links_within_two``.  Null and empty texts have fingerprint 0 and
    are linked like any other.  A null doc_id keeps its row and never names a
    component, unless nothing else is in it (then null).  Repeated rows come
    back as often as they came.  An empty table gives an empty result; other
    columns of ``docs`` are not looked at.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    # each row makes 64 variants, so rows are spread over all tasks again
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).repartition(parts(docs.sparkSession)))
    linked = with_least(connected_components(links_within_two(classes.select("fp"))))
    named = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "least", "n", "root")
    joined = named.where("root is not null")
    low = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(low, "root").select("fp", "component_id")
    of = of.unionByName(named.where("root is null and n > 1").select("fp", F.col("least").alias("component_id")))
    out = prints.join(cut(of).withColumnRenamed("fp", "class_fp"), F.col("fp") == F.col("class_fp"), "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: fingerprints of all documents as hex, and their components."""
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by word-shingle similarity, for the pipeline -------------

#: Words of a fingerprint's shingles.
PRINT_SHINGLE = 3
#: Retrieval beyond 2 bits of a fingerprint: BANDS bands of ROWS min-wise hashes of a text's shingles.  Texts of similarity s share a band
#: with probability 1 - (1 - s^ROWS)^BANDS, wherever the edits are: at 0.8 all but 1.5e-4, at 0.85 all but 3e-7;
#: of pairs of similarity 0.5, which are compared in vain, 0.17 do.
BANDS, ROWS = 48, 8
SHINGLE, SIMILARITY = 5, 0.8
#: Members and shingles of a block, on average at most; blocks are compared in pairs where a component is still split.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 400_000
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_BAND_FACTORS = _rng.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the words' shingles, ascending; no words: none."""
    return np.unique(np.concatenate([*word_hashes(words, width), np.zeros(0, np.uint64)]))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS x ROWS hash functions over the shingles."""
    short, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(least, (_FACTORS * short[None, at : at + 256] + _SHIFTS).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of ``min_hashes``; bands of different numbers don't meet."""
    keys = (least.reshape(-1, BANDS, ROWS) * _BAND_FACTORS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same, least, counts, prints = [], [], [], []
        for t in batch.column(2).cast(pa.binary()):
            words = (t.as_py() or b"").lower().split()
            same.append(xxhash.xxh3_128_digest(b" ".join(words)))
            prints.append(_simhash(words, PRINT_SHINGLE))
            own = shingle_set(words)
            counts.append(len(own))
            if len(own):
                least.append(min_hashes(own))
        ends = np.cumsum([0, *(BANDS if n else 0 for n in counts)], dtype=np.int32)
        keys = band_keys(np.array(least, dtype=np.uint32)).view(np.int64).reshape(-1)
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
        fps = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(counts, pa.int64()), keys, fps], ["doc_id", "th", "same", "m", "keys", "fp"])


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as the hashes of its shingles."""
    for batch in batches:
        sets = [shingle_set((t.as_py() or b"").lower().split()).view(np.int64) for t in batch.columns[-1].cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "shingles"])


def _bands(classes: DataFrame) -> DataFrame:
    """(key, cid): the bands of every class."""
    return classes.select(F.explode("keys").alias("key"), "cid")


def meetings(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect the members of each bucket, that is the classes that share a band of min-wise hashes.

    A pair of similarity 0.8 is missed with probability 1.5e-4, and more similar
    ones with less, whether words were replaced, added or cut off.  A bucket is
    known by its least class, greatest class, number and xor, so an aggregate
    that combines before the shuffle says who the two of a small one are;
    fuller ones, each set of members once, are read off in a second pass.
    """
    ends = cut(_bands(classes).groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("b"), F.count("*").alias("n"), F.bit_xor("cid").alias("x")).where("n > 1"))
    fuller = cut(ends.where("n > 2").groupBy("a", "b", "n", "x").agg(F.min("key").alias("key")).select("key", "a"))
    more = _bands(classes).join(fit_for_broadcast(fuller), "key").select("a", F.col("cid").alias("b"))
    return ends.where("n = 2").select("a", "b").unionByName(more)


def simhash_meetings(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect the classes whose fingerprints differ by 2 bits or less, found by deletion variants (``links_within_two``).

    Classes of one fingerprint are linked to the least of them, which stands for
    the fingerprint.  Texts without words are one class and meet nobody.
    """
    own = classes.where("m > 0").select("fp", "cid")
    prints = cut(own.groupBy("fp").agg(F.min("cid").alias("least")).repartition(parts(classes.sparkSession)))
    least = lambda side: prints.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}"))
    near = links_within_two(prints.select("fp")).join(least("a"), "a").join(least("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return near.unionByName(own.join(prints, "fp").where("cid <> least").select(F.col("least").alias("a"), F.col("cid").alias("b")))


def block_links(table: pa.Table) -> pa.Table:
    """(a, b): links between members of one group that connect just what has a similarity of SIMILARITY or more.

    Rows of one block are compared with each other, those of two with the other
    block's.  Members of one component (``root``) aren't compared, nor are those
    that earlier links connect.
    """
    table = table.sort_by([("block", "ascending"), ("grp", "ascending"), ("m", "ascending"), ("cid", "ascending")])
    cid, grp, block, m = (table[c].to_numpy() for c in ("cid", "grp", "block", "m"))
    n, second = len(cid), int(np.searchsorted(block, block[-1]))
    # where the rows that a row is compared with begin and end
    begins = np.arange(1, n + 1) if not second else np.full(n, second)
    ends = np.searchsorted(grp, grp, side="right") if not second else np.full(n, n)
    values, ids = np.unique(table["shingles"].combine_chunks().flatten().to_numpy(), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(m)[:-1]])
    part = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
    mark, found = np.zeros(len(values), dtype=np.int32), []
    for x in range(second or n):
        lo, hi = int(begins[x]), int(ends[x])
        if lo >= hi:
            continue
        fits = (np.minimum(m[lo:hi], m[x]) >= SIMILARITY * np.maximum(m[lo:hi], m[x])) & (part[lo:hi] != part[x])
        if not fits.any():
            continue
        own = ids[starts[x] : starts[x] + m[x]]
        mark[own] = 1
        first, last = lo + int(np.argmax(fits)), hi - int(np.argmax(fits[::-1]))
        shared = np.add.reduceat(mark[ids[starts[first] : starts[last - 1] + m[last - 1]]], starts[first:last] - starts[first])
        mark[own] = 0
        near = fits[first - lo : last - lo] & (shared >= SIMILARITY * (m[first:last] + m[x] - shared))
        for y in first + np.flatnonzero(near):
            if part[y] != part[x]:
                found.append((cid[x], cid[y]))
                part[part == part[y]] = part[x]
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _blocks(n: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK_MEMBERS, shingles / BLOCK_SHINGLES)).cast("int")


def _place(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("cid"), blocks).cast("int")


def first_links(members: DataFrame) -> DataFrame:
    """(a, b): links inside each block of a group, and between its first block and the others.

    members: cid, grp, m, blocks, shingles, with the blocks that the group is
    dealt into.  For a group of one block that is all there is to compare; such
    groups are bundled, so that a task's call sees many of them.  In a larger one
    a member is compared with about two blocks, whatever the group's size.
    """
    small = F.col("blocks") == 1
    total = members.where(small).agg(F.sum("m")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("grp"), F.lit(max(1, total // BLOCK_SHINGLES)))
    block = members.withColumn("block", _place(F.col("blocks")))
    others = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("block")))
    dealt = block.select("cid", F.col("cid").alias("root"), "grp", "m", "block", "shingles", small.alias("small"), F.explode(others).alias("other"))
    unit = F.when(F.col("small"), bundle).otherwise(F.col("grp")).alias("unit")
    dealt = dealt.select("cid", "root", "grp", "m", "block", "shingles", "small", unit, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return cut(dealt.groupBy("small", "unit", "x", "y").applyInArrow(block_links, "a long, b long"))


def rest_links(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links that connect all similar members of groups of several blocks, by exact comparison of all that have different roots.

    members: cid, grp, m, shingles.  A group is dealt into blocks, and all pairs
    of blocks are compared, each in one call; a block's size doesn't grow with
    the group.  The members of the group's largest component have blocks of
    their own, which aren't paired among themselves, so a large component with
    few others around it costs in proportion to it.  Where a group has many
    components, work and copies of its members grow with its square.
    """
    named = members.join(roots, members["cid"] == roots["node"], "left").select("cid", "grp", "m", F.coalesce("root", "cid").alias("root"))
    sums = named.groupBy("grp", "root").agg(F.count("*").alias("n"), F.sum("m").alias("s"))
    total = sums.groupBy("grp").agg(F.max(F.struct("n", "s", "root")).alias("top"), F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.count("*").alias("roots")).where("roots > 1")
    total = total.select("grp", F.col("top.root").alias("top"), _blocks(F.col("top.n"), F.col("top.s")).alias("tops"), _blocks(F.col("all_n") - F.col("top.n"), F.col("all_s") - F.col("top.s")).alias("others"))
    dealt = named.join(fit_for_broadcast(cut(total)), "grp")
    # blocks 0 .. others - 1 hold what isn't in the largest component, blocks from others on that component
    dealt = dealt.withColumn("block", F.when(F.col("root") == F.col("top"), F.col("others") + _place(F.col("tops"))).otherwise(_place(F.col("others"))))
    dealt = dealt.select("cid", "root", "block", F.expr("if(block < others, others + tops, others)").alias("with"))
    copies = members.join(dealt, "cid").select("cid", "root", "grp", "m", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("with") - 1)).alias("other"))
    copies = copies.select("cid", "root", "grp", "m", "block", "shingles", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return cut(copies.groupBy("grp", "x", "y").applyInArrow(block_links, "a long, b long"))


def with_shingles(groups: DataFrame, classes: DataFrame, own: DataFrame) -> DataFrame:
    """(cid, grp, m, blocks, shingles) of the classes (node, root) of groups; only their texts leave the scan of ``own`` (doc_id, th, text)."""
    sized = groups.join(classes.select("cid", "m", F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th")), F.col("node") == F.col("cid"))
    sized = sized.select("cid", F.col("root").alias("grp"), "m", "r_id", "r_th")
    blocks = sized.groupBy("grp").agg(_blocks(F.count("*"), F.sum("m")).alias("blocks"))
    asked = fit_for_broadcast(cut(sized.join(blocks, "grp")))
    bodies = own.join(asked, own["doc_id"].eqNullSafe(F.col("r_id")) & (own["th"] == F.col("r_th"))).select("cid", "grp", "m", "blocks", "text")
    return cut(bodies.mapInArrow(_shingle_batches, "cid long, grp long, m long, blocks int, shingles array<long>").dropDuplicates(["cid"]))


def similar_classes(classes: DataFrame, own: DataFrame) -> DataFrame:
    """(node, root) of the classes that are connected by similar pairs: the least class of each one's component."""
    groups = with_least(connected_components(simhash_meetings(classes).unionByName(meetings(classes))))
    members = with_shingles(groups, classes, own)
    links = first_links(members)
    large = members.where("blocks > 1").drop("blocks")
    if not large.limit(1).count():
        return with_least(connected_components(links))
    roots = connected_components(links)
    rest = rest_links(large, with_least(roots))
    return with_least(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of copies and near copies stays, the one of least doc_id.

    Copies: the same words, case of A-Z and white space aside.  Near copies:
    Jaccard similarity of five-word shingles of 0.8 or more, checked exactly on
    pairs of classes that meet, directly or not: by SimHash fingerprints within
    2 bits (``simhash_meetings``), and, as texts of that similarity may differ
    in more, by min-wise hashes as well (``meetings``); groups are the connected
    components.  Texts are not shuffled: rows are known by (doc_id, hash of the
    text), and what goes is taken out by an anti-join.  Null texts equal empty
    ones.  A null doc_id counts as the greatest; of rows alike in doc_id and
    text one stays.  All columns come back unchanged.
    """
    python_ready(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    rows = cut(own.mapInArrow(_sketch_batches, "doc_id long, th long, same binary, m long, keys array<long>, fp long"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = rows.groupBy("same").agg(F.min(who).alias("rep"), F.count("*").alias("n"), F.max("m").alias("m"), F.any_value("keys").alias("keys"), F.any_value("fp").alias("fp"))
    # each row makes BANDS rows, so rows are spread over all tasks again
    classes = cut(classes.select("same", F.xxhash64("same").alias("cid"), "rep", "n", "m", "keys", "fp").repartition(parts(spark)))
    linked = similar_classes(classes, own)
    grouped = classes.join(linked, classes["cid"] == linked["node"], "left").where("n > 1 or root is not null").select("same", F.coalesce("root", "cid").alias("root"), "rep")
    best = grouped.groupBy("root").agg(F.min("rep").alias("best"))
    grouped = cut(grouped.join(best, "root").select("same", F.col("best.doc_id").alias("b_id"), F.col("best.th").alias("b_th")))
    dropped = rows.join(grouped, "same").where(~(F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("th") == F.col("b_th"))))
    dropped = dropped.select(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th")).distinct()
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_th"))
    gone = fit_for_broadcast(cut(dropped))
    kept = keyed.join(gone, F.col("k_id").eqNullSafe(F.col("d_id")) & (F.col("k_th") == F.col("d_th")), "left_anti")
    twice = cut(rows.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("t_id"), F.col("th").alias("t_th")))
    alike = F.col("k_id").eqNullSafe(F.col("t_id")) & (F.col("k_th") == F.col("t_th"))
    more = fit_for_broadcast(twice)
    if twice.limit(1).count():
        kept = kept.join(more, alike, "left_anti").unionByName(kept.join(more, alike, "left_semi").dropDuplicates(["k_id", "k_th"]))
    return kept.select("doc.*")
