"""A Merkle manifest of a dataset by supersteps: messages climb to the root, sibling paths come back to the leaves.

Rows are leaves; those of one group (a language, say) stand in order of their id
and make a tree, and the trees' roots, in order of their groups, make the tree
on top.  Every eight consecutive nodes of a level have a parent.  In a superstep
the children send their digests to their parents; a parent that has heard from
all its children hashes what they sent and is a child in the next superstep.
When the root is known, the supersteps run the other way: each node tells its
children the path of siblings above them, with which a leaf can show, alone,
that it belongs to the root.

Vertices are keyed by (tree, index in the level), and only the messages are
shuffled: vertices stay where the way up has put them.  A node has at most eight
children, so no group is large, however the rows are spread over the trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._shared import cut, fit_for_broadcast, parts, python_ready, read_table

FANOUT = 8
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PROOFS = "doc_id long, leaf string, subroot string, root string, path array<struct<before:string,after:string>>"
AUDIT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*digests: bytes) -> bytes:
    """SHA-256 of digests written as hexadecimal text, one behind the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def written(value: Column) -> Column:
    """A field as it goes into a leaf: its length in bytes and itself, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(written, fields)), 256))


# --- places ------------------------------------------------------------------


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with a column ``tree``) and ``place``, their number in their tree by ``order``, and ``width``, how many it has.

    Rows are dealt by ranges and sorted where they are; a row's number in its
    range and how many of its tree the ranges before it hold give its place, so
    no tree is ever in one task.  Where ``order`` leaves rows equal, and there
    may be many of one kind, their number in the (written) input parts them.
    """
    spark = rows.sparkSession
    keyed = cut(rows).withColumn("turn", F.monotonically_increasing_id())
    dealt = cut(keyed.repartitionByRange(parts(spark), "tree", *order, "turn").sortWithinPartitions("tree", *order, "turn").drop("turn"))
    numbered = dealt.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"))
    runs = numbered.groupBy("tree", "range").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each range and tree in it
    runs = cut(runs.select("tree", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("width")))
    return numbered.join(fit_for_broadcast(runs), ["tree", "range"]).select(*rows.columns, (F.col("row") + F.col("shift")).alias("place"), "width")


# --- supersteps --------------------------------------------------------------


class Vertex(NamedTuple):
    """A node whose children have all been heard: their number in the whole level, its digest, and of each child what it sent."""

    below: int
    digest: bytes
    children: tuple

    @property
    def level_width(self) -> int:
        return -(-self.below // FANOUT)


def _complete(messages) -> Vertex:
    """Hash what the children sent: (slot, digest, width of their level, what the child is)."""
    children = tuple(sorted(messages, key=lambda m: m[0]))
    below = children[0][2]
    # the only node of a tree is its root
    return Vertex(below, children[0][1] if below == 1 else digest(*(c[1] for c in children)), children)


def _levels(width: int) -> int:
    """Supersteps that a tree of so many leaves takes; one for a lone leaf too, which nothing is hashed in."""
    n = 1
    while width > FANOUT:
        width, n = -(-width // FANOUT), n + 1
    return n


def climb(leaves: RDD, height: int, tasks: int) -> list[RDD]:
    """Supersteps upward: for each level the RDD of ((tree, index), Vertex).

    ``leaves``: ((tree, place), (digest, width, what the leaf is)).
    """
    sent = leaves.map(lambda x: ((x[0][0], x[0][1] // FANOUT), (x[0][1] % FANOUT, *x[1])))
    found = []
    for _ in range(height):
        tasks = max(1, tasks)
        level = sent.groupByKey(tasks).mapValues(_complete)
        found.append(level)
        sent = level.filter(lambda x: x[1].level_width > 1).map(lambda x: ((x[0][0], x[0][1] // FANOUT), (x[0][1] % FANOUT, x[1].digest, x[1].level_width, None)))
        tasks = -(-tasks // 4)
    return found


def tops(levels: list[RDD]) -> RDD:
    """(tree, (number of its level, digest)) of every tree."""
    own = [level.filter(lambda x: x[1].level_width == 1).map(lambda x, k=k: (x[0][0], (k, x[1].digest))) for k, level in enumerate(levels)]
    return own[0].context.union(own)


def _tell(heard) -> Iterator:
    """The children's messages: (slot, what the child is, digest, what the tree's top was told, siblings from here up)."""
    vertex = next((x for kind, x in heard if kind == 0), None)
    for kind, message in heard:
        if kind == 1:
            told, path = message
            for k, (slot, own, _, what) in enumerate(vertex.children):
                if vertex.below > 1:
                    siblings = (b"".join(c[1] for c in vertex.children[:k]), b"".join(c[1] for c in vertex.children[k + 1 :]))
                    yield slot, what, own, told, (siblings, *path)
                else:
                    yield slot, what, own, told, path


def descend(levels: list[RDD], told: RDD) -> RDD:
    """Supersteps downward: (what the leaf is, digest, what its tree's top was told, path) of every leaf.

    ``told``: (tree, (number of its top's level, what to tell the leaves, path
    above the tree)).  A path is (siblings before, siblings after) by level,
    lowest first.
    """
    messages = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        own = told.filter(lambda x, k=k: x[1][0] == k).map(lambda x: ((x[0], 0), x[1][1:]))
        messages = own if messages is None else messages.union(own)
        tasks = level.getNumPartitions()
        heard = level.mapValues(lambda v: (0, v)).union(messages.partitionBy(tasks).mapValues(lambda m: (1, m))).groupByKey(tasks)
        if k:
            messages = heard.flatMap(lambda x: (((x[0][0], x[0][1] * FANOUT + slot), (told, path)) for slot, _, _, told, path in _tell(list(x[1]))))
    return heard.flatMap(lambda x: (m[1:] for m in _tell(list(x[1]))))


# --- the manifest ------------------------------------------------------------


class Proof(NamedTuple):
    """What a leaf has in the end: its id, its digest, that of the row as it is shown, and its way to the root."""

    doc_id: int | None
    leaf: bytes
    shown: bytes
    subroot: bytes
    root: bytes
    path: tuple[tuple[bytes, bytes], ...]

    def folded(self) -> bytes:
        """The root that the shown row leads to."""
        now = self.shown
        for before, after in self.path:
            now = digest(*_each(before), now, *_each(after))
        return now

    def siblings(self) -> bytes:
        return digest(*(d for pair in self.path for side in pair for d in _each(side)))


def _each(digests: bytes) -> list[bytes]:
    return [digests[i : i + 32] for i in range(0, len(digests), 32)]


def _trees(rows: DataFrame, tasks: int) -> list[RDD]:
    """The levels of the trees of ``rows``: tree, place, width, digest, and more that the leaves are."""
    height = _levels(rows.agg(F.max("width")).first()[0])
    more = [c for c in rows.columns if c not in ("tree", "place", "width", "digest")]
    leaves = rows.rdd.map(lambda r: ((r["tree"], r["place"]), (bytes(r["digest"]), r["width"], tuple(r[c] if not isinstance(r[c], bytearray) else bytes(r[c]) for c in more))))
    return climb(leaves, height, tasks)


def proofs(docs: DataFrame, shown: Column | None = None, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", text_col: str = "text") -> RDD | None:
    """An RDD with the ``Proof`` of every row, or None for an empty table.

    Leaves are ordered by id (null first) and, of one id, by digest; trees by
    UTF-8 bytes, null first.  ``shown``: the text that a reader presents instead
    of ``text_col``; its digest goes along with the leaf's and takes no part in
    the tree.  Rows that repeat each other are leaves of their own; nulls and
    empty texts have digests like any; whole texts are hashed, however long, in
    the JVM, and never leave the scan; other columns aren't looked at.
    """
    spark = docs.sparkSession
    python_ready(spark)
    column = lambda name: F.col(f"`{name}`")
    own = leaf_digest([column(c) for c in fields])
    other = own if shown is None else leaf_digest([shown if c == text_col else column(c) for c in fields])
    # a name for null before all others
    tree = F.coalesce(F.concat(F.lit("1"), column(tree_col).cast("string")), F.lit("0"))
    rows = placed(docs.select(tree.alias("tree"), column(id_col).cast("long").alias("doc_id"), own.alias("digest"), other.alias("shown")), "doc_id", "digest")
    if rows.isEmpty():
        return None
    levels = _trees(rows, parts(spark))
    groups = spark.createDataFrame(tops(levels).map(lambda x: (x[0], *x[1])), "name string, level int, digest binary", verifySchema=False)
    crown = _trees(placed(groups.withColumn("tree", F.lit("")), "name"), parts(spark))
    # the root is told to all trees' tops, they tell it and their own digest to their leaves
    start = tops(crown).map(lambda x: (x[0], (x[1][0], x[1][1], ())))
    told = descend(crown, start).map(lambda x: (x[0][0], (x[0][1], (x[1], x[2]), x[3])))
    return descend(levels, told).map(lambda x: Proof(x[0][0], x[1], x[0][1], x[2][0], x[2][1], x[3]))


def manifest(docs: DataFrame, **how) -> DataFrame:
    """doc_id, leaf, subroot, root, path (siblings before and after by level, hexadecimal, lowest first) of every row; takes what ``proofs`` takes."""
    found = proofs(docs, **how)
    spark = docs.sparkSession
    if found is None:
        return spark.createDataFrame([], PROOFS)
    return spark.createDataFrame(found.map(lambda p: (p.doc_id, p.leaf.hex(), p.subroot.hex(), p.root.hex(), [(a.hex(), b.hex()) for a, b in p.path])), PROOFS, verifySchema=False)


def audit(docs: DataFrame, shown: Column, **how) -> DataFrame:
    """Every row as it is shown, against the manifest: doc_id, leaf, subroot, root, proof_sha256 (of all siblings), folded_root, verified.

    What ``proofs`` says of edge cases holds; an empty table gives an empty
    result.
    """
    found = proofs(docs, shown=shown, **how)
    spark = docs.sparkSession
    if found is None:
        return spark.createDataFrame([], AUDIT)

    def checked(p: Proof):
        folded = p.folded()
        return p.doc_id, p.leaf.hex(), p.subroot.hex(), p.root.hex(), p.siblings().hex(), folded.hex(), folded == p.root

    return spark.createDataFrame(found.map(checked), AUDIT, verifySchema=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents against their manifest, a third of them with their capitals gone; a null id's row is shown as it is."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    shown = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return audit(read_table(spark, sf_dir, "documents"), shown)


# --- the same in SQL ---------------------------------------------------------

#: Levels that the SQL has; enough for eight to that many leaves a language, and for as many languages.
SQL_LEVELS, SQL_CROWN = 8, 3


def _sql() -> str:
    leaf = lambda text: "sha256(concat(" + ", ".join(f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    crc = f"xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint), lambda c, b: {bits}), 4294967295)"
    steps = [
        f"shown as (select *, case when {crc} % 3 = 0 then translate(text, '{UPPER}', '{LOWER}') else text end as seen from documents)",
        f"leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place from (select coalesce('1' || lang, '0') as tree, lang, doc_id, {leaf('text')} as leaf, {leaf('seen')} as presented from shown))",
        "n0 as (select tree, place as idx, leaf as digest, count(*) over (partition by tree) as n from leaves)",
    ]

    def tree(node: str, levels: int) -> None:
        for k in range(levels):
            steps.append(f"{node}{k + 1} as (select tree, idx // 8 as idx, case when n = 1 then min(digest) else sha256(string_agg(digest, '' order by idx)) end as digest, (n + 7) // 8 as n from {node}{k} group by tree, idx // 8, n)")
            around = lambda sign: f"coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx {sign} a.idx), '')"
            steps.append(f"s{node}{k} as (select a.tree, a.idx, a.n, {around('<')} as before, {around('>')} as after from {node}{k} a join {node}{k} b on a.tree = b.tree and a.idx // 8 = b.idx // 8 group by a.tree, a.idx, a.n)")

    tree("n", SQL_LEVELS)
    steps.append(f"m0 as (select '' as tree, row_number() over (order by tree) - 1 as idx, digest, count(*) over () as n, tree as name from n{SQL_LEVELS})")
    tree("m", SQL_CROWN)
    now, last = "w0", f"n{SQL_LEVELS}"
    steps.append(f"w0 as (select l.*, g.digest as subroot, g.idx as at, '' as path, presented as now from leaves l join (select name, idx, digest from m0) g on g.name = l.tree)")
    count = 0
    for node, levels, key, index in (("n", SQL_LEVELS, "w.tree", "w.place"), ("m", SQL_CROWN, "''", "w.at")):
        for k in range(levels):
            steps.append(f"w{count + 1} as (select w.* replace (case when s.n = 1 then w.path else w.path || s.before || s.after end as path, case when s.n = 1 then w.now else sha256(s.before || w.now || s.after) end as now) from w{count} w join s{node}{k} s on s.tree = {key} and s.idx = {index} // {FANOUT**k})")
            count += 1
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, r.digest as root, sha256(path) as proof_sha256, now as folded_root, now = r.digest as verified from w{count}, (select digest from m{SQL_CROWN}) r"


ORACLE = _sql()
