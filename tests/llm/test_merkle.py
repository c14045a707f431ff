import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from foliograph.llm import merkle_manifest as mm


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(rows, tamper):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars), one tree after another."""

    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join(map(written, (doc_id, source, lang, n_chars, text))))

    def up(nodes):
        """The root, and for each node its siblings by level."""
        paths = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                first = i // 8 * 8
                run = nodes[first : first + 8]
                paths[k].append((run[: i - first], run[i - first + 1 :]))
            nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
            at = [i // 8 for i in at]
        return nodes[0], paths

    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        built[name] = own, up([leaf(*r) for r in own])
    root, crown = up([built[n][1][0] for n in names])
    out = []
    for name, above in zip(names, crown, strict=True):
        own, (subroot, paths) = built[name]
        for row, path in zip(own, paths, strict=True):
            now = leaf(row[0], tamper(row[0], row[1]), *row[2:])
            for before, after in (*path, *above):
                now = sha("".join([*before, now, *after]))
            proof = sha("".join(d for pair in (*path, *above) for side in pair for d in side))
            out.append((row[0], leaf(*row), subroot, root, proof, now, now == root))
    return out


def tampered(doc_id, text):
    if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 3:
        return text
    return "".join(c.lower() if c.isascii() else c for c in text)


def shown():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", mm.UPPER, mm.LOWER)).otherwise(F.col("text"))


def key(row):
    return tuple(map(str, row))


def test_edges_against_brute_force(spark, edge_rows, edge_docs):
    got = mm.audit(edge_docs.selectExpr("*", "'x' as tree", "1 as place", "2 as width", "'d' as digest"), shown())
    assert sorted(map(key, got.collect())) == sorted(map(key, brute(edge_rows, tampered)))


def test_trees_of_all_sizes(spark):
    rng = random.Random(4)
    sizes = [1, 1, 2, 7, 8, 9, 63, 64, 65, 513, 700]
    rows = [(rng.randrange(10**6), rng.choice(["Ab", "b", None]), f"l{k}" if k else None, "s", k) for k, n in enumerate(sizes) for _ in range(n)]
    # a third of all rows are one row
    rows += [(5, "Same", "l9", "s", 1)] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = mm.audit(docs, shown()).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(rows, tampered)))
    assert any(r["verified"] for r in got) and not all(r["verified"] for r in got)


def test_paths_lead_to_the_root(spark, edge_docs):
    for p in mm.manifest(edge_docs).collect():
        now = p["leaf"]
        for step in p["path"]:
            now = sha(step["before"] + now + step["after"])
        assert now == p["root"]


def test_one_row_and_none(spark, no_docs):
    one = spark.createDataFrame([(1, "A", "en", "s", 1)], no_docs.schema)
    row = mm.audit(one, shown()).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")
    assert mm.audit(no_docs, shown()).collect() == [] and mm.manifest(no_docs).collect() == []


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = con.execute(f"select {', '.join(columns)} from ({mm.ORACLE})").fetchall()
    got = mm.query(spark, small).select(*columns).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
