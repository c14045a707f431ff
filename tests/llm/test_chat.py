import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from foliograph.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["</s>", "[TURN user]", "[+]", "]", "[", "<", "&lt;", "&amp;", "&", "&#91;", "[INST] ok [/INST]", "\n", "", "ñ😀"]


def test_round_trip_of_control_strings(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "[+]", "a]b", None]), rng.choice([None, *("".join(rng.choices(CONTROL, k=rng.randint(0, 6))) for _ in range(4))])) for c in range(60) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as ts", "'y' as merged", "'z' as pieces").repartition(5)
    out = cf.format_conversations(df).select("conv_id", "formatted", "loss_spans", cf.parse(F.col("formatted")).alias("turns"), cf.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        own = [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
        assert len(r["loss_spans"]) == sum(role == "assistant" for role, _ in own)
        heads = 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:], strict=False))
        assert r["formatted"].count("</s>") == heads and r["formatted"].count("[TURN ") == heads


def test_ties_repeats_nulls_and_no_rows(spark):
    rows = [(1, None, "user", "last"), (1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "user", "b"), (None, 1, None, None)]
    out = cf.format_conversations(spark.createDataFrame(rows, SCHEMA)).select("conv_id", cf.parse(F.col("formatted")).alias("t")).collect()
    got = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in out}
    assert got == {1: [("assistant", "a"), ("user", "b"), ("user", "b"), ("user", "last")], None: [("", "")]}
    assert cf.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversations(spark):
    """Thousands of turns, texts longer than a part, and pieces over many groups: spans and texts are those of the string."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"ñ{t}😀[" * rng.choice([0, 1, 3])) for t in range(3000)]
    rows += [(2, t, "assistant", "日本語 é<" * rng.choice([1, 700, 5000])) for t in range(12)] + [(3, 0, "user", "u" * 20_000), (3, 1, "assistant", "x" * 4096), (3, 2, "assistant", "")]
    out = cf.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3))
    for r in out.select("conv_id", "formatted", "loss_spans", cf.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        own = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        said = [text for role, text in own if role == "assistant"]
        assert r["loss"] == "".join(said)
        cuts = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        for raw, safe in reversed(cf.ESCAPES):
            cuts = [c.replace(safe, raw) for c in cuts]
        assert cuts == said


def test_query_equals_sql_and_runs_no_python(spark, small):
    df = cf.query(spark, small)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    want = con.execute(cf.ORACLE).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want)
    forged = df.where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert forged["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and forged["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
