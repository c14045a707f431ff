import random
from datetime import date, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliograph.functions.text import fold_text, phrase_offsets
from foliograph.operators import indexed as ix, search as s
from foliograph.sources.ledger import Ledger
from foliograph.sources.store import KEY, Store, cover, gram_key, gram_text

RAW = "id long, bulletin long, number long, summary string, department string, section string"
WORDS = "personal plaza personalísimo anana ananas de la ﬁcha Ñandú 日本語 😀plaza x,plaza plazapersonal".split()


def raw(spark, texts, first=0):
    return spark.createDataFrame([(first + k, 1 + (first + k) % 5, first + k, t, "d", "Sección") for k, t in enumerate(texts)], RAW)


def made_up(rng, n):
    return [None if k % 17 == 5 else " ".join(rng.choices(WORDS, k=rng.randint(0, 14))) for k in range(n)]


@pytest.fixture(scope="module")
def bulletins(spark):
    return spark.createDataFrame([(k, k, date(2020, 1, 1) + timedelta(days=k % 3), k % 2 == 0, "indexado", "new") for k in range(1, 6)], "bulletin long, number long, date date, extraordinary boolean, state string, origin string")


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """Three segments, articles replaced and deleted, and what must be in them."""
    rng = random.Random(3)
    store = Store(spark, f"{tmp_path_factory.mktemp('store')}/own")
    texts = dict(enumerate(made_up(rng, 150)))
    store.take_in(raw(spark, list(texts.values())))
    store.index().take_in(raw(spark, made := made_up(rng, 60), 140))
    texts |= {140 + k: t for k, t in enumerate(made)}
    store.delete(spark.range(0, 200, 9)).take_in(raw(spark, ["menta sola"], 500)).index()
    texts = {k: t for k, t in texts.items() if k % 9} | {500: "menta sola"}
    return store, texts


def test_append_replace_delete_merge(spark, bulletins, filled):
    store, texts = filled

    def check(own):
        assert {r["id"]: r["summary"] for r in own.articles.collect()} == texts
        lengths = [max(len(f) - 2, 0) for t in texts.values() if (f := fold_text(t))]
        n, mean = own.statistics.first()
        assert n == len(lengths) and mean == pytest.approx(sum(lengths) / n)
        return [ix.search_store(own, bulletins, terms, order="relevance", limit=200, word_start=w).collect() for terms, w in ((["plaza"], False), (["persona", {"text": "anan", "operator": "or"}], True))]

    version = store.version()
    assert len(version.segments) == 3 and version.dead and store.indexed
    before = check(store)
    old = store.pinned()
    merged = Store(spark, store.folder).merge(sorted(version.segments)[:2])
    assert len(merged.version().segments) == 2 and merged.indexed
    after = check(merged)
    plain = lambda pages: [[(r["id"], round(r["score"], 12)) for r in p] for p in pages]
    assert plain(before) == plain(after) == plain(check(old))  # the old version can still be read
    merged.vacuum()
    assert not merged.version().dead and plain(check(merged)) == plain(before)
    assert merged.merge() is merged  # nothing is due


def test_postings_equal_a_scan(spark, bulletins, filled):
    store, texts = filled
    folded = {k: fold_text(t) for k, t in texts.items()}
    phrases = ["personal", "ana", "anana", "plaza de", "l p", "menta sola", "日本語", "no such", "plazap"]
    hits = ix.phrase_hits(store, phrases, word_start=True).join(store.articles.select(*KEY, "id"), KEY).collect()
    got = {r["id"]: [(r[f"tf{k}"], r[f"at{k}"]) for k in range(len(phrases))] for r in hits}
    want = {i: [(len(phrase_offsets(t, p)), bool(phrase_offsets(t, p, True))) for p in phrases] for i, t in folded.items()}
    assert got == {i: w for i, w in want.items() if any(tf for tf, _ in w)}
    for terms, word_start in ((["personal"], False), (["plaza", {"text": "ana", "operator": "or"}, {"text": "ficha", "mode": "lacks"}], False), ([{"text": "plaza", "mode": "lacks"}], True), (["de"], False), ([], False)):
        a = s.matching(store.articles, bulletins, terms, word_start=word_start)
        b = ix.matching_articles(store, bulletins, terms, word_start=word_start)
        assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())
    assert ix.search_store(store, bulletins, ["no such thing"], order="relevance").collect() == []


@pytest.mark.parametrize("first", [1, 3, 40])
def test_a_page_that_ends_early_is_the_page(spark, bulletins, filled, first):
    store, _ = filled
    parsed = s.parse_terms(["plaza", {"text": "persona", "operator": "or"}])
    for terms in (parsed, parsed[:1]):
        for filters in (s.Filters(), s.Filters(extraordinary=True), s.Filters(since=date(2030, 1, 1))):
            whole = s.search(store.articles, bulletins, terms, filters, order="relevance", limit=200, counts=store.statistics).collect()
            for limit, offset in ((3, 0), (5, 4)):
                page = ix.best_page(store, bulletins, terms, filters, False, limit, offset, first)
                assert [(r["id"], round(r["score"], 9)) for r in page.collect()] == [(r["id"], round(r["score"], 9)) for r in whole[offset : offset + limit]]


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles")]


def test_only_parts_that_hold_a_phrase_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("foliograph.sources.store.LEAST_PART", 200)
    texts = [f"{'azafrán' if k == 77 else 'menta'} {k}" for k in range(160)]
    store = Store(spark, f"{tmp_path}/own").take_in(spark.createDataFrame([(k, k, k, t, "d", "s") for k, t in enumerate(texts)], RAW)).index()
    parts = store.grams.select("part").distinct().count()
    assert parts > 3
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert files_read(ix._in_parts(store, ["azafran"])) == [1]
        assert files_read(ix._in_parts(store, ["menta"])) == [parts]
        # more parts than are named one by one: the folders are pruned by what the join broadcasts
        monkeypatch.setattr(ix, "NAMED", 0)
        many = ix.phrase_hits(store, ["azafran"])
        assert many.count() == 1
        # texts are in no plan of a search by postings
        plan = ix.indexed_matches(store, ["azafran"], relevance=True)._jdf.queryExecution().executedPlan()
        leaves = [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())]
        read = {f for leaf in leaves if leaf.metrics().contains("numFiles") for f in leaf.requiredSchema().fieldNames()}
        assert "spots" in read and not read & {"norm", "summary"}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_covers_and_keys(spark):
    assert [k for k, _ in cover("abc")] == [0] and [k for k, _ in cover("abcdefg")] == [0, 3, 4] and [k for k, _ in cover("abcdef")] == [0, 3]
    grams = ["abc", "日本語", "😀é ", "\U0010ffffz\x00"]
    rows = spark.createDataFrame([(gram_key(g), g) for g in grams], "k long, g string")
    assert rows.where(gram_text(F.col("k")) == F.col("g")).count() == len(grams)


def test_empty_stores(spark, tmp_path, bulletins):
    store = Store(spark, f"{tmp_path}/own")
    with pytest.raises(FileNotFoundError):
        store.articles
    store.take_in(raw(spark, [])).index()
    assert store.articles.count() == 0 and tuple(store.statistics.first()) == (0.0, None)
    assert ix.search_store(store, bulletins, ["plaza"], order="relevance").collect() == []
    store.take_in(raw(spark, ["x", None, "plaza"])).index()
    assert [r["id"] for r in ix.search_store(store, bulletins, ["plaza"], order="relevance", highlight=True).collect()] == [2]


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/notes")
    assert ledger.last() == (0, None)
    assert ledger.write(1, {"a": 1}) and not ledger.write(1, {"a": 2}) and ledger.last() == (1, {"a": 1})
    calls = []

    def step(note):
        if not calls:  # somebody else is faster
            ledger.write(2, {"a": 5})
        calls.append(note)
        return {"a": note["a"] + 1}

    assert ledger.change(step) == (3, {"a": 6}) and calls == [{"a": 1}, {"a": 5}]
    assert ledger.change(lambda note: None) == (3, {"a": 6})
    ledger.forget()
    assert ledger.numbers() == [3]


def test_a_deletion_meanwhile_stops_a_merge(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/own").take_in(raw(spark, ["uno", "dos"])).take_in(raw(spark, ["tres"], 9))
    late = Store(spark, store.folder)
    write = Store._write

    def slow(self, rows, seg):
        late.delete(spark.range(1))
        return write(self, rows, seg)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Store, "_write", slow)
        with pytest.raises(RuntimeError, match="merge again"):
            store.merge(list(store.version().segments))
    assert sorted(r["id"] for r in store.merge(list(store.version().segments)).articles.collect()) == [1, 9]


def test_invalid_bytes_are_cleaned(spark, tmp_path, bulletins):
    bad = raw(spark, ["plaza"]).withColumn("summary", F.expr("cast(unhex('706C617A6120FF61') as string)"))
    store = Store(spark, f"{tmp_path}/own").take_in(bad).index()
    row = ix.search_store(store, bulletins, ["plaza"], highlight=True).first()
    assert row["summary"] == "plaza \ufffda" and row["marked"] == "**plaza** \ufffda"


def test_spots_in_bounded_slices():
    from foliograph.sources import store as st

    texts = ["abcd" * 3, "", None, "x" * (st.SPOT_CHARS + 5), *["menta y anan"] * 60_000]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["part", "row", "norm"])
    cut = list(st._slices(iter([batch])))
    assert [r for b in cut for r in b.column(1).to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(2).to_pylist()) <= st.SPOT_CHARS for b in cut)
    found = list(st._spots(iter([batch.slice(0, 10_000), batch.slice(10_000)])))
    assert max(b.num_rows for b in found) < 400_000 and len(found) >= len(cut)
    assert sum(b.num_rows for b in found) == 4 + 1 + 10 * 60_000


def test_batches_are_bounded(spark):
    from foliograph.shipping import BATCH_BYTES, BATCH_ROWS, ship

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
