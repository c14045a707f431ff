import math
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from foliograph.api import Gazette
from foliograph.functions.text import fold, fold_text, phrase_offsets
from foliograph.operators import search as s
from foliograph.operators.search import Filters, InvalidSearch
from foliograph.sources.store import Store, grams_table


@pytest.fixture(scope="module")
def index(spark):
    bulletins = [(1, 10, date(2020, 1, 1), False, "indexado", "new"), (2, 11, date(2021, 1, 1), True, "error", "new"), (3, 12, None, False, "indexado", "old"), (4, 13, date(2021, 1, 1), False, "roto", "old")]
    articles = [(k, 1 + k % 4, k, t, "dep", "Consejería %d" % (k % 2)) for k, t in enumerate(["Bases de personal", "PERSONAL eventual", None, "Subvención", "convocatoria de personal", "  ", "personal personal", "de"])]
    b = spark.createDataFrame(bulletins, "bulletin long, number long, date date, extraordinary boolean, state string, origin string")
    a = spark.createDataFrame(articles, "id long, bulletin long, number long, summary string, department string, section string")
    return a.withColumn("norm", fold(F.col("summary"))).withColumn("section_norm", fold(F.col("section"))).cache(), b.cache()


def ids(df):
    return [r["id"] for r in df.collect()]


def test_order_filters_and_pages(index):
    every = ids(s.search(*index))
    assert every == [3, 7, 1, 5, 0, 4, 2, 6]  # newest first, dateless last, ties by bulletin number and article number
    assert ids(s.search(*index, limit=3)) + ids(s.search(*index, limit=3, offset=3)) + ids(s.search(*index, limit=3, offset=6)) == every
    assert ids(s.search(*index, ["personal"])) == [1, 0, 4, 6]
    assert ids(s.search(*index, ["personal"], Filters(since=date(2020, 6, 1)))) == [1]
    assert ids(s.search(*index, filters=Filters(extraordinary=True))) == [1, 5]
    assert ids(s.search(*index, filters=Filters(section="CONSEJERIA 1"))) == [3, 7, 1, 5]
    assert ids(s.search(*index, [{"text": "personal", "mode": "lacks"}])) == [3, 7]


def test_totals(index):
    found = s.matching(*index, ["personal"])
    assert tuple(s.total(found, 3, 0).first()) == (4, 3) and tuple(s.total(found, 3, 3).first()) == (4, None)


@pytest.mark.parametrize("how", [{"limit": 0}, {"limit": True}, {"offset": -1}, {"offset": 1_000_001}, {"order": "x"}])
def test_bad_arguments(index, how):
    with pytest.raises(InvalidSearch):
        s.search(*index, **how)
    assert Gazette(*index).search(**how)["error_code"] == "invalid_search"


def test_dates_the_wrong_way_round():
    with pytest.raises(InvalidSearch):
        Filters(date(2021, 1, 1), date(2020, 1, 1))


def test_bm25_against_the_formula(spark, index):
    rng = random.Random(11)
    words = ["personal", "bases", "de", "convocatoria", "subvencion", "obra", "plaza"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(200)]
    a = spark.createDataFrame([(k, 1, k, t, "d", "s", t, "s") for k, t in enumerate(texts)], "id long, bulletin long, number long, summary string, department string, section string, norm string, section_norm string")
    phrases = ["personal", "plaza", "personal"]
    page = s.search(a, index[1], [{"text": p, "operator": "or"} for p in phrases], order="relevance", limit=200)
    got = [(r["id"], r["score"]) for r in page.collect()]
    rows = [t for t in texts if t]
    mean = sum(max(len(t) - 2, 0) for t in rows) / len(rows)

    def score(t):
        total = 0.0
        for p in phrases:
            n = sum(p in x for x in rows)
            idf = math.log((len(rows) - n + 0.5) / (n + 0.5))
            tf = len(phrase_offsets(t, p))
            total += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * max(len(t) - 2, 0) / mean))
        return -total

    want = sorted(((k, score(t)) for k, t in enumerate(texts) if "personal" in t or "plaza" in t), key=lambda x: (round(x[1], 12), x[0]))
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(math.isclose(x, y, abs_tol=1e-9) for (_, x), (_, y) in zip(got, want, strict=True))


def test_short_phrases_are_not_ranked(index):
    assert ids(s.search(*index, ["de"], order="relevance")) == ids(s.search(*index, ["de"]))


def test_store_and_postings(spark, index, tmp_path):
    a, b = index
    texts = ["Bases de personal", "eﬁcaz personal", None, "Dvořák y oﬁcina", "  ", "personal personal", "de"]
    raw = spark.createDataFrame([(k, 1 + k % 4, k, t, "dep", "Sección") for k, t in enumerate(texts)], "id long, bulletin long, number long, summary string, department string, section string")
    store = Store(spark, f"{tmp_path}/store").take_in(raw).index()
    rows = {r["id"]: r["norm"] for r in store.articles.collect()}
    assert rows == {k: fold_text(t) for k, t in enumerate(texts)}
    lengths = [max(len(t) - 2, 0) for t in rows.values() if t]
    assert tuple(store.statistics.first()) == (len(lengths), sum(lengths) / len(lengths))
    for phrase in ("personal", "de", "sonal eve", "zzz", "DVORAK", "oficina", "eficaz p"):
        want = {k for k, t in rows.items() if t and fold_text(phrase) in t}
        assert set(ids(s.through_postings(store.articles, store.postings, phrase))) == want
        assert set(ids(s.through_postings(store.articles, grams_table(store.articles), phrase))) == want
        assert set(ids(s.matching(store.articles, b, [phrase]))) == want
    plain, told = (s.search(store.articles, b, ["personal"], order="relevance", counts=c).collect() for c in (None, store.statistics))
    assert plain == told and len(plain) == 3


def test_texts_stay_where_they_are_scanned(index):
    page = s.search(*index, ["personal"], order="relevance")
    above = page._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert not re.search(r"\b(norm|summary)#", above)


def test_service(index):
    g = Gazette(*index)
    found = g.search(["personal"], limit=2)
    assert found["ok"] and found["total"] == 4 and found["next_offset"] == 2 and found["rows"][0]["marked"] == "**PERSONAL** eventual"
    assert found["coverage"]["broken"] == 1 and g.status()["status"]["articles"]["with_text"] == 6
    assert g.identify("x")["error_code"] == "invalid_identifier" and g.identify("bome-b-2020-1")["cve"] == "BOME-B-2020-1"
    assert g.state_of(2)["state"] == "error" and g.bulletin_of_article(5)["bulletin"] == 2 and g.bulletin_of_article(99)["bulletin"] is None
    assert g.read(["a" * 1500, "b"], budget=1)["next"] == {"page": 1, "at": 1000} and g.read([], 2)["error_code"] == "invalid_cursor"
    assert g.check_old_search("  a  b c ")["text"] == "a b c" and not g.check_old_search("日本語")["ok"]
