import random

from foliograph.llm import license_scan as ls

NAMES = list(ls.TEMPLATES)


def brute(text):
    """Templates whose shingles some window of twice their length class holds to 0.8."""
    words, found = ls.template_words(text or ""), set()
    for name, template in ls.TEMPLATES.items():
        own = ls.template_words(template)
        width, size = min(ls.SHINGLE, len(own)), ls._length_class(len(own))
        grams = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)}
        for start in range(0, max(1, len(words)), size):
            win = words[start : start + 2 * size]
            held = {tuple(win[i : i + width]) for i in range(len(win) - width + 1)}
            if len(grams & held) >= ls.CONTAINED * len(grams):
                found.add(name)
    return found


def test_planted_licenses_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for k in range(150):
        filler = [rng.choice(["under", "the", "license", "copyright", "tion", "rights", "x1"]) for _ in range(rng.randint(0, 300))]
        at = rng.randint(0, len(filler))
        said = ls.TEMPLATES[rng.choice(NAMES)].split() if k % 3 else []
        if k % 5 == 0 and len(said) > 30:  # a word in fifty changed
            said[rng.randrange(len(said))] = "altered"
        if k % 7 == 0:
            said = [w.upper() for w in said]
        rows.append((k, " \n".join(filler[:at] + said + filler[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as row", "'x' as low", "0 as r1")
    out = ls.scan(df)
    got = {}
    for r in out.collect():
        assert ls.CONTAINED <= r["containment"] <= 1 and r["n_windows"] >= 1
        got.setdefault(r["doc_id"], set()).add(r["license"])
    want = {k: b for k, t in rows if (b := brute(t))}
    assert got == want
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bands_guarantee():
    """A window that holds a template whole collides in some band with probability over 0.9999."""
    for template in ls.TEMPLATES.values():
        n = len(ls.template_words(template))
        width, size = min(ls.SHINGLE, n), ls._length_class(n)
        alike = (n - width + 1) / (2 * size - width + 1)
        assert (1 - alike) ** ls.BANDS < 1e-4


def test_edges(spark, edge_docs, no_docs):
    assert ls.scan(edge_docs).collect() == [] and ls.scan(no_docs).collect() == []
    rows = [(None, "All rights reserved."), (1, "all RIGHTS\nreserved"), (1, "all RIGHTS\nreserved"), (2, "rights reserved"), (3, None), (4, "x " * 30_000 + ls.TEMPLATES["mit"])]
    got = [(r["doc_id"], r["license"]) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, "all-rights-reserved"), (1, "all-rights-reserved"), (1, "all-rights-reserved"), (4, "mit")]))
    assert ls.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}).collect() == []
