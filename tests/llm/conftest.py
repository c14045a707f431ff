import random

import pytest

#: Names that the operators use inside; as columns of the input they must not get in the way.
CLASHES = ["fp", "key", "n", "size", "h", "skey", "cid", "same", "w0", "th", "score", "part", "row", "low", "ws", "id", "v", "start", "rest", "b", "_size", "_times", "_th", "_scored", "class_fp", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{rng.choice('abcdefg')}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(17)
    base = prose(rng, 120).split()
    near = [*base[:60], "changed", *base[61:]]
    rows = [
        (1, " ".join(base), "en", "a", 5), (2, " ".join(near), "en", "a", 5), (3, " ".join(base).upper(), "en", None, None), (4, None, None, None, None), (5, "", "en", "b", 0),
        (6, " \t\n", "en", "b", 3), (None, "no id at all here", None, "c", 1), (None, None, None, None, None), (7, "same", "x", "é", 4), (7, "same", "x", "é", 4), (8, "same", "x", "z", 4),
        (9, prose(rng, 30_000), "en", "a", 9), (10, "x" * 100_000, "en", "B", 1), (11, "ñandú 日本語 😀   ok", "es", "😀", 2), (12, "a b c d", "en", "￿", 1),
    ]
    return rows + [(100 + k, prose(rng, rng.randint(1, 80)), "en", f"s{k % 5}", k) for k in range(40)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    df = spark.createDataFrame(edge_rows, SCHEMA)
    return df.selectExpr("*", *(f"'x' as {c}" for c in CLASHES))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
