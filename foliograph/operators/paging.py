"""Long texts in chunks: one chunk from a cursor, or all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidCursor

# Characters of a chunk by default, at least and at most.
CHUNK, LEAST, MOST = 20_000, 1_000, 100_000


def chunk_at(texts: Sequence[str], page: int = 1, at: int = 0, budget: int = CHUNK) -> tuple[list[dict], tuple[int, int] | None]:
    """(pieces, next cursor) of a document's page texts from page ``page``, character ``at``.

    Whole pages as long as they fit; a first page that doesn't fit is cut and
    the cursor stays inside it.
    """
    if budget < 1:
        raise InvalidCursor("the budget must be positive")
    if not texts:
        if (page, at) != (1, 0):
            raise InvalidCursor("the document has no pages")
        return [], None
    if not 1 <= page <= len(texts):
        raise InvalidCursor(f"there is no page {page}")
    text = texts[page - 1]
    if at < 0 or (at and at >= len(text)):
        raise InvalidCursor(f"page {page} has no character {at}")
    if len(text) - at > budget:
        return [{"page": page, "start": at, "text": text[at : at + budget], "cut": True}], (page, at + budget)
    pieces, used = [{"page": page, "start": at, "text": text[at:], "cut": False}], len(text) - at
    for k in range(page, len(texts)):
        if used + len(texts[k]) > budget:
            return pieces, (k + 1, 0)
        pieces.append({"page": k + 1, "start": 0, "text": texts[k], "cut": False})
        used += len(texts[k])
    return pieces, None


def first_chunk(pages: DataFrame, doc: str = "doc", page: str = "page", length: str = "length", budget: int = CHUNK) -> DataFrame:
    """Which pages the chunk from the start holds: doc, page, taken (characters), cut."""
    from pyspark.sql.window import Window

    line = Window.partitionBy(doc).orderBy(page)
    run = F.sum(length).over(line.rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(line) == 1
    kept = pages.withColumn("upto", run).withColumn("first", first).where(F.col("first") | (F.col("upto") <= budget))
    # a first page that is cut has the chunk to itself: the running length is over the budget already
    return kept.select(doc, page, F.least(F.col(length), F.lit(budget)).cast("long").alias("taken"), (F.col(length) > budget).alias("cut"))


class Greedy:
    """A document's pages put into chunks one after another; what ``all_chunks`` does for many documents at once."""

    def __init__(self):
        self.chunk, self.used = 1, 0

    def place(self, length: int, budget: int) -> list[tuple[int, int, int]]:
        """(chunk, start, taken) of the next page's pieces."""
        if length <= budget - self.used:
            self.used += length
            return [(self.chunk, 0, length)]
        first = self.chunk + (self.used > 0)
        starts = range(0, length, budget)
        self.chunk, self.used = first + len(starts) - 1, length - starts[-1]
        return [(first + k, at, min(budget, length - at)) for k, at in enumerate(starts)]


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are worked out once a row; else the optimizer would put their expressions into every lambda that looks at them."""
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _two_to(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), b)


def _bits(n: Column) -> Column:
    """0, 1, ... as many as numbers up to ``n`` have binary digits."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(n + 1)), F.lit(1)).cast("int") - 1)


def _running(values: Column, n: Column) -> Column:
    """Running sums of an array of ``n`` numbers, in log n passes over it."""
    add = lambda sums, b: F.transform(sums, lambda x, i: x + F.when(i >= _two_to(b), F.get(sums, i - _two_to(b))).otherwise(F.lit(0)))
    return F.aggregate(_bits(n), values, add)


def _below(values: Column, most: Column, n: Column) -> Column:
    """How many of ``n`` sorted numbers are ``most`` or less, by binary search."""

    def closer(at: Column, b: Column) -> Column:
        further = at + _two_to(b)
        return F.when(F.coalesce(F.get(values, further - 1) <= most, F.lit(False)), further).otherwise(at)

    return F.aggregate(F.reverse(_bits(n)), F.lit(0), closer)


def all_chunks(pages: DataFrame, doc: str = "doc", page: str = "page", length: str = "length", budget: int = CHUNK) -> DataFrame:
    """(doc, chunk, page, start, taken): every document cut greedily, nothing lost, chunks counted from 1.

    Where a chunk begins, the running length says by binary search at which page
    the next one must begin: a page that is cut leaves its last piece, and pages
    go on behind that as long as they fit.  These pointers are followed by
    doubling (two steps at once, four, eight, ...), so a document takes about
    n log n steps however many pages and chunks it has.  A null length counts as
    none; pages of one number stand in order of their length.
    """
    number = lambda c: F.col(c).cast("bigint")
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(number(page).alias("page"), F.coalesce(number(length), F.lit(0)).alias("n")))).alias("ps"), F.count("*").cast("int").alias("size"))
    rows = _once(rows, upto=_running(F.col("ps.n"), F.col("size")))
    # what a page that begins a chunk leaves in the chunk that goes on behind it, and how many chunks it makes
    left = lambda n: F.when(n <= budget, n).otherwise((n - 1) % budget + 1)
    made = lambda n: F.greatest(F.ceil(n / budget), F.lit(1)).cast("int")
    after = F.transform("ps", lambda p, i: _below(F.col("upto"), F.get("upto", i) + budget - left(p["n"]), F.col("size")))
    rows = _once(rows, after=after)
    # jumps[b]: where 2^b chunk beginnings further is; size: nowhere
    further = lambda to: F.transform(to, lambda at: F.coalesce(F.get(to, at), F.col("size")))
    rows = _once(rows, jumps=F.aggregate(_bits(F.col("size")), F.array("after"), lambda all_, _: F.concat(all_, F.array(further(F.element_at(all_, -1))))))
    jump = lambda b, at: F.coalesce(F.get(F.get("jumps", b), at), F.col("size"))
    last = F.aggregate(F.reverse(_bits(F.col("size"))), F.struct(F.lit(0).alias("at"), F.lit(0).alias("k")), lambda s, b: F.when(jump(b, s["at"]) < F.col("size"), F.struct(jump(b, s["at"]).alias("at"), (s["k"] + _two_to(b)).alias("k"))).otherwise(s))
    rows = _once(rows, count=last["k"] + 1)
    begin = lambda k: F.aggregate(_bits(F.col("count")), F.lit(0), lambda at, b: F.when(k.bitwiseAND(_two_to(b)) > 0, jump(b, at)).otherwise(at))
    rows = _once(rows, begins=F.transform(F.sequence(F.lit(0), F.col("count") - 1), begin))
    # chunks that a beginning adds: those of its page, and one more if anything is in the last of them
    filled = lambda at: left(F.get("ps", at)["n"]) + F.get("upto", F.get("after", at) - 1) - F.get("upto", at)
    adds = F.transform("begins", lambda at: made(F.get("ps", at)["n"]) - 1 + F.when(filled(at) > 0, 1).otherwise(0))
    rows = _once(rows, sums=_running(adds, F.col("count")))
    group = lambda i: _below(F.col("begins"), i, F.col("count")) - 1
    placed = _once(rows, groups=F.transform("ps", lambda p, i: group(i)))

    def place(p: Column, i: Column) -> Column:
        k = F.get("groups", i)
        first = F.when(k > 0, F.get("sums", k - 1)).otherwise(F.lit(0)) + 1
        starts = F.get("begins", k) == i
        behind = first + made(F.get("ps", F.get("begins", k))["n"]) - 1
        return F.struct(p["page"].alias("page"), p["n"].alias("n"), F.when(starts, first).otherwise(behind).alias("chunk"), F.when(starts, made(p["n"])).otherwise(F.lit(1)).alias("pieces"))

    of = placed.select(doc, F.explode(F.transform("ps", place)).alias("x")).select(doc, "x.*", F.explode(F.sequence(F.lit(0), F.col("x.pieces") - 1)).alias("k"))
    start = F.col("k").cast("bigint") * budget
    return of.select(doc, (F.col("chunk") + F.col("k")).cast("int").alias("chunk"), "page", start.alias("start"), F.when(F.col("pieces") > 1, F.least(F.lit(budget), F.col("n") - start)).otherwise(F.col("n")).cast("bigint").alias("taken"))
