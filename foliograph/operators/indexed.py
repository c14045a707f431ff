"""Search through a store's postings: phrases by positions, relevance from what the postings hold, texts never read.

Every phrase of a trigram or more is answered from the postings of the few
trigrams that cover it, read in the parts alone that have all of them.  Phrases
that are shorter, and groups of negations only, need the articles' other
columns, or their texts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.text import HAS, Term, and_groups, highlighter, parse_terms, positive_phrases
from ..shipping import ship
from ..sources.store import GRAM, KEY, Store, cover, occurrences
from .search import COMMON, DEFAULT_LIMIT, FURTHEST, K1, MOST, B, Filters, InvalidSearch, joined, matching, newest_first, whole_number

#: Parts that are named in a look-up; of more, the folders are chosen by a join.
NAMED = 2_000
#: How many of the best scores are looked at first, and at most.
LEAST_CANDIDATES, MOST_CANDIDATES = 200, 100_000


def answerable(terms: Sequence[Term], store: Store) -> bool:
    """Can postings alone tell which texts match?"""
    return bool(terms) and all(len(t.phrase) >= GRAM for t in terms) and store.indexed


def _in_parts(store: Store, phrases: Sequence[str]) -> DataFrame:
    """Postings of the phrases' grams, in the parts alone that have all grams of one of them.

    The parts' folders are named if they are few, else chosen by what is
    broadcast: a row of a few bytes for each part of PART_BYTES of texts.
    """
    covers = [{g for _, g in cover(p)} for p in phrases]
    keys = sorted(set().union(*covers))
    postings, near = store.postings.where(F.col("gram").isin(keys)), store.grams.where(F.col("gram").isin(keys)).select("seg", "part", "gram")
    few = near.limit(NAMED * len(keys) + 1).collect()
    if len(few) > NAMED * len(keys):
        complete = (F.count_if(F.col("gram").isin(sorted(grams))) == len(grams) for grams in covers)
        parts = near.groupBy("seg", "part").agg(reduce(lambda a, b: a | b, complete).alias("some")).where("some").select("seg", "part")
        return postings.join(F.broadcast(parts), ["seg", "part"], "left_semi")
    held: dict[tuple[int, int], set[int]] = {}
    for r in few:
        held.setdefault((r["seg"], r["part"]), set()).add(r["gram"])
    by_segment: dict[int, list[int]] = {}
    for (seg, part), grams in sorted(held.items()):
        if any(own <= grams for own in covers):
            by_segment.setdefault(seg, []).append(part)
    return postings.where(reduce(lambda a, b: a | b, ((F.col("seg") == seg) & F.col("part").isin(own) for seg, own in by_segment.items()), F.lit(False)))


def phrase_hits(store: Store, phrases: Sequence[str], word_start: bool = False) -> DataFrame:
    """(seg, part, row, length, tf0, at0, tf1, ...): texts with any of the folded phrases, how often each is in them, and whether it is where it may be (with ``word_start``, once at least where a word starts)."""
    phrases = list(phrases)
    lists = _in_parts(store, phrases).groupBy(*KEY).agg(F.any_value("length").alias("length"), F.collect_list(F.struct("gram", "spots")).alias("lists"))
    # a map would be looked through as often, and its keys checked
    spots = lambda g: F.get(F.filter("lists", lambda x: x["gram"] == g), F.lit(0))["spots"]
    own = [[spots(g) for _, g in cover(p)] for p in phrases]
    counts = [F.coalesce(F.size(occurrences(o, p)), F.lit(0)).alias(f"tf{k}") for k, (o, p) in enumerate(zip(own, phrases, strict=True))]
    begun = [_begun(o, p).alias(f"at{k}") for k, (o, p) in enumerate(zip(own, phrases, strict=True))] if word_start else []
    held = lists.select(*KEY, "length", *counts, *begun)
    if not word_start:
        held = held.select("*", *((F.col(f"tf{k}") > 0).alias(f"at{k}") for k in range(len(phrases))))
    return held.where(reduce(lambda a, b: a | b, (F.col(f"tf{k}") > 0 for k in range(len(phrases)))))


def _begun(lists: Sequence[Column], phrase: str) -> Column:
    """Is the phrase anywhere where a word starts?"""
    starting = F.filter(lists[0], lambda s: s.bitwiseAND(1) == 1)
    return F.coalesce(F.size(occurrences([starting, *lists[1:]], phrase)) > 0, F.lit(False))


def _condition(terms: Sequence[Term], phrases: list[str]) -> Column:
    def holds(t: Term) -> Column:
        found = F.coalesce(F.col(f"at{phrases.index(t.phrase)}"), F.lit(False))
        return found if t.mode == HAS else ~found

    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(holds, group)) for group in and_groups(terms)))


def _relevance(counts: tuple[int, float | None], held: Sequence[int], phrases: list[str], ranked: list[str]) -> Column:
    """bm25, lower is better.  counts: texts and their mean length; held: how many texts hold each phrase."""
    n, mean = counts
    total = F.lit(0.0)
    for p in ranked:
        k = phrases.index(p)
        rarity = math.log((n - held[k] + 0.5) / (held[k] + 0.5))
        tf = F.coalesce(F.col(f"tf{k}"), F.lit(0)).cast("double")
        total = total + F.lit(rarity if rarity > 0 else COMMON) * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * F.coalesce("length", F.lit(0)) / F.lit(mean or 1.0)))
    return -total


def _holding(hits: DataFrame, n: int) -> list[Column]:
    return [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(n)]


def _only_positive(terms: Sequence[Term]) -> bool:
    """Must a text hold one of the phrases to match?"""
    return all(any(t.mode == HAS for t in group) for group in and_groups(terms))


def indexed_matches(store: Store, terms: Sequence[Term | dict | str], word_start: bool = False, relevance: bool = False) -> DataFrame:
    """Articles, without their texts, that match the terms; with ``relevance`` also their ``score``.  All phrases must have a trigram (``answerable``)."""
    parsed = parse_terms(terms)
    phrases = list(dict.fromkeys(t.phrase for t in parsed))
    found = phrase_hits(store, phrases, word_start)
    if relevance:
        held = found.agg(*_holding(found, len(phrases))).first()
        found = found.withColumn("score", _relevance(store.version().counts, held, phrases, positive_phrases(parsed)))
    columns = [*KEY, *(f"at{k}" for k in range(len(phrases))), *(["score"] if relevance else [])]
    narrow = store.articles.drop("norm", "summary")
    if _only_positive(parsed):
        rows = found.where(_condition(parsed, phrases)).select(*columns).join(narrow, KEY)
    else:  # texts without any of the phrases can match as well
        rows = narrow.where("chars > 0").join(found.select(*columns), KEY, "left").where(_condition(parsed, phrases))
        if relevance:
            rows = rows.withColumn("score", F.coalesce("score", F.lit(-0.0)))
    return rows.drop(*(f"at{k}" for k in range(len(phrases))))


def best_page(store: Store, bulletins: DataFrame, terms: Sequence[Term], filters: Filters, word_start: bool, limit: int, offset: int, first: int | None = None) -> DataFrame | None:
    """A page by relevance from the best scores alone, or None where that doesn't pay.

    Scores come from the postings.  The best of them are joined with articles
    and bulletins and filtered; if the page's last row is better than the last
    of them, no other can be on it.  Else eight times as many are looked at, up
    to MOST_CANDIDATES; then all have to be.  With one phrase the order doesn't
    depend on how many texts hold it, so that is counted (observed) by the job
    that finds the best; with several the hits (no texts, a few numbers each) are
    kept between the counting and the ranking.
    """
    phrases = list(dict.fromkeys(t.phrase for t in terms))
    hits = phrase_hits(store, phrases, word_start)
    if len(phrases) == 1:
        return _best_page(store, bulletins, terms, filters, phrases, hits, None, limit, offset, first)
    hits = hits.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held = hits.agg(*_holding(hits, len(phrases))).first()
        return _best_page(store, bulletins, terms, filters, phrases, hits, held, limit, offset, first)
    finally:
        hits.unpersist()


def _best_page(store: Store, bulletins: DataFrame, terms: Sequence[Term], filters: Filters, phrases: list[str], hits: DataFrame, held: Sequence[int] | None, limit: int, offset: int, first: int | None) -> DataFrame | None:
    """``best_page`` from the hits; ``held``: how many texts hold each phrase, None if that is still to be counted."""
    spark = store.spark
    ranked, counts = positive_phrases(terms), store.version().counts
    want = first or max(LEAST_CANDIDATES, 4 * (offset + limit))
    while want <= MOST_CANDIDATES:
        seen = Observation()
        rows = hits if held is not None else hits.observe(seen, *_holding(hits, 1))
        order = _relevance(counts, held or [0], phrases, ranked)
        best = rows.where(_condition(terms, phrases)).select(*KEY, "length", *(f"tf{k}" for k in range(len(phrases))), order.alias("order")).orderBy("order", *KEY).limit(want + 1)
        candidates = best.toArrow()  # MOST_CANDIDATES at most
        if not candidates.num_rows:
            return joined(store.articles.drop("norm", "summary").withColumn("score", F.lit(0.0)).limit(0), bulletins)
        if held is None:
            held = [seen.get["df0"]]
        local = spark.createDataFrame(candidates).withColumn("score", _relevance(counts, held, phrases, ranked)).select(*KEY, "order", "score")
        near: dict[int, set[int]] = {}
        for seg, part in zip(candidates["seg"].to_pylist(), candidates["part"].to_pylist(), strict=True):
            near.setdefault(seg, set()).add(part)
        narrow = store.articles.drop("norm", "summary").where(reduce(lambda a, b: a | b, ((F.col("seg") == seg) & F.col("part").isin(sorted(own)) for seg, own in near.items())))
        told = F.broadcast(narrow.join(F.broadcast(local), KEY))  # as many rows
        page = joined(told, bulletins).where(filters.condition()).orderBy("score", *newest_first()).offset(offset).limit(limit).toArrow()  # MOST rows at most
        # the candidates are all that match, or none that isn't one of them is as good as the page's last
        if candidates.num_rows <= want or page.num_rows == limit and page["order"][-1].as_py() < candidates["order"][-1].as_py():
            return spark.createDataFrame(page).drop("order")
        want *= 8
    return None


def matching_articles(store: Store, bulletins: DataFrame, terms: Sequence[Term | dict | str] = (), filters: Filters = Filters(), word_start: bool = False) -> DataFrame:
    """``search.matching`` over a store, through its postings where they can tell."""
    parsed = parse_terms(terms)
    if not answerable(parsed, store):
        return matching(store.articles, bulletins, parsed, filters, word_start)
    return joined(indexed_matches(store, parsed, word_start), bulletins).where(filters.condition())


def search_store(
    store: Store,
    bulletins: DataFrame,
    terms: Sequence[Term | dict | str] = (),
    filters: Filters = Filters(),
    word_start: bool = False,
    order: str = "date",
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    highlight: bool = False,
) -> DataFrame:
    """``search.search`` over a store: the same page, by postings where they can tell; the store is looked at as it is now."""
    from .search import search

    store = store.pinned()
    parsed = parse_terms(terms)
    if not answerable(parsed, store):
        return search(store.articles, bulletins, parsed, filters, word_start, order, limit, offset, highlight, store.statistics)
    limit = min(whole_number(limit, "limit", 1, 1 << 31), MOST)
    offset = whole_number(offset, "offset", 0, FURTHEST)
    if order not in ("date", "relevance"):
        raise InvalidSearch("order is date or relevance")
    phrases = positive_phrases(parsed)
    relevance = order == "relevance" and bool(phrases)
    keys = [*([F.asc("score")] if relevance else []), *newest_first()]
    page = best_page(store, bulletins, parsed, filters, word_start, limit, offset) if relevance and _only_positive(parsed) else None
    if page is None:
        page = joined(indexed_matches(store, parsed, word_start, relevance), bulletins).where(filters.condition()).orderBy(*keys).offset(offset).limit(limit)
    if not highlight:
        return page
    ship(store.spark)
    # MOST rows at most
    texts = store.articles.select(*KEY, "summary").join(F.broadcast(page.select(*KEY)), KEY, "left_semi")
    return page.join(texts, KEY).orderBy(*keys).withColumn("marked", highlighter(phrases, word_start)("summary"))
