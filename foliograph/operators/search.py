"""Boolean search over articles and their bulletins.

Articles: id, bulletin, number, summary, norm (folded summary), department,
section, section_norm.  Bulletins: bulletin, number, date, extraordinary, state,
origin.  One scan with all predicates in it; order and page are a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidSearch
from ..functions.text import Term, fold_text, highlighter, parse_terms, phrase_count, positive_phrases, predicate
from ..shipping import ship
from ..sources.store import GRAM, KEY, gram_key, text_counts, text_length

# Limits of a page, and the relevance formula's constants.
DEFAULT_LIMIT, MOST, FURTHEST = 20, 200, 1_000_000
#: bm25 constants, and the weight of terms that are in over half the rows.
K1, B, COMMON = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Filters:
    """What narrows a search besides its terms; all optional, dates inclusive."""

    since: date | None = None
    until: date | None = None
    extraordinary: bool | None = None
    section: str | None = None
    state: str | None = None

    def __post_init__(self):
        if self.since and self.until and self.since > self.until:
            raise InvalidSearch("the dates are the wrong way round")

    def condition(self) -> Column:
        """A row without a date fails a filter by date."""
        parts = []
        if self.since:
            parts.append(F.col("date") >= F.lit(self.since))
        if self.until:
            parts.append(F.col("date") <= F.lit(self.until))
        if self.extraordinary is not None:
            parts.append(F.col("extraordinary") == F.lit(self.extraordinary))
        if self.section:
            parts.append(F.contains("section_norm", F.lit(fold_text(self.section))))
        if self.state:
            parts.append(F.col("state") == F.lit(self.state))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def whole_number(value, name: str, least: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise InvalidSearch(f"{name} must be a whole number")
    if not least <= value <= most:
        raise InvalidSearch(f"{name} must be between {least} and {most}")
    return value


def joined(articles: DataFrame, bulletins: DataFrame) -> DataFrame:
    """Articles with their bulletin's date, number, flags; an equi-join whose strategy Spark picks by size."""
    return articles.join(bulletins.withColumnRenamed("number", "bulletin_number"), "bulletin")


def matching(articles: DataFrame, bulletins: DataFrame, terms: Sequence[Term | dict | str] = (), filters: Filters = Filters(), word_start: bool = False) -> DataFrame:
    """All rows that match; text predicates are checked on articles before the join."""
    parsed = parse_terms(terms)
    return joined(articles.where(predicate(F.col("norm"), parsed, word_start)), bulletins).where(filters.condition())


def newest_first() -> list[Column]:
    """Date (null last), bulletin number, article number, and the id, so that pages never overlap."""
    return [F.desc("date"), F.desc("bulletin_number"), F.asc("number"), F.asc("id")]


def bm25(articles: DataFrame, phrases: Sequence[str], counts: DataFrame | None = None) -> Column:
    """The relevance of each row, lower is better, by statistics over all rows with text.

    Only phrases of a trigram or more count; repeats count again; ``word_start``
    doesn't matter here.  ``counts`` (n, mean) are a store's; how many rows hold
    a phrase is counted in one pass over the folded texts alone.
    """
    ranked = [p for p in phrases if len(p) >= GRAM]
    holds = [F.count_if(F.contains("norm", F.lit(p))).cast("double").alias(f"df{k}") for k, p in enumerate(ranked)]
    held = articles.where("norm <> ''").agg(*holds).select(F.struct("*").alias("s")).scalar()
    of = (text_counts(articles) if counts is None else counts).select(F.struct("n", "mean").alias("s")).scalar()
    total = F.lit(0.0)
    for k, p in enumerate(ranked):
        rarity = F.ln((of["n"] - held[f"df{k}"] + 0.5) / (held[f"df{k}"] + 0.5))
        rarity = F.when(rarity > 0, rarity).otherwise(F.lit(COMMON))
        tf = phrase_count(F.col("norm"), p).cast("double")
        total = total + rarity * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * text_length() / of["mean"]))
    return -total


def search(
    articles: DataFrame,
    bulletins: DataFrame,
    terms: Sequence[Term | dict | str] = (),
    filters: Filters = Filters(),
    word_start: bool = False,
    order: str = "date",
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    highlight: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One page of matches, newest or most relevant first.

    ``limit`` is cut at MOST, ``offset`` above FURTHEST is an error.  Ordering by
    relevance falls back on dates if no positive phrase has a trigram; rows that
    no ranked phrase is in come last.  Texts are looked at where they are
    scanned: scores are worked out there, and only narrow rows are joined and
    ordered; the page's few summaries are fetched last, to be marked.
    """
    limit = min(whole_number(limit, "limit", 1, 1 << 31), MOST)
    offset = whole_number(offset, "offset", 0, FURTHEST)
    if order not in ("date", "relevance"):
        raise InvalidSearch("order is date or relevance")
    parsed = parse_terms(terms)
    keys, phrases = newest_first(), positive_phrases(parsed)
    rows = articles.where(predicate(F.col("norm"), parsed, word_start))
    if order == "relevance" and any(len(p) >= GRAM for p in phrases):
        rows = rows.withColumn("score", bm25(articles, phrases, counts))
        keys = [F.asc("score"), *keys]
    wide = [c for c in ("norm", "summary") if c in articles.columns]
    page = joined(rows.drop(*wide), bulletins).where(filters.condition()).orderBy(*keys).offset(offset).limit(limit)
    if not highlight:
        return page
    ship(articles.sparkSession)
    # MOST rows at most
    texts = articles.select("id", "summary").join(F.broadcast(page.select("id")), "id", "left_semi")
    return page.join(texts, "id").orderBy(*keys).withColumn("marked", highlighter(phrases, word_start)("summary"))


def total(found: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One row: the exact number of matches and where the next page starts (null if this is the last)."""
    n = F.count("*")
    return found.agg(n.alias("total"), F.when(n > offset + limit, F.lit(offset + limit).cast("long")).alias("next_offset"))


# --- optional postings -------------------------------------------------------


def through_postings(articles: DataFrame, postings: DataFrame, phrase: str, word_start: bool = False) -> DataFrame:
    """Rows that hold one phrase: posting lists intersected, then the phrase checked.  Short phrases scan.

    Postings: gram and id, or a store's, whose grams are keys and whose rows are
    known by (seg, part, row).
    """
    folded = fold_text(phrase)
    if len(folded) < GRAM:
        return articles.where(predicate(F.col("norm"), parse_terms([phrase]), word_start))
    grams = sorted({folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)})
    key = KEY if "spots" in postings.columns else ["id"]
    wanted = [gram_key(g) for g in grams] if "spots" in postings.columns else grams
    ids = postings.where(F.col("gram").isin(wanted)).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select(*key)
    return articles.join(ids, key, "left_semi").where(predicate(F.col("norm"), parse_terms([phrase]), word_start))
