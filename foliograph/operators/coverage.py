"""What the index holds and what it still lacks: counts, spans, pending work."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

STATES = ("indexado", "sin_sumarios", "error", "roto")
#: Bulletins before this day are only fetched when asked for.
CURRENT_SINCE = date(2018, 1, 1)


def by_state(bulletins: DataFrame, *keys: str) -> DataFrame:
    """Bulletins by state, a column each and 0 where there are none, and their total."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    return bulletins.groupBy(*keys).agg(*counts, F.count("*").alias("total"))


def date_span(bulletins: DataFrame, *keys: str) -> DataFrame:
    """Number of bulletins and their first and last day."""
    return bulletins.groupBy(*keys).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def with_text(articles: DataFrame, *keys: str) -> DataFrame:
    """How many articles have a summary that isn't blank, of how many."""
    return articles.groupBy(*keys).agg(F.count_if(F.trim(F.coalesce("summary", F.lit(""))) != "").alias("with_text"), F.count("*").alias("n"))


def pending(calendar: DataFrame, bulletins: DataFrame) -> DataFrame:
    """Calendar entries that aren't in the index or failed there; broken ones don't count."""
    known = bulletins.select("bulletin", "state")
    return calendar.join(known, "bulletin", "left").where("state is null or state = 'error'")


def pending_counts(calendar: DataFrame, bulletins: DataFrame, since: date = CURRENT_SINCE) -> DataFrame:
    """One row: pending from ``since`` on (an unknown date counts), pending before."""
    old = F.coalesce(F.col("date") < F.lit(since), F.lit(False))
    return pending(calendar, bulletins).agg(F.count_if(~old).alias("pending"), F.count_if(old).alias("pending_before"))


def coverage(calendar: DataFrame, bulletins: DataFrame, since: date = CURRENT_SINCE) -> DataFrame:
    """One row: processed bulletins, their span, pending ones, broken ones."""
    done = bulletins.where("state in ('indexado', 'sin_sumarios')").agg(F.count("*").alias("processed"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    broken = bulletins.where("state = 'roto'").agg(F.count("*").alias("broken"))
    wait = pending_counts(calendar, bulletins, since)
    one = lambda df, c: df.select(c).scalar().alias(c)
    return done.select("*", one(wait, "pending"), one(wait, "pending_before"), one(broken, "broken"))


def snapshot(calendar: DataFrame, bulletins: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: coverage, counts by origin and state as an array of structs, articles and articles with text."""
    per_origin = by_state(bulletins, "origin").agg(F.array_sort(F.collect_list(F.struct("origin", *STATES, "total"))).alias("origins"))
    texts = with_text(articles).select(F.struct("with_text", "n").alias("t"))
    return coverage(calendar, bulletins).select("*", per_origin.select("origins").scalar().alias("origins"), texts.scalar().alias("articles"))
