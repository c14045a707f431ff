"""Lookups, listings and local filters: the parts of the outer calls that aren't a search."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import Ambiguous, InvalidRequest
from ..functions.text import Term, fold
from .federate import merged_catalogue, newest_first

LISTED_MOST = 500
ORIGINS = ("new", "old")
#: Numbers that a search can ask for exactly.
CRITERIA = ("bulletin_number", "number", "first_page", "year")


def states(bulletins: DataFrame, origin: str | None = None) -> DataFrame:
    """(bulletin, state), of one origin or of all; an origin that isn't known is refused."""
    if origin not in (None, *ORIGINS):
        raise InvalidRequest(f"there is no origin {origin!r}")
    rows = bulletins if origin is None else bulletins.where(F.col("origin") == F.lit(origin))
    return rows.select("bulletin", "state")


def bulletin_of_article(articles: DataFrame, bulletins: DataFrame, article: Column, origin: str = "new") -> DataFrame:
    """The bulletin of an article, if it came from ``origin``."""
    return articles.where(F.col("id") == article).join(bulletins.where(F.col("origin") == F.lit(origin)).select("bulletin"), "bulletin", "left_semi").select("bulletin")


def lookup(catalogue: DataFrame, cve: str | None = None, record: int | None = None) -> DataFrame:
    """Catalogue rows by identifier or by record id, one of the two."""
    if (cve is None) == (record is None):
        raise InvalidRequest("give an identifier or a record id, not both")
    return catalogue.where(F.col("cve") == F.lit(cve) if record is None else F.col("record") == F.lit(record))


def lookup_one(catalogue: DataFrame, cve: str | None = None, record: int | None = None):
    """The one row, None if there is none; an identifier that the catalogue repeats is an error that names the records."""
    rows = lookup(catalogue, cve, record).orderBy("record").collect()  # as many as share one identifier; all of them are the answer
    if len(rows) > 1:
        raise Ambiguous(cve or str(record), [r["record"] for r in rows])
    return rows[0] if rows else None


def exactly(rows: DataFrame, **numbers: int) -> DataFrame:
    """Rows whose numbers are just these; positive whole numbers of CRITERIA."""
    for name, value in numbers.items():
        if name not in CRITERIA or isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise InvalidRequest(f"{name}={value!r} is no criterion")
        rows = rows.where(F.year("date") == value) if name == "year" else rows.where(F.col(name) == value)
    return rows


def check_search(terms: list[Term], filters: dict, numbers: dict, since: date | None, until: date | None) -> None:
    """A search on the site needs something to search for, and dates the right way round."""
    if not (terms or any(v is not None for v in filters.values()) or numbers or since or until):
        raise InvalidRequest("nothing to search for")
    if since and until and since > until:
        raise InvalidRequest("the dates are the wrong way round")


def between(rows: DataFrame, since: date | None = None, until: date | None = None) -> DataFrame:
    """Inclusive; a row without a date fails only if a bound is given."""
    if since:
        rows = rows.where(F.col("date") >= F.lit(since))
    return rows.where(F.col("date") <= F.lit(until)) if until else rows


def of_section(listed: DataFrame, hidden: DataFrame, section_id: int) -> DataFrame:
    """A section's articles of each bulletin: listed ones by the section's id, hidden ones if their section's name is one that the bulletin gives to that id.

    listed: bulletin, number, section_id, section.  hidden: bulletin, number,
    section.  Names are compared folded.
    """
    wanted = listed.where(F.col("section_id") == section_id)
    names = wanted.select("bulletin", fold(F.col("section")).alias("name")).distinct()
    kept = hidden.withColumn("name", fold(F.col("section"))).join(names, ["bulletin", "name"], "left_semi")
    return wanted.select("bulletin", "number", "section", F.lit(True).alias("listed")).unionByName(kept.select("bulletin", "number", "section", F.lit(False).alias("listed")))


def listing(first: DataFrame, second: DataFrame | None, since: date, until: date, most: int = LISTED_MOST) -> tuple[DataFrame, DataFrame]:
    """(newest bulletins of both catalogues, one row: total, truncated, degraded).  Without the second catalogue the listing is degraded, not an error."""
    if since > until:
        raise InvalidRequest("the dates are the wrong way round")
    own = between(first, since, until)
    rows = own if second is None else merged_catalogue(own, between(second, since, until))
    n = F.count("*")
    return rows.orderBy(*newest_first()).limit(most), rows.agg(n.alias("total"), (n > most).alias("truncated"), F.lit(second is None).alias("degraded"))


def limited(rows: DataFrame, limit: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` (1 to 500) rows and their total before the limit."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= LISTED_MOST:
        raise InvalidRequest(f"the limit must be 1 to {LISTED_MOST}")
    return rows.orderBy(*order).limit(limit), rows.agg(F.count("*").alias("total"))


def readable_text(articles: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    """Each article's page texts and where they come from: the page itself, else its PDF, else nothing.

    articles: id, pages (array of struct with text).  pdf_pages: id, page, text.
    """
    from_pdf = pdf_pages.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]).alias("pdf"))
    own = F.transform("pages", lambda p: p["text"])
    has_own = F.coalesce(F.exists(own, lambda t: F.trim(t) != ""), F.lit(False))
    has_pdf = F.coalesce(F.exists("pdf", lambda t: F.trim(t) != ""), F.lit(False))
    joined = articles.join(from_pdf, "id", "left")
    texts = F.when(has_own, own).when(has_pdf, F.col("pdf")).otherwise(F.array().cast("array<string>"))
    return joined.select("id", texts.alias("texts"), F.when(has_own, "html").when(has_pdf, "pdf").otherwise("none").alias("origin"))


def catalogue_warnings(links: DataFrame) -> DataFrame:
    """What is wrong with catalogue links: (kind, record, year, n).

    links: pos, record, cve (null: unreadable), date, header_year.  Unreadable
    links one by one; records that come with several identifiers; and, one a
    header, how many bulletins of other years it has (first rows of a record
    count, by ``pos``).
    """
    unreadable = links.where("cve is null").select(F.lit("unreadable").alias("kind"), "record", F.lit(None).cast("int").alias("year"), F.lit(1).cast("long").alias("n"))
    good = links.where("cve is not null")
    conflict = good.groupBy("record").agg(F.count_distinct("cve").alias("n")).where("n > 1").select(F.lit("conflict").alias("kind"), "record", F.lit(None).cast("int").alias("year"), "n")
    # the least row of a record, not its rows in order: nothing is sorted again where rows come from a join by record
    first = good.groupBy("record").agg(F.min(F.struct("pos", "header_year", "date")).alias("f")).select("f.*").where("header_year <> year(date)")
    misfiled = first.groupBy("header_year").agg(F.count("*").alias("n")).select(F.lit("misfiled").alias("kind"), F.lit(None).cast("long").alias("record"), F.col("header_year").alias("year"), "n")
    return unreadable.unionByName(conflict).unionByName(misfiled)
