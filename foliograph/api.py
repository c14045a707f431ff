"""The outer contract: every call answers {"ok": ...} and never raises.

``Library`` holds the tables that calls read: what pages, catalogues and
resolvers said, as ``sources`` read them.  ``Gazette`` answers from it and from
the index.  A call that asks for one record collects that record; listings and
searches are bounded pages.
"""

from __future__ import annotations

import os
import re
import sys
import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import wraps
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import GazetteError, InvalidAddress, InvalidRequest, InvalidSearch, NoIndex, NotFound, SiteClosed, UnreadablePage
from .functions.identifiers import SITE, Cve
from .functions.scalars import OLD_PDF
from .functions.text import AND, CONTENT, SUMMARY, and_groups, contains_phrase, fold, fold_text, parse_terms, predicate
from .operators import browse, coverage, federate, guard, locate, search as s
from .operators.paging import CHUNK, LEAST, MOST, chunk_at
from .operators.search import Filters
from .shipping import ship
from .sources.records import record_url

# A listing's days by default, bulletins a page of the site's search, days that each catalogue covers.
LISTED_DAYS, SITE_PAGE = 30, 10
FIRST_DAY, LAST_OLD_DAY = date(2014, 1, 1), date(2021, 3, 12)
OLD_LIMIT = 100


def answered(call: Callable[..., dict]) -> Callable[..., dict]:
    """Wrap a call: ok and its fields, or ok false with an error and its code, whatever happens."""

    @wraps(call)
    def run(*args: Any, **kwargs: Any) -> dict:
        try:
            return {"ok": True} | call(*args, **kwargs)
        except GazetteError as error:
            return {"ok": False, "error": str(error), "error_code": error.code} | error.details()
        except Exception as error:
            if isinstance(error, TypeError) and "argument" in str(error) and error.__traceback__.tb_next is None:
                return {"ok": False, "error": str(error), "error_code": InvalidRequest.code}  # of the call itself
            traceback.print_exc(file=sys.stderr)
            return {"ok": False, "error": "an internal error; its details are in the log", "error_code": "internal_error"}

    return run


def day(value: date | str | None, name: str, kind: type[GazetteError] = InvalidRequest) -> date | None:
    """A day given as such, as YYYY-MM-DD or as DD/MM/YYYY; empty is none."""
    if value is None or isinstance(value, str) and not value.strip():
        return None
    if isinstance(value, date):
        return value.date() if isinstance(value, datetime) else value
    for form in ("%Y-%m-%d", "%d/%m/%Y"):
        try:
            return datetime.strptime(str(value).strip(), form).date()
        except ValueError:
            continue
    raise kind(f"{name} {value!r} is no day; write YYYY-MM-DD or DD/MM/YYYY")


def old_search_text(text: str) -> str:
    """What the old portal's search takes: one line of 3 to 200 characters that ISO-8859-1 has."""
    if not isinstance(text, str):
        raise InvalidSearch("the text must be a text")
    line = " ".join(text.split())
    if not 3 <= len(line) <= 200:
        raise InvalidSearch("the text must have 3 to 200 characters")
    try:
        line.encode("latin-1")
    except UnicodeEncodeError as error:
        raise InvalidSearch("the text has characters that the portal doesn't know") from error
    return line


@dataclass(frozen=True)
class Library:
    """What was read from the sources; each table may be missing, and calls that need it then say so.

    bulletins, articles: ``records.read_pages`` of them.  summaries, catalogue,
    old_bulletins, old_articles: of the functions of ``records`` with that name
    (``old_results``).  redirects: cve, target.  sections, units: parent, id,
    name.  pdf_pages: name (an identifier, or an old PDF's address), page, text,
    error.  pdf_files: name, size, sha256.  calendar: ``records.calendar``.
    outcomes: the guard's log of the site.
    """

    bulletins: DataFrame | None = None
    articles: DataFrame | None = None
    summaries: DataFrame | None = None
    redirects: DataFrame | None = None
    sections: DataFrame | None = None
    units: DataFrame | None = None
    calendar: DataFrame | None = None
    catalogue: DataFrame | None = None
    old_bulletins: DataFrame | None = None
    old_articles: DataFrame | None = None
    pdf_pages: DataFrame | None = None
    pdf_files: DataFrame | None = None
    outcomes: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        found = getattr(self, name)
        if found is None:
            raise NotFound(f"the library has no {name}")
        return found

    def one(self, name: str, /, **key: Any) -> dict:
        """The one row of a key; one that couldn't be read is that error."""
        rows = self.table(name)
        for column, value in key.items():
            rows = rows.where(F.col(column) == F.lit(value))
        found = rows.limit(1).collect()
        if not found:
            raise NotFound(f"there is no {' '.join(map(str, key.values()))} among {name}")
        row = found[0].asDict(True)
        if row.pop("error", None):
            raise UnreadablePage(f"{' '.join(map(str, key.values()))} couldn't be read: {found[0]['error']}")
        return row


class Gazette:
    """The index as a service over DataFrames (articles, bulletins, calendar, the store's counts), and the library beside it."""

    def __init__(self, articles: DataFrame | None = None, bulletins: DataFrame | None = None, calendar: DataFrame | None = None, library: Library = Library(), counts: DataFrame | None = None, max_errors: int = guard.MAX_ERRORS, clock: Callable[[], datetime] = datetime.now):
        self._articles, self._bulletins = articles, bulletins
        self._calendar, self.counts = calendar, counts
        self.library, self.max_errors, self.clock = library, max_errors, clock
        self.runs: list = []

    # --- the index -----------------------------------------------------------

    def _index(self, name: str) -> DataFrame:
        found = getattr(self, f"_{name}")
        if found is None:
            raise NoIndex("there is no index yet; take bulletins in first")
        return found

    @property
    def articles(self) -> DataFrame:
        return self._index("articles")

    @property
    def bulletins(self) -> DataFrame:
        return self._index("bulletins")

    @property
    def calendar(self) -> DataFrame:
        return self.bulletins.select("bulletin", "number", "date") if self._calendar is None else self._calendar

    def _coverage(self) -> dict:
        return coverage.coverage(self.calendar, self.bulletins).first().asDict()

    @answered
    def search(self, terms=(), order: str = "date", word_start: bool = False, limit: int = s.DEFAULT_LIMIT, offset: int = 0, highlight: bool = True, since=None, until=None, extraordinary=None, section=None, state=None) -> dict:
        """A page of matches with the exact total, where the next page starts, coverage and warnings.  Arguments are checked before anything runs."""
        narrowed = Filters(day(since, "since", InvalidSearch), day(until, "until", InvalidSearch), extraordinary, section, state)
        parsed = parse_terms(terms)
        s.whole_number(limit, "limit", 1, 1 << 31), s.whole_number(offset, "offset", 0, s.FURTHEST)
        page = s.search(self.articles, self.bulletins, parsed, narrowed, word_start, order, limit, offset, highlight, self.counts)
        counted = s.total(s.matching(self.articles, self.bulletins, parsed, narrowed, word_start), min(limit, s.MOST), offset).first()
        rows = [r.asDict(True) for r in page.drop("norm", "section_norm").collect()]  # MOST rows at most
        covered = self._coverage()
        warnings = [f"{covered[k]} bulletins {what}" for k, what in (("pending", "aren't in the index yet"), ("broken", "can't be read")) if covered[k]]
        return {"rows": rows, "total": counted["total"], "next_offset": counted["next_offset"], "coverage": covered, "warnings": warnings}

    @answered
    def coverage(self) -> dict:
        return {"coverage": self._coverage()}

    @answered
    def status(self) -> dict:
        """The index; one that isn't there yet is an answer, not an error."""
        if self._articles is None or self._bulletins is None:
            return {"exists": False, "status": None, "warning": "there is no index yet"}
        return {"exists": True, "status": coverage.snapshot(self.calendar, self.bulletins, self.articles).first().asDict(True), "runs": [r.progress() for r in self.runs]}

    @answered
    def bulletin_of_article(self, article: int) -> dict:
        row = browse.bulletin_of_article(self.articles, self.bulletins, F.lit(article)).first()
        return {"bulletin": row["bulletin"] if row else None}

    @answered
    def state_of(self, bulletin) -> dict:
        row = self.bulletins.where(F.col("bulletin") == F.lit(bulletin)).select("state").first()
        return {"state": row["state"] if row else None}

    @answered
    def identify(self, text: str) -> dict:
        cve = Cve.parse(text)
        return {"cve": str(cve), "kind": cve.kind, "year": cve.year, "number": cve.number, "extraordinary": cve.extraordinary}

    # --- listings ------------------------------------------------------------

    @answered
    def list_bulletins(self, since=None, until=None) -> dict:
        """Bulletins of both catalogues between two days (the last LISTED_DAYS by default), newest first, LISTED_MOST at most; without the old one the listing is degraded."""
        end = day(until, "until") or self.clock().date()
        start = day(since, "since") or end - timedelta(days=LISTED_DAYS)
        if end < start:
            raise InvalidRequest("the dates are the wrong way round")
        own = self.library.table("calendar").select(F.col("cve").alias("bulletin"), "number", "date", "extraordinary", "title", "url", F.lit(None).cast("long").alias("record"), F.lit("new").alias("origin"))
        old = self.library.catalogue
        other = None
        if start <= LAST_OLD_DAY and old is not None:
            other = browse.between(old, None, LAST_OLD_DAY).select(F.col("cve").alias("bulletin"), "number", "date", "extraordinary", F.col("suffix").alias("title"), "url", "record", F.lit("old").alias("origin"))
        missing = start <= LAST_OLD_DAY and old is None
        rows, counted = browse.listing(own, other if other is not None or missing else own.limit(0), start, end)
        told = counted.first().asDict()
        found = [r.asDict() for r in rows.collect()]  # LISTED_MOST rows at most
        return {"since": start, "until": end, "bulletins": found} | told | ({"warning": "the old portal's catalogue is missing"} if missing else {})

    def _entities(self, name: str, parent: int) -> dict:
        if isinstance(parent, bool) or not isinstance(parent, int) or parent < 1:
            raise InvalidRequest("the id must be a whole number from 1 on")
        rows, counted = browse.limited(self.library.table(name).where(F.col("parent") == parent), browse.LISTED_MOST, F.asc("id"))
        return {"parent": parent, "total": counted.first()["total"], name: [{"id": r["id"], "name": r["name"]} for r in rows.collect()]}

    @answered
    def sections(self, department: int) -> dict:
        return self._entities("sections", department)

    @answered
    def units(self, section: int) -> dict:
        return self._entities("units", section)

    # --- one record ----------------------------------------------------------

    def _bulletin(self, cve: Cve) -> dict:
        try:
            return self.library.one("bulletins", cve=str(cve.as_kind("B")))
        except NotFound as error:
            if cve.year <= LAST_OLD_DAY.year:
                raise NotFound(f"{error}; the old portal may have it", hint=f"old_bulletin(cve={str(cve.as_kind('B'))!r})") from error
            raise

    @staticmethod
    def _listed(row: dict) -> list[dict]:
        return [a | {"department": d["name"], "section": c["name"], "section_id": c["id"], "unit": u["name"]} for d in row["departments"] for c in d["sections"] for u in c["units"] for a in u["articles"]]

    @answered
    def bulletin(self, cve: str, hidden: bool = False) -> dict:
        """A bulletin's tree; with ``hidden`` also the articles that its page leaves out, as far as they can be told and read."""
        own = Cve.parse(cve)
        row = self._bulletin(own)
        listed = self._listed(row)
        answer = row | {"total_articles": len(listed)}
        if hidden and listed:
            spark = self.library.table("bulletins").sparkSession
            numbers = spark.createDataFrame([(str(own), a["number"]) for a in listed], "bulletin string, number long")
            gaps = federate.numbering_gaps(numbers)
            wanted = federate.fetchable_gaps(gaps).select("bulletin", F.col("hidden").alias("number"))
            pages = self.library.table("articles").where(F.col("bulletin_cve") == str(own)).select("number", "cve", "summary", "heading", "error")
            found = [r.asDict() for r in wanted.join(pages, "number", "left").orderBy("number").collect()]  # HIDDEN_MOST at most
            answer["hidden"] = [r for r in found if r["cve"] is not None]
            answer["errors"] = [{"stage": "articulo", "number": r["number"], "error_code": UnreadablePage.code if r["error"] else NotFound.code} for r in found if r["cve"] is None]
            answer["errors"] += [r.asDict() for r in federate.too_many_gaps(gaps).collect()]
        return answer

    @answered
    def summary(self, cve: str) -> dict:
        """A bulletin's summary as a flat list; one of free text says so."""
        return self.library.one("summaries", bulletin_cve=str(Cve.parse(cve).as_kind("B")))

    def _resolved(self, cve: Cve) -> str | None:
        if self.library.redirects is None:
            return None
        row = self.library.redirects.where(F.col("cve") == str(cve)).select("target").first()
        return row["target"] if row else None

    @staticmethod
    def _address(target: str | None) -> tuple[Cve, int] | None:
        """(bulletin, number) of an article's address."""
        parts = (target or "").rstrip("/").split("/")
        if len(parts) < 3 or parts[-2] != "articulo" or not parts[-1].isdigit():
            return None
        return Cve.parse(parts[-3]), int(parts[-1])

    def _tries(self, cve: Cve) -> DataFrame:
        """What to try for an extraordinary article: the index and the resolver where they name an extraordinary bulletin of its year, then the ranges of the year's bulletins."""
        pages = self.library.table("bulletins").where(F.col("error").isNull() & F.col("extraordinary") & (F.split("cve", "-")[2] == str(cve.year)))
        flat = pages.select("number", F.explode_outer("departments").alias("d")).select("number", F.explode_outer("d.sections").alias("c")).select("number", F.explode_outer("c.units").alias("u")).select("number", F.explode_outer("u.articles").alias("a"))
        listed = flat.where("a is not null").select(F.col("number").alias("bulletin"), F.col("a.number").alias("number"))
        year = self.library.calendar
        known = pages.select(F.col("number").alias("bulletin")) if year is None else year.where(F.col("extraordinary") & (F.split("cve", "-")[2] == str(cve.year))).select(F.col("number").alias("bulletin"))
        unlisted = known.distinct().join(listed.select("bulletin").distinct(), "bulletin", "left_anti")
        spark = pages.sparkSession
        target = spark.createDataFrame([(cve.number,)], "number long")
        allowed = locate.attempts_allowed(self.max_errors)
        tries = locate.candidates(locate.locate(target, locate.spans(listed)), unlisted, most=allowed)
        shortcuts = []
        if self._articles is not None and "cve" in self._articles.columns:
            row = self.articles.where(F.col("cve") == str(cve)).join(self.bulletins.where("origin = 'new'").select("bulletin", F.col("cve").alias("b_cve")), "bulletin").select("b_cve").first()
            shortcuts.append(Cve.parse(row["b_cve"]) if row else None)
        there = self._address(self._resolved(cve))
        shortcuts.append(there[0] if there and there[1] == cve.number else None)
        good = [(cve.number, b.number, k) for k, b in enumerate(shortcuts) if b is not None and b.kind == "BX" and b.year == cve.year]
        return locate.with_shortcuts(tries, spark.createDataFrame(good, "number long, bulletin long, rank int"), most=allowed)

    def _article(self, cve: Cve, number: int | None) -> dict:
        """The page of an article, which must show the very article that was asked for."""
        if cve.kind in ("B", "BX"):
            if isinstance(number, bool) or not isinstance(number, int) or number < 1:
                raise InvalidRequest("a bulletin's identifier needs the number of an article, from 1 on")
            return self.library.one("articles", bulletin_cve=str(cve), number=number)
        if cve.kind not in ("A", "AX"):
            raise InvalidRequest(f"{cve} is no article; read_pdf reads summaries and pages")
        if number is not None:
            raise InvalidRequest("an article's identifier says its number")
        if cve.kind == "A":
            there = self._address(self._resolved(cve))
            if there is None:
                raise NotFound(f"the resolver knows no page of {cve}")
            row = self.library.one("articles", bulletin_cve=str(there[0]), number=there[1])
            if row["cve"] != str(cve):
                raise NotFound(f"the page of {there[0]}, article {there[1]} shows {row['cve']}, not {cve}")
            return row
        tries = [(r["turn"], r["bulletin"], r["untried"]) for r in self._tries(cve).orderBy("turn").collect()]  # one or two
        for _, bulletin, _ in tries:
            try:
                row = self.library.one("articles", bulletin_cve=f"BOME-BX-{cve.year}-{bulletin}", number=cve.number)
            except (NotFound, UnreadablePage):
                continue
            if row["cve"] == str(cve):
                return row
        raise NotFound(f"{cve} wasn't found in {len(tries)} tries", tried=[f"BOME-BX-{cve.year}-{b}" for _, b, _ in tries], untried=max((u for *_, u in tries), default=0))

    @answered
    def locate_article(self, cve: str, number: int | None = None) -> dict:
        row = self._article(Cve.parse(cve), number)
        return {"cve": row["cve"], "bulletin": row["bulletin_cve"], "number": row["number"], "url": row["url"]}

    @answered
    def resolve(self, cve: str) -> dict:
        """The canonical address of any identifier.  The site's resolver takes extraordinary ones for ordinary ones: articles are located without it, pages get their PDF's address."""
        own = Cve.parse(cve)
        if own.kind == "AX":
            return {"cve": str(own), "url": self._article(own, None)["url"]}
        if own.kind == "PX":
            return {"cve": str(own), "url": f"{SITE}/bome/descargar/{own}.pdf", "warning": "the resolver mistakes pages of extraordinary bulletins; this is the page's PDF, which wasn't looked for"}
        target = self._resolved(own)
        if target is None:
            raise NotFound(f"the resolver doesn't know {own}")
        named = [Cve.parse(p) for p in target.split("/") if p.upper().startswith("BOME-")]
        if named and named[0].extraordinary != own.extraordinary:
            raise NotFound(f"the resolver sends {own} to {named[0]}, a bulletin of the other kind")
        return {"cve": str(own), "url": target if target.startswith("http") else SITE + target}

    # --- reading -------------------------------------------------------------

    @staticmethod
    def _chunk(texts: Sequence[str], page: int, at: int, budget: int, **facts: Any) -> dict:
        for name, value in (("page", page), ("at", at), ("budget", budget)):
            if isinstance(value, bool) or not isinstance(value, int):
                raise InvalidRequest(f"{name} must be a whole number")
        pieces, after = chunk_at(texts, page, at, max(LEAST, min(budget, MOST)))
        return facts | {"pages": [p | {"empty": not p["text"].strip()} for p in pieces], "total_pages": len(texts), "next": {"page": after[0], "at": after[1]} if after else None}

    def _pdf_texts(self, name: str) -> list[str]:
        """A document's page texts; one record, so they are gathered."""
        rows = self.library.table("pdf_pages").where(F.col("name") == name).orderBy("page").collect()
        if not rows:
            raise NotFound(f"there is no PDF of {name}")
        if rows[0]["error"]:
            raise UnreadablePage(f"the PDF of {name} couldn't be read: {rows[0]['error']}")
        return [r["text"] or "" for r in rows]

    @answered
    def read(self, texts: list[str], page: int = 1, at: int = 0, budget: int = CHUNK) -> dict:
        """One chunk of a document's page texts; the budget is kept between its limits."""
        return self._chunk(texts, page, at, budget)

    @answered
    def read_article(self, cve: str, number: int | None = None, page: int = 1, at: int = 0, budget: int = CHUNK) -> dict:
        """An article's text by printed page: from its page, else from its PDF, else nothing and a warning."""
        row = self._article(Cve.parse(cve), number)
        facts = {"cve": row["cve"], "url": row["url"], "bulletin": row["bulletin_cve"], "date": row["bulletin_date"], "heading": row["heading"], "summary": row["summary"], "source": "html"}
        if row["text"] is not None:
            return self._chunk([p["text"] for p in row["pages"]], page, at, budget, printed=[p["number"] for p in row["pages"]], **facts)
        try:
            return self._chunk(self._pdf_texts(row["cve"]), page, at, budget, **facts | {"source": "pdf", "warning": "the page has no text; this is the PDF's"})
        except NotFound:
            return self._chunk([], page, at, budget, **facts | {"source": "none", "warning": "neither the page nor a PDF has the text"})

    @answered
    def read_bulletin(self, cve: str, page: int = 1, at: int = 0, budget: int = CHUNK) -> dict:
        """A whole bulletin's text, that is its PDF's, with the bulletin's facts."""
        own = Cve.parse(cve)
        if own.kind not in ("B", "BX"):
            raise InvalidRequest(f"{own} is no bulletin")
        row = self._bulletin(own)
        facts = {k: row[k] for k in ("cve", "number", "date", "extraordinary", "url", "pdf_url")} | {"total_articles": len(self._listed(row)), "source": "pdf"}
        try:
            return self._chunk(self._pdf_texts(str(own)), page, at, budget, **facts)
        except NotFound:
            return self._chunk([], page, at, budget, **facts | {"source": "none", "warning": "there is no PDF; read the articles one by one"})

    @staticmethod
    def _pdf_name(cve: str | None, url: str | None) -> str:
        if (cve is None) == (url is None):
            raise InvalidRequest("give an identifier or an address, not both")
        if cve is not None:
            return str(Cve.parse(cve))
        if not isinstance(url, str) or not re.match(OLD_PDF, url):
            raise InvalidAddress("only addresses of the old portal's PDFs are read")
        return url.replace("http://", "https://", 1)

    @answered
    def read_pdf(self, cve: str | None = None, url: str | None = None, page: int = 1, at: int = 0, budget: int = CHUNK) -> dict:
        name = self._pdf_name(cve, url)
        return self._chunk(self._pdf_texts(name), page, at, budget, name=name, source="pdf")

    @answered
    def download_pdf(self, cve: str | None = None, url: str | None = None) -> dict:
        """What is known of a PDF that was stored: name, size, sha256, pages."""
        name = self._pdf_name(cve, url)
        row = self.library.one("pdf_files", name=name)
        return {k: row[k] for k in ("name", "size", "sha256")} | {"pages": len(self._pdf_texts(name))}

    # --- searches of the site ------------------------------------------------

    def _open(self) -> None:
        """Refuse while the site's guard is shut: a cooldown, or a full budget of errors."""
        if self.library.outcomes is None:
            return
        state = self._guard()
        if state["closed_seconds"] > 0:
            raise SiteClosed("the site turned us away", state["closed_seconds"], True)
        if state["wait_seconds"] > 0:
            raise SiteClosed("the budget of errors is used up", state["wait_seconds"], False)

    def _guard(self) -> dict:
        now = F.lit(self.clock()).cast("timestamp")
        log = self.library.table("outcomes")
        shut = guard.closings(log).agg(F.max("deadline").alias("deadline"), F.max_by("cause", "deadline").alias("cause")).first()
        recent = log.where(guard.is_error() & (F.col("ts") > now - F.expr(f"interval {guard.WINDOW_SECONDS} seconds"))).orderBy(F.desc("ts")).limit(self.max_errors).select("ts").collect()
        wait = (recent[-1]["ts"] + timedelta(seconds=guard.WINDOW_SECONDS) - self.clock()).total_seconds() if len(recent) >= self.max_errors else 0.0
        left = (shut["deadline"] - self.clock()).total_seconds() if shut["deadline"] else 0.0
        return {"closed_seconds": max(left, 0.0), "cause": shut["cause"] if left > 0 else None, "errors": len(recent), "max_errors": self.max_errors, "wait_seconds": max(wait, 0.0)}

    def _criteria(self, terms, scope, since, until, section, numbers: dict) -> tuple[list, date, date]:
        if scope not in (SUMMARY, CONTENT):
            raise InvalidSearch(f"the scope is {SUMMARY} or {CONTENT}")
        parsed = parse_terms(terms, scoped=True, scope=scope)
        start, end = day(since, "since", InvalidSearch), day(until, "until", InvalidSearch)
        browse.check_search(parsed, {"section": section}, numbers, start, end)
        start, end = start or FIRST_DAY, end or self.clock().date()
        if end < start:
            raise InvalidSearch("the dates are the wrong way round")
        return parsed, start, end

    def _texts(self) -> DataFrame:
        """(bulletin, number, norm, content): articles with their folded summaries and page texts."""
        rows = self.library.table("articles").where("error is null")
        ship(rows.sparkSession)
        return rows.select(F.col("bulletin_cve").alias("bulletin"), "number", "cve", "summary", "heading", fold(F.col("summary")).alias("norm"), fold(F.col("text")).alias("content"))

    @staticmethod
    def _holds(group) -> Any:
        """All terms of a group in one article, each in its scope."""
        found = F.lit(True)
        for t in group:
            one = contains_phrase(F.col("norm" if t.scope == SUMMARY else "content"), t.phrase)
            found = found & (one if t.mode == "has" else ~one)
        return found

    def _dated(self, start: date, end: date) -> DataFrame:
        rows = self.library.table("bulletins").where("error is null").select(F.col("cve").alias("bulletin"), "number", "date", "extraordinary", "url", F.lit(False).alias("failed"))
        broken = self.library.table("bulletins").where("error is not null")
        if "key" in broken.columns and dict(broken.dtypes)["key"] == "string":
            rows = rows.unionByName(broken.select(F.col("key").alias("bulletin"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("boolean").alias("extraordinary"), F.lit(None).cast("string").alias("url"), F.lit(True).alias("failed")))
        return rows.where(F.col("failed") | F.col("date").between(start, end))

    @answered
    def search_bulletins(self, terms=(), scope: str = SUMMARY, since=None, until=None, section: int | None = None, page: int = 1, **numbers: int) -> dict:
        """A page of SITE_PAGE bulletins that the site's search finds: all terms in one article, OR refused; and the parameters that the site would be asked with."""
        parsed, start, end = self._criteria(terms, scope, since, until, section, numbers)
        federate.without_or(parsed)
        s.whole_number(page, "page", 1, s.FURTHEST)
        self._open()
        rows = self._dated(start, end).where("not failed")
        exact = {k: v for k, v in numbers.items() if k in ("bulletin_number", "year")}
        rows = browse.exactly(rows.withColumn("bulletin_number", F.col("number")), **exact)
        inner = {k: v for k, v in numbers.items() if k not in exact}
        if parsed or inner:
            held = browse.exactly(self._texts(), **inner).where(self._holds(parsed))
            rows = rows.join(held.select("bulletin").distinct(), "bulletin", "left_semi")
        if section is not None:
            flat = self.library.table("bulletins").where("error is null").select(F.col("cve").alias("bulletin"), F.explode("departments").alias("d")).select("bulletin", F.explode("d.sections.id").alias("id"))
            rows = rows.join(flat.where(F.col("id") == section).select("bulletin").distinct(), "bulletin", "left_semi")
        total = rows.count()
        found = rows.orderBy(*federate.newest_first()).offset((page - 1) * SITE_PAGE).limit(SITE_PAGE)
        sent = federate.site_parameters([(t.scope, t.mode, t.text) for t in parsed], start.isoformat(), end.isoformat(), list(numbers.items()))
        return {"bulletins": [r.asDict() for r in found.drop("failed", "bulletin_number").collect()], "page": page, "total_pages": -(-total // SITE_PAGE), "total": total, "parameters": sent}

    @answered
    def search_articles(self, terms=(), since=None, until=None, section: int | None = None, number: int | None = None, max_bulletins: int = federate.BULLETINS[0], max_articles: int = federate.ARTICLES[0]) -> dict:
        """Articles of the bulletins that the site's search finds for each alternative, newest bulletin first, under both budgets; what went wrong on the way is told."""
        parsed, start, end = self._criteria(terms, SUMMARY, since, until, section, {} if number is None else {"number": number})
        federate._bounded(max_bulletins, "max_bulletins", federate.BULLETINS[1]), federate._bounded(max_articles, "max_articles", federate.ARTICLES[1])
        self._open()
        texts = self._texts()
        groups = and_groups(parsed) or [[]]
        dated, hits = self._dated(start, end), None
        for k, group in enumerate(groups):
            held = texts.where(self._holds(group)).select("bulletin").distinct()
            own = dated.where("not failed").join(held, "bulletin", "left_semi") if group else dated.where("not failed")
            own = own.select("*", F.lit(k).alias("stream"), F.lit(0).alias("page"), F.lit(0).alias("pos"))
            hits = own if hits is None else hits.unionByName(own)
        found = federate.merged_streams(hits).drop("stream", "page", "pos").unionByName(dated.where("failed"))
        rows = texts.where(predicate(F.col("norm"), parsed)).withColumn("id", F.col("cve"))
        if number is not None:
            rows = browse.exactly(rows, number=number)
        if section is not None:
            listed = self.library.table("bulletins").where("error is null").select(F.col("cve").alias("bulletin"), F.explode("departments").alias("d")).select("bulletin", F.explode("d.sections").alias("c")).select("bulletin", F.col("c.id").alias("section_id"), F.col("c.name").alias("section"), F.explode("c.units").alias("u")).select("bulletin", "section_id", "section", F.explode("u.articles.number").alias("number"))
            hidden = rows.select("bulletin", "number", F.split("heading", " - ")[1].alias("section")).join(listed.select("bulletin", "number"), ["bulletin", "number"], "left_anti")
            rows = rows.join(browse.of_section(listed, hidden, section).select("bulletin", "number"), ["bulletin", "number"], "left_semi")
        shown, counted = federate.drill_down(found, rows.drop("norm", "content"), max_bulletins, max_articles)
        totals = federate.stream_totals(hits).first()
        # the newest of those that couldn't be read, opened or not, as many as the largest budget has bulletins
        failed = [r["bulletin"] for r in found.where("failed").orderBy(*federate.newest_first()).limit(federate.BULLETINS[1]).collect()]
        sent = [federate.site_parameters([(t.scope, t.mode, t.text) for t in g], start.isoformat(), end.isoformat()) for g in groups]
        return counted.first().asDict() | {"articles": [r.asDict() for r in shown.orderBy("place").collect()], "total_bulletins": totals["total"] or 0, "total_exact": totals["exact"], "distinct_bulletins": totals["bulletins"], "errors": [{"stage": "bome", "bulletin": b, "error_code": UnreadablePage.code} for b in failed], "parameters": sent}

    # --- the old portal ------------------------------------------------------

    @answered
    def check_old_search(self, text: str) -> dict:
        return {"text": old_search_text(text)}

    @answered
    def search_old(self, text: str, since=None, until=None, limit: int = OLD_LIMIT) -> dict:
        """Articles of the old portal that hold a text, case aside, in the portal's order; days filter afterwards."""
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= browse.LISTED_MOST:
            raise InvalidSearch(f"the limit must be 1 to {browse.LISTED_MOST}")
        start, end = day(since, "since", InvalidSearch), day(until, "until", InvalidSearch)
        if start and end and end < start:
            raise InvalidSearch("the dates are the wrong way round")
        line = old_search_text(text)
        rows = self.library.table("old_articles")
        every = rows.where(F.contains(F.lower("summary"), F.lit(line.lower())))
        page, counted = browse.limited(browse.between(every, start, end), limit, F.asc("key"), F.asc("place"))
        total = counted.first()["total"]
        found = [r.asDict(True) for r in page.collect()]  # the limit's rows at most
        return {"text": line, "total": total, "total_unfiltered": every.count(), "truncated": total > limit, "articles": found} | ({} if found else {"warning": "nothing found; the search is literal, try a shorter text"})

    @answered
    def old_bulletin(self, cve: str | None = None, record: int | None = None) -> dict:
        """A bulletin of the old portal by identifier or record; an identifier that it repeats is an error that names the records."""
        if record is not None and (isinstance(record, bool) or not isinstance(record, int) or record < 1):
            raise InvalidRequest("the record must be a whole number from 1 on")
        if (cve is None) == (record is None):
            raise InvalidRequest("give an identifier or a record, not both")
        if record is None:
            found = browse.lookup_one(self.library.table("catalogue"), cve=str(Cve.parse(cve)))
            if found is None:
                raise NotFound(f"the old catalogue has no {cve}")
            record = found["record"]
        row = self.library.one("old_bulletins", record=record)
        spark = self.library.table("old_bulletins").sparkSession
        url = spark.range(1).select(record_url(F.lit(record))).first()[0]
        return row | {"total_articles": len(row["articles"]), "url": url} | ({} if row["official"] else {"warning": "the number is the old portal's own and may repeat; cite date and record too"})

    # --- runs and the server -------------------------------------------------

    @answered
    def synchronise(self, run) -> dict:
        """Start a run (``streaming.sync.SyncRun``) unless one is on its way."""
        busy = next((r for r in self.runs if r.progress()["state"] == "en_curso"), None)
        if busy is not None:
            return busy.progress()
        told = run.start()
        if told["state"] == "en_curso":
            self.runs.append(run)
        return told

    @answered
    def cancel(self) -> dict:
        busy = next((r for r in self.runs[::-1]), None)
        return busy.cancel() if busy is not None else {"state": "inactivo", "message": "there is no run in this process"}

    @answered
    def server_status(self, settings: dict | None = None, listener=None) -> dict:
        """What the service works with: process, versions, folders, settings, the guard, runs and streams."""
        import pyspark

        from . import __version__
        from .sources.files import data_folder, folder_of

        paths = {"data": data_folder(), "pdf": folder_of("pdf"), "index": folder_of("index")}
        return {
            "version": __version__, "spark": pyspark.__version__, "pid": os.getpid(),
            "folders": {k: {"path": str(p), "because": why} for k, (p, why) in paths.items()},
            "index": self._articles is not None, "site": SITE, "settings": settings or {},
            "guard": self._guard() if self.library.outcomes is not None else None,
            "runs": [r.progress() for r in self.runs], "streams": listener.snapshot() if listener else {},
        }


#: SQL functions that need no Python: name, parameters, what they return and how.
NATIVE_FUNCTIONS = (
    ("phrase_count", "folded STRING, phrase STRING", "INT", r"CASE WHEN phrase = '' THEN 0 ELSE regexp_count(folded, concat('(?=\\Q', replace(phrase, '\\E', '\\E\\\\E\\Q'), '\\E)')) END"),
    ("word_start", "folded STRING, phrase STRING", "BOOLEAN", r"phrase <> '' AND folded RLIKE concat('(?<![\\p{L}\\p{N}])\\Q', replace(phrase, '\\E', '\\E\\\\E\\Q'), '\\E')"),
    ("parse_cve", "text STRING", "STRUCT<kind: STRING, year: INT, number: BIGINT>", r"CASE WHEN regexp_extract(upper(regexp_replace(text, '(?U)\\s+', '')), '^BOME-([ASPB]X?)-(\\d{4})-0*([1-9]\\d*)$', 0) <> '' THEN named_struct('kind', split(upper(regexp_replace(text, '(?U)\\s+', '')), '-')[1], 'year', cast(split(regexp_replace(text, '(?U)\\s+', ''), '-')[2] AS INT), 'number', try_cast(split(regexp_replace(text, '(?U)\\s+', ''), '-')[3] AS BIGINT)) END"),
)


def register_functions(spark: SparkSession) -> None:
    """SQL functions: phrase_count, word_start, parse_cve without Python; normalize, highlight, html_to_text over Arrow batches; chunks as a table function over an array of texts or a table of pages."""
    from pyspark.sql import Row
    from pyspark.sql.functions import pandas_udf, udtf
    from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    from .functions.text import mark_matches
    from .operators.paging import Greedy
    from .sources.tree import parse, plain_text

    ship(spark)
    for name, parameters, kind, body in NATIVE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

    @pandas_udf("string")
    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(fold_text)

    @pandas_udf("string")
    def highlight(texts: pd.Series, phrases: pd.Series, word_starts: pd.Series) -> pd.Series:
        return pd.Series([mark_matches(t, [fold_text(p) for p in ps], bool(w)) for t, ps, w in zip(texts, phrases, word_starts, strict=True)])

    @pandas_udf("string")
    def html_to_text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: plain_text(parse(h)) if h else "")

    class Chunks:
        """An array of page texts, or a table of pages (doc, page, and text or length), one document after another."""

        def __init__(self):
            self.greedy = None

        @staticmethod
        def analyze(pages: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable:
                return AnalyzeResult(StructType().add("chunk", IntegerType()).add("page", IntegerType()).add("start", IntegerType()).add("text", StringType()).add("cut", BooleanType()))
            kinds = {f.name: f.dataType for f in pages.dataType}
            if not {"doc", "page"} <= set(kinds) or not {"text", "length"} & set(kinds):
                raise ValueError("the pages need the columns doc, page, and text or length")
            told = StructType().add("doc", kinds["doc"]).add("chunk", IntegerType()).add("page", kinds["page"]).add("start", LongType()).add("taken", LongType())
            return AnalyzeResult(told.add("text", StringType()) if "text" in kinds else told)

        def eval(self, pages, budget: int):
            if isinstance(pages, Row):
                self.greedy = self.greedy or Greedy()
                text = pages["text"] or "" if "text" in pages else None
                for chunk, start, taken in self.greedy.place(pages["length"] or 0 if text is None else len(text), budget):
                    yield (pages["doc"], chunk, pages["page"], start, taken, *([] if text is None else [text[start : start + taken]]))
                return
            cursor, number = (1, 0) if pages else None, 0
            while cursor:
                pieces, cursor = chunk_at(pages, *cursor, budget)
                number += 1
                for p in pieces:
                    yield number, p["page"], p["start"], p["text"], p["cut"]

    for name, function in (("normalize", normalize), ("highlight", highlight), ("html_to_text", html_to_text)):
        spark.udf.register(name, function)
    spark.udtf.register("chunks", udtf(Chunks))


__all__ = ["AND", "Gazette", "Library", "answered", "day", "old_search_text", "register_functions"]
