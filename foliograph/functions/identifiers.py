"""Gazette identifiers (CVE) and addresses, as Columns and in Python.

``BOME-<kind>-<year>-<number>``; kinds and the address of the site are fixed
values of the format.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..errors import InvalidIdentifier

#: Kinds: bulletin, article, summary, page; X for extraordinary.
KINDS = ("B", "BX", "A", "AX", "S", "SX", "P", "PX")
SITE = "https://bomemelilla.es"
CVE_PATTERN = r"^BOME-([A-Z]{1,2})-(\d{4})-(\d+)$"


def cve_struct(text: Column) -> Column:
    """struct(kind, year, number) of an identifier, null if it is none.

    White space is dropped and case ignored; numbers start at 1 and lose their
    leading zeros.
    """
    compact = F.upper(F.regexp_replace(text, r"(?U)\s+", ""))
    part = lambda k: F.regexp_extract(compact, CVE_PATTERN, k)
    number = part(3).try_cast("bigint")
    good = part(1).isin(*KINDS) & (number > 0)
    return F.when(good, F.struct(part(1).alias("kind"), part(2).try_cast("int").alias("year"), number.alias("number")))


def cve_text(cve: Column, kind: Column | None = None, number: Column | None = None) -> Column:
    """The canonical text, with another kind or number if given."""
    return F.concat_ws("-", F.lit("BOME"), cve["kind"] if kind is None else kind, cve["year"], cve["number"] if number is None else number)


def bulletin_of(cve: Column) -> Column:
    """The bulletin's identifier for a bulletin or summary, else null."""
    kind = F.when(cve["kind"].isin("B", "S"), "B").when(cve["kind"].isin("BX", "SX"), "BX")
    return F.when(kind.isNotNull(), cve_text(cve, kind))


def summary_of(cve: Column) -> Column:
    """The summary's identifier for a bulletin or summary, else null."""
    kind = F.when(cve["kind"].isin("B", "S"), "S").when(cve["kind"].isin("BX", "SX"), "SX")
    return F.when(kind.isNotNull(), cve_text(cve, kind))


def article_of(cve: Column, number: Column) -> Column:
    """Article ``number`` of a bulletin, null for other kinds."""
    kind = F.when(cve["kind"] == "B", "A").when(cve["kind"] == "BX", "AX")
    return F.when(kind.isNotNull(), cve_text(cve, kind, number))


def is_extraordinary(cve: Column) -> Column:
    return F.endswith(cve["kind"], F.lit("X"))


def bulletin_url(cve: Column, site: str = SITE) -> Column:
    return F.concat(F.lit(f"{site}/bome/"), bulletin_of(cve))


def summary_url(cve: Column, site: str = SITE) -> Column:
    return F.concat(bulletin_url(cve, site), F.lit("/sumario"))


def article_url(cve: Column, number: Column, site: str = SITE) -> Column:
    return F.when(cve["kind"].isin("B", "BX"), F.concat(bulletin_url(cve, site), F.lit("/articulo/"), number.cast("string")))


def pdf_url(cve: Column, site: str = SITE) -> Column:
    return F.concat(F.lit(f"{site}/bome/descargar/"), cve_text(cve), F.lit(".pdf"))


def resolver_url(cve: Column, site: str = SITE) -> Column:
    return F.concat(F.lit(f"{site}/buscar-cve?cve="), cve_text(cve))


@dataclass(frozen=True)
class Cve:
    """An identifier in Python, for arguments and parsers."""

    kind: str
    year: int
    number: int

    @classmethod
    def parse(cls, text: str) -> Cve:
        m = re.fullmatch(CVE_PATTERN[1:-1], re.sub(r"\s+", "", str(text)).upper())
        if not m or m[1] not in KINDS or not int(m[3]):
            raise InvalidIdentifier(f"not an identifier: {text!r}")
        return cls(m[1], int(m[2]), int(m[3]))

    def __str__(self) -> str:
        return f"BOME-{self.kind}-{self.year}-{self.number}"

    @property
    def extraordinary(self) -> bool:
        return self.kind.endswith("X")

    def as_kind(self, letter: str, number: int | None = None) -> Cve:
        """The bulletin (B), summary (S) or article (A) that goes with it."""
        if self.kind[0] not in ("BS" if letter != "A" else "B"):
            raise InvalidIdentifier(f"{self} has no kind {letter}")
        return Cve(letter + "X" * self.extraordinary, self.year, self.number if number is None else number)


# --- keys of the second source -----------------------------------------------


def catalogue_key(cve: Column, record_id: Column, repeated: Column) -> Column:
    """The identifier, or identifier~record where the catalogue repeats it."""
    return F.when(repeated, F.concat_ws("~", cve, record_id.cast("string"))).otherwise(cve)


def synthetic_article_key(record_id: Column, number: Column, occurrence: Column) -> Column:
    """MEL-record-number, with -k from the second article of that number on; no number counts as 0."""
    base = F.concat_ws("-", F.lit("MEL"), record_id.cast("string"), F.coalesce(number, F.lit(0)).cast("string"))
    return F.when(occurrence > 1, F.concat_ws("-", base, occurrence.cast("string"))).otherwise(base)
