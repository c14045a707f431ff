"""Scalar functions over scraped values: dates, counters, statuses, headings, addresses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..errors import InvalidRequest

# What the sources' texts and answers look like.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
OLD_PDF = r"^https?://www\.melilla\.es/mandar\.php/n/\d+/\d+/[A-Za-z0-9_]+\.pdf$"
STORED_STATUS = r"^HTTP (\d{3}) "
#: HTTP statuses that mean "go away".
BLOCKED = (403, 429, 503)

# Texts are read in the form that ``clean`` and lower case leave.
#: Signs for "number", and how the word for an extraordinary issue begins, with the sources' typing error.
NUMBER_SIGNS, EXTRA_WORDS = ("nº", "n°", "n º", "n °"), ("extra", "estra")
EXTRAORDINARY = rf"(?:{'|'.join(EXTRA_WORDS)})\p{{L}}*"
NUMBER_SIGN = f"(?:{'|'.join(NUMBER_SIGNS)}) ?"
#: The counter of result pages: its words, each with the number that follows.
COUNTER_WORDS = ("página", "de", "mostrando", "total de")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def clean(text: Column) -> Column:
    """Runs of white space (no-break spaces too) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def month_number(name: Column) -> Column:
    months = F.create_map(*(F.lit(x) for k, m in enumerate((*MONTHS, "setiembre")) for x in (m, 9 if k == 12 else k + 1)))
    return months[F.lower(name)]


def spanish_date(text: Column) -> Column:
    """The first "22 de septiembre de 2026" in a text, null if there is none or no such day; read word by word."""

    def first(words: Column) -> Column:
        word = lambda i: F.coalesce(F.get(words, i), F.lit(""))
        five = F.transform(words, lambda w, i: F.struct(F.regexp_extract(w, r"\d{1,2}$", 0).alias("day"), word(i + 1).alias("of"), word(i + 2).alias("month"), word(i + 3).alias("of_year"), F.regexp_extract(word(i + 4), r"^\d{4}", 0).alias("year")))
        said = F.filter(five, lambda d: (d["day"] != "") & (d["of"] == "de") & d["month"].rlike(r"^\p{L}+$") & (d["of_year"] == "de") & (d["year"] != ""))
        return F.get(F.transform(F.slice(said, 1, 1), lambda d: F.concat_ws("-", d["year"], month_number(d["month"]), d["day"])), F.lit(0))

    # an array of one, so that the words have a name: the text is split once, not once for each of its words
    return F.try_to_date(F.get(F.transform(F.array(F.split(F.lower(clean(text)), " ")), first), F.lit(0)), "yyyy-M-d")


def figures_date(text: Column) -> Column:
    """The day of a text that is nothing but "9-3-2021", else null."""

    def of(parts: Column) -> Column:
        part = lambda k, most: F.when(F.length(F.get(parts, F.lit(k))).between(1, most), F.get(parts, F.lit(k)).try_cast("int"))
        day, month, year = part(0, 2), part(1, 2), F.when(F.length(F.get(parts, F.lit(2))) == 4, part(2, 4))
        return F.when(F.size(parts) == 3, F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), "y-M-d"))

    return once(F.split(text, "-"), of)


def flexible_date(text: Column) -> Column:
    """YYYY-MM-DD or DD/MM/YYYY, else null."""
    trimmed = F.trim(text)
    iso = F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(trimmed, "yyyy-MM-dd"))
    return F.coalesce(iso, F.when(trimmed.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(trimmed, "d/M/yyyy")))


def first_int(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")


def ordinal_number(text: Column) -> Column:
    """The number behind "Nº", "N°" or "No."; the signs are read as the letter that they stand for."""
    plain = F.translate(F.lower(clean(text)), "º°", "oo")
    return F.regexp_extract(F.replace(plain, F.lit("no."), F.lit("no")), r"no ?(\d+)", 1).try_cast("bigint")


def heading_parts(heading: Column) -> Column:
    """struct(department, section, unit) of "A - B - C..."; under three parts all of it is the department."""
    parts = F.split(heading, " - ", -1)
    whole = F.size(parts) < 3
    return F.struct(
        F.when(whole, heading).otherwise(parts[0]).alias("department"),
        F.when(whole, F.lit("")).otherwise(F.try_element_at(parts, F.lit(2))).alias("section"),
        F.when(whole, F.lit("")).otherwise(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), " - ")).alias("unit"),
    )


def path_parts(path: Column) -> Column:
    """The same struct from an array of headings: first, second, and the rest joined with " / "."""
    at = lambda k: F.coalesce(F.try_element_at(path, F.lit(k)), F.lit(""))
    return F.struct(at(1).alias("department"), at(2).alias("section"), F.array_join(F.slice(path, 3, F.greatest(F.size(path) - 2, F.lit(0))), " / ").alias("unit"))


def result_counter(text: Column) -> Column:
    """struct(page, pages, shown, total) of "Página 1 de 3. Mostrando 10 elementos de un total de 1.934 elementos."."""
    plain = F.replace(F.lower(clean(text)), F.lit("pagina"), F.lit(COUNTER_WORDS[0]))
    said = F.regexp_extract(plain, f"{COUNTER_WORDS[0]} \\d.* elementos?", 0)

    def behind(words: str) -> Column:
        figures = F.regexp_extract(said, f"{words} ((?:\\d|\\.\\d)+)", 1)
        return F.replace(figures, F.lit("."), F.lit("")).try_cast("bigint")

    page, pages, shown, total = map(behind, COUNTER_WORDS)
    whole = page.isNotNull() & pages.isNotNull() & shown.isNotNull() & total.isNotNull()
    return F.when(whole, F.struct(F.greatest(page, F.lit(1)).alias("page"), pages.alias("pages"), shown.alias("shown"), total.alias("total")))


def catalogue_label(text: Column) -> Column:
    """struct(extraordinary, number, suffix, date, cve) of a catalogue link's text, null if it has no number or day.

    "nº Extra16 / 09-03-2021": the day is what stands behind the last slash;
    before it signs for "number" and the word for an extraordinary issue may
    stand, and then the number, with what follows it.
    """

    def fields(p: Column) -> Column:
        label, digits, day, extra = p["label"], p["digits"], p["day"], p["kind"] != ""
        return once(digits.try_cast("bigint"), lambda number: F.when(day.isNotNull() & (number > 0), F.struct(extra.alias("extraordinary"), number.alias("number"), F.when(label != digits, label).alias("suffix"), day.alias("date"), F.concat_ws("-", F.lit("BOME"), F.when(extra, "BX").otherwise("B"), F.year(day), number).alias("cve"))))

    def numbered(p: Column) -> Column:
        label = F.regexp_replace(F.substr(p["unsigned"], F.length(p["kind"]) + 1), "^[ -]+", "")
        return once(label, lambda said: fields_of(p, said))

    def fields_of(p: Column, label: Column) -> Column:
        digits = F.regexp_extract(label, rf"(?i)^(?:{NUMBER_SIGN})?(\d+)", 1)
        return once(F.struct(label.alias("label"), digits.alias("digits"), p["day"].alias("day"), p["kind"].alias("kind")), fields)

    def unsigned(p: Column) -> Column:
        name = F.regexp_replace(p["name"], rf"(?i)^{NUMBER_SIGN}\.? ?", "")
        return once(name, lambda said: once(F.struct(said.alias("unsigned"), F.regexp_extract(said, f"(?i)^{EXTRAORDINARY}", 0).alias("kind"), p["day"].alias("day")), numbered))

    def parts(plain: Column) -> Column:
        day = figures_date(F.trim(F.regexp_extract(plain, "([^/]*)$", 1)))
        # a text without a day is none, whatever else it says
        return once(F.struct(F.trim(F.regexp_extract(plain, "^(.*)/", 1)).alias("name"), day.alias("day")), lambda p: F.when(p["day"].isNotNull(), unsigned(p)))

    return once(clean(text), parts)


def status_class(status: Column) -> Column:
    """ok, blocked (403, 429, 503), not_found (404), broken (other 5xx), refused (other 4xx), no_answer (null)."""
    return (
        F.when(status.isNull(), "no_answer")
        .when(status.isin(*BLOCKED), "blocked")
        .when(status == 404, "not_found")
        .when(status.between(500, 599), "broken")
        .when(status >= 400, "refused")
        .otherwise("ok")
    )


def status_in_message(message: Column) -> Column:
    """The HTTP status that a stored message begins with."""
    return F.regexp_extract(message, STORED_STATUS, 1).try_cast("int")


ENGLISH_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: Days as mail and HTTP write them: day, month, year, clock, zone; and as C's asctime does: month, day, clock, year.
MAIL_DAY = r"^(?:[a-z]+,? ?)?(\d{1,2})[ -]([a-z]{3})[a-z]*[ -](\d{4}|\d{2}) (\d{1,2}:\d{2}(?::\d{2})?)(?: ?(gmt|utc?|z|[+-]\d{4}))?$"
C_DAY = r"^[a-z]{3},? ([a-z]{3}) (\d{1,2}) (\d{1,2}:\d{2}:\d{2}) (\d{4})$"


def http_time(text: Column) -> Column:
    """The moment that a header states in one of the three forms of HTTP dates, or with an offset; null if it is none."""
    plain = F.lower(clean(text))
    months = F.create_map(*(F.lit(x) for k, m in enumerate(ENGLISH_MONTHS, 1) for x in (m, f"{k:02d}")))

    def moment(day: Column, month: Column, year: Column, clock: Column, offset: Column) -> Column:
        full = F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") < 69, "20").otherwise("19"), year)).otherwise(year)
        time = F.concat(F.lpad(F.substring_index(clock, ":", 1), 2, "0"), F.regexp_extract(clock, ":.*", 0), F.when(clock.rlike(":.*:"), "").otherwise(":00"))
        return F.concat(F.concat_ws("-", full, F.try_element_at(months, month), F.lpad(day, 2, "0")), F.lit("T"), time, offset).try_cast("timestamp")

    mail = lambda k: F.regexp_extract(plain, MAIL_DAY, k)
    short = lambda k: F.regexp_extract(plain, C_DAY, k)
    offset = F.when(mail(5).rlike("^[+-]"), F.concat(F.substring(mail(5), 1, 3), F.lit(":"), F.substring(mail(5), 4, 2))).otherwise("Z")
    return F.when(mail(1) != "", moment(mail(1), mail(2), mail(3), mail(4), offset)).when(short(1) != "", moment(short(2), short(1), short(4), short(3), F.lit("Z")))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a finite number (below 0: 0) or a moment (past: 0); junk gives null."""
    text = F.trim(header)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    left = http_time(text).cast("double") - now.cast("timestamp").cast("double")
    seconds = F.coalesce(number, left)
    return F.when(seconds < float("inf"), F.greatest(seconds, F.lit(0.0)))


def absolute_url(href: Column, base: str) -> Column:
    trimmed = F.trim(href)
    joined = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(trimmed, "^/+", ""))
    return F.when(trimmed == "", F.lit(None)).when(trimmed.rlike("^https?://"), trimmed).otherwise(joined)


def secure_url(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def allowed_pdf(url: Column) -> Column:
    """Is this the old portal's address of a PDF, and nothing else?"""
    return F.coalesce(url.rlike(OLD_PDF), F.lit(False))


def file_name_of(url: Column) -> Column:
    """A file name from an address: its last part, characters that a file system may not like as _."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+)/*$", 1)
    return F.regexp_replace(last, r"[^A-Za-z0-9._~-]", "_")


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- settings ----------------------------------------------------------------


def parse_setting(raw: str, whole: bool = False, least: float = 0.0, most: float = 86_400.0) -> float:
    """A number from the environment: decimal comma allowed, whole if it must be, within limits (a day at most)."""
    text = raw.strip().replace(",", ".")
    if not re.fullmatch(r"[+-]?\d+(\.\d+)?", text):
        raise InvalidRequest(f"not a number: {raw!r}")
    value = float(text)
    if whole and value != int(value):
        raise InvalidRequest(f"not a whole number: {raw!r}")
    if not least <= value <= most:
        raise InvalidRequest(f"{raw!r} is not between {least:g} and {most:g}")
    return value
