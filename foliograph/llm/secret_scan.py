"""Secret scans: fixed patterns, and a randomness test battery for what no pattern names.

Candidates are whole runs of characters that encoded data are written in.  Each
is put into the smallest encoding that holds its characters, and three tests
ask whether it could be data drawn evenly from that alphabet: chi-squared over
the alphabet, runs of character classes, and serial correlation of neighbours.
What they reject isn't random.  What they let through may just be too short to
tell, so the other question is asked as well: how likely natural text of that
length is to look like it.  Natural text is all the corpus' short words: how
often its neighbours change class, and how often two of its characters are the
same.  Both bounds fall with the length of a candidate, and over the candidates
of all documents the false discovery rate (Benjamini and Hochberg) is held at
RATE.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._shared import cut, python_ready, read_table

#: What the patterns look for, in this order; the length that their value (the last group, or all) has at least.
PATTERNS = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 32),  # runs are whole or not at all, so shorter ones need not be found first
)
KINDS = ("assign", "access", "hex", "random")
#: A text without any of these has no assignment.
NEEDED = ("password", "passwd", "secret", "token", "apikey", "api_key")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from small to large alphabets.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "upper hex": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "lower base36": DIGITS + LOWER,
    "upper base36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Characters of a candidate at least; the battery's level; the false discovery rate.
LEAST, ALPHA, RATE = 16, 1e-3, 0.01
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}")

#: Byte -> class: 0 outside candidates, 1 lower, 2 upper, 3 digit, 4 mark.
CLASSES = bytes(1 if chr(c) in LOWER else 2 if chr(c) in UPPER else 3 if chr(c) in DIGITS else 4 if chr(c) in "+/-_" else 0 for c in range(256))

SPAN = "struct<start:int,kind:int,end:int>"
FOUND = "struct<start:int,end:int,encoding:string,n:int,changes:int,alike:long,random:double>"
SCANNED = f"doc_id long, base array<{SPAN}>, candidates array<{FOUND}>, tally array<long>"


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in code points."""
    found = []
    low = text.lower()
    for kind, (name, pattern, least) in enumerate(PATTERNS):
        if name != "assign" or any(w in low for w in NEEDED):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[pattern.groups]) >= least]
    return sorted(found)


# --- the battery -------------------------------------------------------------


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@dataclass(frozen=True)
class Alphabet:
    """An encoding's characters and what even draws from them would be like."""

    place: dict[str, int]
    #: chance that two neighbours are of different classes, and that three neighbours are so twice
    differ: float
    twice: float

    @classmethod
    @lru_cache
    def of(cls, encoding: str) -> Alphabet:
        characters = ENCODINGS[encoding]
        sizes = np.bincount(np.frombuffer(characters.encode().translate(CLASSES), np.uint8))
        share = sizes / sizes.sum()
        return cls({c: i for i, c in enumerate(characters)}, 1 - float((share**2).sum()), float((share * (1 - share) ** 2).sum()))

    def chi_squared(self, counts: np.ndarray, n: int) -> float:
        """How often even draws are at least as uneven: a chi-squared law with the statistic's own mean and variance, by Wilson and Hilferty."""
        k = len(self.place)
        value = k / n * float((counts.astype(np.float64) ** 2).sum()) - n
        mean, variance = k - 1, 2 * (k - 1) * (n - 1) / n
        scale, freedom = variance / (2 * mean), 2 * mean**2 / variance
        z = ((max(value, 0) / scale / freedom) ** (1 / 3) - 1 + 2 / (9 * freedom)) / math.sqrt(2 / (9 * freedom))
        return math.erfc(z / math.sqrt(2)) / 2

    def runs(self, changes: int, n: int) -> float:
        """How often even draws change class so unusually often or seldom."""
        pairs = n - 1
        variance = pairs * self.differ * (1 - self.differ) + 2 * (pairs - 1) * (self.twice - self.differ**2)
        off = max(0.0, abs(changes - pairs * self.differ) - 0.5)
        return two_sided(off / math.sqrt(variance))

    def serial(self, places: np.ndarray) -> float:
        """How often even draws' neighbours go so much together, or against each other."""
        x = places - places.mean()
        spread = float((x * x).sum())
        if not spread:
            return 0.0
        n = len(x)
        return two_sided((float((x[:-1] * x[1:]).sum()) / spread + 1 / n) * math.sqrt(n))


def encoding_of(token: str) -> str | None:
    """The smallest encoding with all characters of the token; None if marks of both large ones are in it."""
    used = set(token)
    return next((name for name, characters in ENCODINGS.items() if used <= set(characters)), None)


def class_changes(token: bytes) -> int:
    classes = np.frombuffer(token.translate(CLASSES), np.uint8)
    return int((classes[1:] != classes[:-1]).sum())


def examined(start: int, token: str) -> dict | None:
    """A candidate as the battery sees it: ``random`` is the least of the three tests' values, times three; ``alike`` how many pairs of its characters are the same."""
    encoding = encoding_of(token)
    if encoding is None:
        return None
    alphabet, n = Alphabet.of(encoding), len(token)
    places = np.fromiter(map(alphabet.place.__getitem__, token), np.int64, n)
    counts, changes = np.bincount(places), class_changes(token.encode())
    least = min(alphabet.chi_squared(counts, n), alphabet.runs(changes, n), alphabet.serial(places))
    return {"start": start, "end": start + n, "encoding": encoding, "n": n, "changes": changes, "alike": int((counts * (counts - 1) // 2).sum()), "random": min(1.0, 3 * least)}


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, str]]:
    """(start, run) of runs that no span in ``taken`` touches."""
    inside = sorted((a, b) for a, _, b in taken)
    reach = [0, *np.maximum.accumulate([b for _, b in inside])] if inside else [0]
    starts = np.array([a for a, _ in inside], np.int64)
    for m in CANDIDATE.finditer(text):
        before = int(np.searchsorted(starts, m.end())) if inside else 0  # spans that begin before its end
        if reach[before] <= m.start():
            yield m.start(), m[0]


# --- natural text ------------------------------------------------------------

#: A tally: occurrences of each byte in natural words, pairs of neighbours in them, and those of different classes.
PAIRS, CHANGES = 256, 257


def natural_tally(text: bytes, runs: list[str]) -> np.ndarray:
    """What a text's words hold, without the long runs."""
    found = np.zeros(258, np.int64)

    def add(piece: bytes, sign: int) -> None:
        classes = np.frombuffer(piece.translate(CLASSES), np.uint8)
        inside = classes > 0
        both = inside[1:] & inside[:-1]
        found[:256] += sign * np.bincount(np.frombuffer(piece, np.uint8)[inside], minlength=256)
        found[PAIRS] += sign * int(both.sum())
        found[CHANGES] += sign * int((both & (classes[1:] != classes[:-1])).sum())

    add(text, 1)
    for run in runs:
        add(run.encode(), -1)
    return found


@dataclass(frozen=True)
class Natural:
    """What natural text is like: how often neighbours change class, and two or three characters are the same."""

    change: float
    two: float
    three: float

    @classmethod
    def of(cls, tally: list[int]) -> Natural:
        """By what all documents' words hold; one of each is added, so that nothing is impossible."""
        counts = np.array(tally[:256], np.float64)
        share = counts / max(1.0, counts.sum())
        change = (tally[CHANGES] + 1) / (tally[PAIRS] + 2)
        return cls(change, float((share**2).sum()) or 1.0, float((share**3).sum()) or 1.0)

    def level(self, c: Column) -> Column:
        """-log10 of how likely natural text is to look like a candidate: bounds for many changes (Chernoff) and few equal pairs (Gauss), of which the lower counts twice."""
        pairs = (c["n"] - 1).cast("double")
        share, r = c["changes"] / pairs, F.lit(min(self.change, 0.999))
        part = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(F.lit(0.0))
        changes = F.when(share > r, pairs * (part(share, r) + part(1 - share, 1 - r))).otherwise(F.lit(0.0))
        n = c["n"].cast("double")
        all_pairs = n * (n - 1) / 2
        mean, variance = all_pairs * self.two, all_pairs * self.two * (1 - self.two) + n * (n - 1) * (n - 2) * max(0.0, self.three - self.two**2)
        z = (mean - c["alike"]) / F.sqrt(F.greatest(variance, F.lit(1e-9)))
        alike = F.when(z > 0, z * z / 2).otherwise(F.lit(0.0))
        return F.greatest(F.lit(0.0), F.greatest(changes, alike) / math.log(10) - math.log10(2))


#: Width and number of the bins that levels are counted in.
BIN, BINS = 0.05, 8000


def threshold(bins: dict[int, int], rate: float = RATE) -> float:
    """The least level at which the false discovery rate is held, by Benjamini and Hochberg over binned levels; a bin counts by its lower end."""
    tested, beyond, least = sum(bins.values()), 0, math.inf
    for b in sorted(bins, reverse=True):
        beyond += bins[b]
        if tested * 10 ** (-b * BIN) <= rate * beyond:
            least = b * BIN
    return least


# --- over all documents ------------------------------------------------------


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    found_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("n", pa.int32()), ("changes", pa.int32()), ("alike", pa.int64()), ("random", pa.float64())])
    for b in batches:
        base, found, tally = [], [], np.zeros(258, np.int64)
        for value in b.column(1):
            text = value.as_py() or ""
            spans = pattern_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            found.append([x for s, run in candidates(text, spans) if (x := examined(s, run))])
            tally += natural_tally(text.encode("utf-8", "replace"), CANDIDATE.findall(text))
        # a batch's tally goes with its first row
        tallies = [tally.tolist(), *[None] * (b.num_rows - 1)][: b.num_rows]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(kinds)), pa.array(found, pa.list_(found_type)), pa.array(tallies, pa.list_(pa.int64()))], ["doc_id", "base", "candidates", "tally"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, base and added (arrays of start, kind (number in KINDS), end; code points, end exclusive).

    ``base``: what the patterns find, by start and kind.  ``added``: runs that
    the battery lets through at ``alpha`` and natural text is too unlikely to
    look like; none touches a span of ``base``.  Documents are read once, whole,
    and not shuffled; tallies and levels are counted over all of them.  Null and
    empty texts have no spans; rows that repeat an id or each other come back as
    often as they came, a null id stays null; an empty table gives an empty
    result; other columns aren't looked at.
    """
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = cut(rows.mapInArrow(_scan, SCANNED))
    # 258 sums, and BINS counts at most
    sums = scanned.where("tally is not null").select(F.posexplode("tally").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    tally = [0] * 258
    for r in sums:
        tally[r["at"]] = r["n"]
    level = Natural.of(tally).level
    place = lambda c: F.least(F.floor(level(c) / BIN), F.lit(BINS)).cast("int")
    bins = scanned.select(F.explode("candidates").alias("c")).groupBy(place(F.col("c")).alias("b")).agg(F.count("*").alias("n"))
    least = threshold({r["b"]: r["n"] for r in bins.collect()}, rate)
    kept = F.filter("candidates", lambda c: (c["random"] >= alpha) & (place(c) * BIN >= least)) if math.isfinite(least) else F.filter("candidates", lambda c: F.lit(False))
    added = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", "base", added.alias("added"))


def told(spans: Column) -> Column:
    """kind:start:end of each span, by start and kind, parted by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: secrets in all documents."""
    found = scan(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.concat("base", "added")).alias("spans"))
