"""Articles as they are taken in: folded once, kept in segments, found through positional postings.

A store is a folder.  What is taken in at once is a segment and is never written
again; a ledger of versions says which segments are live, so a reader keeps the
version that it began with and writers only ever add.

| table | rows |
| --- | --- |
| ``articles`` | what came, the folded texts, their length; known by (seg, part, row) |
| ``parts`` | a row for each part: how many of its articles have text, their lengths |
| ``postings`` | (gram, row): the spots where a text has the trigram |
| ``grams`` | (gram, part): how many texts of the part have it, how often one has it at most |
| ``dead`` | articles that were deleted or replaced since, by (seg, part, row) |

A part is what one task has written, neighbours by bulletin.  Its postings lie
beside it, sorted by gram, so writing an index moves nothing but a part's own
rows, and a look-up reads the row groups of its grams in the parts that have all
of them, which ``grams`` tells beforehand.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import fold
from ..shipping import ship
from .ledger import Ledger, names, remove

#: Characters of a gram, and bits that a character takes in a gram's key.
GRAM, CODE = 3, 21
#: Bytes of texts that make a part, and that a part has at least before texts are dealt over idle tasks.
PART_BYTES, LEAST_PART = 128 << 20, 1 << 20
#: Characters of texts whose spots are worked out at once, unless one text has more: each takes some 100 bytes meanwhile.
SPOT_CHARS = 1 << 18
#: Bytes of a row group: what one task reads at least, so that a table that one task wrote is read by many.
ROW_GROUP = 8 << 20
#: Segments of one size (within a factor of as many) that are merged into one.
TIER = 8
#: What a row is known by.
KEY = ["seg", "part", "row"]


def gram_key(gram: str) -> int:
    """A trigram as one number, by its characters' code points."""
    return ord(gram[0]) << 2 * CODE | ord(gram[1]) << CODE | ord(gram[2])


def gram_text(key: Column) -> Column:
    """The trigram of a key."""
    codes = (F.lpad(F.hex(F.shiftright(key, shift).bitwiseAND((1 << CODE) - 1)), 8, "0") for shift in (2 * CODE, CODE, 0))
    return F.decode(F.unhex(F.concat(*codes)), "UTF-32")


def grams_table(articles: DataFrame, id_col: str = "id") -> DataFrame:
    """(gram, id): every distinct trigram of every folded text.  Characters are split once, as substrings would each be counted from the start."""
    rows = articles.where(F.length("norm") >= GRAM).select(F.col(id_col).alias("id"), F.split("norm", "").alias("cs"), F.length("norm").alias("n"))
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - GRAM), lambda i: F.concat(F.get("cs", i), F.get("cs", i + 1), F.get("cs", i + 2)))
    return rows.select("id", F.explode(F.array_distinct(grams)).alias("gram")).select("gram", "id")


def text_length():
    """The length that relevance counts: a text's trigrams."""
    return F.greatest(F.length("norm") - (GRAM - 1), F.lit(0))


def text_counts(articles: DataFrame) -> DataFrame:
    """One row: n (texts that aren't empty), mean (their mean length)."""
    return articles.where("norm <> ''").agg(F.count("*").cast("double").alias("n"), F.avg(text_length()).alias("mean"))


# --- postings ----------------------------------------------------------------

POSTINGS = "part int, gram long, row long, length int, spots array<int>"
GRAMS = "gram long, part int, texts long, most int, seg int"
PARTS = "part int, n long, total long, least long, seg int"
DEAD = "seg int, part int, row long, chars int"


class _Lettered(dict):
    """Code point -> is it a letter or a digit, in front of which no word starts?"""

    def __missing__(self, code: int) -> bool:
        self[code] = known = unicodedata.category(chr(code))[0] in "LN"
        return known


_LETTERED = _Lettered()


def _slices(batches: Iterator[pa.RecordBatch], most: int = SPOT_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one (its last column) have ``most`` characters together, or it has one row."""
    for b in batches:
        ends = np.cumsum(pc.utf8_length(b.column(b.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False))
        first = 0
        while first < b.num_rows:
            before = ends[first - 1] if first else 0
            after = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(first, after - first)
            first = after


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, row, norm) to postings.  A spot is twice a gram's place in its text, one more if a word starts there."""
    for b in _slices(batches):
        texts = [t or "" for t in b.column(2).to_pylist()]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(codes)) - starts[doc]
        whole = np.flatnonzero(place + GRAM <= lengths[doc])
        used, which = np.unique(codes, return_inverse=True)
        lettered = np.array([_LETTERED[c] for c in used.tolist()], bool)[which] if len(used) else np.zeros(0, bool)
        behind = np.concatenate([[False], lettered[:-1]]) & (place > 0)
        grams = codes[whole] << 2 * CODE | codes[whole + 1] << CODE | codes[whole + 2] if len(whole) else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")  # texts and places stay in order
        grams, at = grams[order], whole[order]
        of, spots = doc[at], (place[at] << 1 | ~behind[at]).astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])])) if len(grams) else np.zeros(0, np.int64)
        owners = of[first]
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(grams)), pa.int32()), pa.array(spots))
        columns = [b.column(0).take(pa.array(owners)), pa.array(grams[first]), b.column(1).take(pa.array(owners)), pa.array((lengths[owners] - (GRAM - 1)).astype(np.int32)), lists]
        yield pa.RecordBatch.from_arrays(columns, ["part", "gram", "row", "length", "spots"])


def cover(phrase: str) -> list[tuple[int, int]]:
    """(offset, gram) of as few trigrams as cover a folded phrase."""
    offsets = [*range(0, len(phrase) - GRAM, GRAM), len(phrase) - GRAM]
    return [(k, gram_key(phrase[k : k + GRAM])) for k in offsets]


def occurrences(lists: Sequence[Column], phrase: str) -> Column:
    """Places of a phrase in a text from its grams' spots: what is left when each list is moved back by its offset."""

    def moved(spots: Column, offset: int) -> Column:
        return F.transform(spots, lambda s: F.shiftright(s, 1) - offset)

    return reduce(F.array_intersect, (moved(spots, k) for spots, (k, _) in zip(lists, cover(phrase), strict=True)))


# --- the store ---------------------------------------------------------------


@dataclass(frozen=True)
class Segment:
    """What a version says of a segment: are there postings, how many of its articles have text, and the sum of their lengths."""

    indexed: bool
    n: int
    total: int


@dataclass(frozen=True)
class Version:
    """What is live: segments by number; of each folder of the dead the segments that they were in, with their (n, total); the number of the version, and the columns of articles."""

    number: int
    segments: dict[int, Segment]
    dead: dict[int, dict[int, tuple[int, int]]]
    schema: StructType | None

    @property
    def counts(self) -> tuple[int, float | None]:
        """How many texts aren't empty, and their mean length (None without any)."""
        gone = [c for of in self.dead.values() for seg, c in of.items() if seg in self.segments]
        n = sum(s.n for s in self.segments.values()) - sum(c[0] for c in gone)
        return n, (sum(s.total for s in self.segments.values()) - sum(c[1] for c in gone)) / n if n else None


@dataclass(frozen=True)
class Store:
    """The tables of a folder.

    ``at``: a version to stay with, which later writing doesn't change; without
    it every look is at the latest one.
    """

    spark: SparkSession
    folder: str
    at: Version | None = None

    # --- versions ---

    @property
    def _versions(self) -> Ledger:
        return Ledger(self.spark, f"{self.folder}/versions")

    @staticmethod
    def _version(number: int, note: dict | None) -> Version:
        note = note or {"segments": {}, "dead": {}, "schema": None}
        dead = {int(k): {int(seg): tuple(c) for seg, c in of.items()} for k, of in note["dead"].items()}
        return Version(number, {int(k): Segment(**v) for k, v in note["segments"].items()}, dead, note["schema"] and StructType.fromJson(note["schema"]))

    def version(self) -> Version:
        return self.at or self._version(*self._versions.last())

    def pinned(self) -> Store:
        """The store as it is now."""
        return Store(self.spark, self.folder, self.version())

    def _commit(self, step, schema: StructType | None = None) -> Store:
        """A new version: ``step`` is given the last one's segments and dead and changes them."""

        def next_note(note):
            now = self._version(0, note)
            segments, dead = step(dict(now.segments), dict(now.dead))
            kept = schema or now.schema
            return {"segments": {k: asdict(v) for k, v in sorted(segments.items())}, "dead": dead, "schema": kept and json.loads(kept.json())}

        self._versions.change(next_note)
        return self

    def _claim(self) -> int:
        """A number for a segment or a folder of the dead, which nobody else gets."""
        return Ledger(self.spark, f"{self.folder}/claims").change(lambda n: (n or 0) + 1)[0]

    # --- tables ---

    def _read(self, name: str, numbers: Sequence[int], schema: StructType | str) -> DataFrame:
        """Rows of some segments; ``schema`` is that of the files, with the columns that folders stand for."""
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*(f"{self.folder}/{name}/seg={n}" for n in sorted(numbers)))

    def _texts(self, numbers: Sequence[int], version: Version) -> DataFrame:
        if version.schema is None:
            raise FileNotFoundError(f"nothing was taken into {self.folder} yet")
        return self._read("articles", numbers, version.schema)

    def _living(self, rows: DataFrame, version: Version) -> DataFrame:
        """Rows of the live segments without the dead."""
        if not version.dead:
            return rows
        gone = self._dead(version).select(*KEY)
        return rows.join(gone, KEY, "left_anti")

    def _dead(self, version: Version) -> DataFrame:
        paths = [f"{self.folder}/dead/op={n}" for n in version.dead]
        rows = self.spark.read.schema(DEAD).parquet(*paths) if paths else self.spark.createDataFrame([], DEAD)
        return rows.where(F.col("seg").isin(list(version.segments)))

    @property
    def articles(self) -> DataFrame:
        version = self.version()
        return self._living(self._texts(list(version.segments), version), version)

    @property
    def postings(self) -> DataFrame:
        """(seg, part, gram, row, length, spots) of the live segments that are indexed, the dead left out."""
        version = self.version()
        return self._living(self._read("postings", [n for n, s in version.segments.items() if s.indexed], f"{POSTINGS}, seg int"), version)

    @property
    def grams(self) -> DataFrame:
        """(seg, part, gram, texts, most): bounds, as the dead are counted until they are merged away."""
        version = self.version()
        return self._read("grams", [n for n, s in version.segments.items() if s.indexed], GRAMS)

    @property
    def indexed(self) -> bool:
        """Has every live segment postings?"""
        return all(s.indexed for s in self.version().segments.values())

    @property
    def statistics(self) -> DataFrame:
        """One row: n (texts that aren't empty), mean (their mean length), as the version states them."""
        n, mean = self.version().counts
        return self.spark.createDataFrame([(float(n), mean)], "n double, mean double")

    # --- writing ---

    def _parts_of(self, rows: DataFrame, text: str) -> DataFrame:
        """Rows dealt into parts by ranges of bulletins: a part for PART_BYTES, or as many as there are tasks if that leaves LEAST_PART each."""
        size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
        tasks = min(self.spark.sparkContext.defaultParallelism, size // LEAST_PART)
        by = [c for c in ("bulletin", "id") if c in rows.columns]
        return rows.repartitionByRange(max(1, math.ceil(size / PART_BYTES), tasks), *by)

    def _write(self, rows: DataFrame, seg: int) -> tuple[Segment, StructType]:
        """A segment of folded articles, and its parts' numbers; the schema that it is read by."""
        keyed = rows.select("*", F.length("norm").alias("chars"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"))
        keyed.write.partitionBy("part").option("parquet.block.size", ROW_GROUP).parquet(f"{self.folder}/articles/seg={seg}")
        schema = StructType([StructField(f.name, f.dataType) for f in keyed.schema if f.name != "part"]).add("seg", IntegerType()).add("part", IntegerType())
        length, filled = F.greatest(F.col("chars") - (GRAM - 1), F.lit(0)).cast("long"), F.col("chars") > 0
        counted = self._read("articles", [seg], schema).groupBy("part").agg(F.count_if(filled).alias("n"), F.coalesce(F.sum(F.when(filled, length)), F.lit(0)).alias("total"), F.min(F.when(filled, length)).alias("least"))
        counted.coalesce(1).write.parquet(f"{self.folder}/parts/seg={seg}")
        sums = self._read("parts", [seg], PARTS).agg(F.sum("n"), F.sum("total")).first()
        return Segment(False, sums[0] or 0, sums[1] or 0), schema

    def _bury(self, ids: DataFrame, segments: Sequence[int]) -> dict[int, dict[int, tuple[int, int]]]:
        """Write down the live rows of ``ids`` in ``segments`` as dead: number of the folder -> segment -> (n, total), empty if there are none."""
        if not segments:
            return {}
        version = self.version()
        number = self._claim()
        rows = self._living(self._texts(segments, version), version).join(ids.select("id").distinct(), "id", "left_semi")
        rows.select(*KEY, "chars").write.parquet(f"{self.folder}/dead/op={number}")
        length = F.greatest(F.col("chars") - (GRAM - 1), F.lit(0)).cast("long")
        written = self.spark.read.schema(DEAD).parquet(f"{self.folder}/dead/op={number}")
        # a row a segment
        counts = written.groupBy("seg").agg(F.count_if(F.col("chars") > 0).alias("n"), F.sum(length).alias("total")).collect()
        return {number: {r["seg"]: (r["n"], r["total"]) for r in counts}} if counts else {}

    def take_in(self, raw: DataFrame) -> Store:
        """Fold articles (id, bulletin, number, summary, department, section) and add them as a segment; articles of the same ids that were there before are replaced.

        Bytes that aren't valid UTF-8 become replacement characters, so that all
        that is stored and told can be written.  A first batch without rows makes
        an empty store.
        """
        ship(self.spark)
        seg = self._claim()
        raw = raw.withColumns({f.name: F.make_valid_utf8(f.name) for f in raw.schema if f.dataType.typeName() == "string"})
        dealt = self._parts_of(raw, "summary")
        own, schema = self._write(dealt.select("*", fold(F.col("summary")).alias("norm"), fold(F.col("section")).alias("section_norm")), seg)
        buried = self._bury(self._read("articles", [seg], schema), list(self.version().segments))
        return self._commit(lambda segments, dead: (segments | {seg: own}, dead | buried), schema)

    def delete(self, ids: DataFrame) -> Store:
        """Take the articles of ``ids`` (a column id) away."""
        buried = self._bury(ids, list(self.version().segments))
        return self._commit(lambda segments, dead: (segments, dead | buried)) if buried else self

    def _index(self, seg: int) -> None:
        ship(self.spark)
        texts = self._texts([seg], self.version()).where(F.col("chars") >= GRAM).select("part", "row", "norm")
        spots = texts.mapInArrow(_spots, POSTINGS)
        # a task's own rows are sorted, none is sent anywhere
        spots.sortWithinPartitions("part", "gram", "row").write.partitionBy("part").option("parquet.block.size", ROW_GROUP).parquet(f"{self.folder}/postings/seg={seg}")
        counted = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings/seg={seg}").groupBy("gram", "part").agg(F.count("*").alias("texts"), F.max(F.size("spots")).alias("most"))
        counted.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.folder}/grams/seg={seg}")

    def index(self) -> Store:
        """Write the postings of the live segments that have none."""
        new = [n for n, s in self.version().segments.items() if not s.indexed]
        for seg in new:
            self._index(seg)
        return self._commit(lambda segments, dead: ({k: replace(v, indexed=v.indexed or k in new) for k, v in segments.items()}, dead)) if new else self

    # --- upkeep ---

    def due(self) -> list[int]:
        """Segments that should become one: TIER of them that are of about one size."""
        tiers: dict[int, list[int]] = {}
        for seg, own in self.version().segments.items():
            tiers.setdefault(int(math.log(max(own.total, 1), TIER)), []).append(seg)
        return next((sorted(own) for _, own in sorted(tiers.items()) if len(own) >= TIER), [])

    def merge(self, segments: Sequence[int] | None = None) -> Store:
        """Make one segment of several (``due`` ones, if none are named), without the dead; nothing is folded again.

        A deletion that comes while this works would be lost with the old
        segments, so the merge is then given up, with an error; it can be
        repeated.
        """
        before = self.version()
        old = sorted(self.due() if segments is None else segments)
        if not old:
            return self
        seg = self._claim()
        rows = self._living(self._texts(old, before), before).drop(*KEY, "chars")
        own, _ = self._write(self._parts_of(rows, "norm"), seg)
        own = replace(own, indexed=all(before.segments[n].indexed for n in old))
        if own.indexed:
            self._index(seg)

        def swap(segments, dead):
            if dead != before.dead or not set(old) <= set(segments):
                raise RuntimeError("articles were deleted while segments were merged; merge again")
            return {k: v for k, v in segments.items() if k not in old} | {seg: own}, dead

        return self._commit(swap)

    def vacuum(self) -> Store:
        """Delete what the latest version doesn't need; readers of older versions and writers must be done."""
        self._commit(lambda segments, dead: (segments, {n: of for n, of in dead.items() if set(of) & set(segments)}))
        version = self.version()
        for name in ("articles", "parts", "postings", "grams"):
            for folder in names(self.spark, f"{self.folder}/{name}"):
                if int(folder.partition("=")[2]) not in version.segments:
                    remove(self.spark, f"{self.folder}/{name}/{folder}")
        for folder in names(self.spark, f"{self.folder}/dead"):
            if int(folder.partition("=")[2]) not in version.dead:
                remove(self.spark, f"{self.folder}/dead/{folder}")
        self._versions.forget()
        return self
