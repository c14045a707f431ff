"""Recorded HTTP responses as a table.

There is no live HTTP: pacing, budgets and cooldowns are decided by
``operators.guard`` from the rows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.scalars import retry_after_seconds, status_class
from ..shipping import ship

SCHEMA = "url string, status int, retry_after string, fetched_at timestamp, location string, body string"


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses recorded as JSON lines, through Spark's reader, so from any store: SCHEMA, what class the status is, and the seconds to wait."""
    rows = spark.read.schema(SCHEMA).json(path)
    return rows.withColumn("kind", status_class(F.col("status"))).withColumn("retry_after_seconds", retry_after_seconds(F.col("retry_after"), F.col("fetched_at")))


def record(rows: DataFrame, path: str) -> None:
    """Append responses to a recording."""
    rows.select(*(part.split()[0] for part in SCHEMA.split(", "))).write.mode("append").json(path)


def latest(rows: DataFrame) -> DataFrame:
    """The last response of every address."""
    return rows.groupBy("url").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "url")), "fetched_at").alias("r")).select("url", "r.*")


def outcomes(rows: DataFrame) -> DataFrame:
    """Responses as the guard's log: site, ts, seq, status, retry_after."""
    site = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return rows.select(site.alias("site"), F.col("fetched_at").alias("ts"), F.xxhash64("url", "fetched_at").alias("seq"), "status", F.col("retry_after_seconds").alias("retry_after"))


def redirects(rows: DataFrame) -> DataFrame:
    """(cve, target): where the site's resolver sent each identifier it was asked for."""
    asked = F.upper(F.regexp_extract("url", r"[?&]cve=([^&#]+)", 1))
    return latest(rows).where((asked != "") & F.col("status").between(300, 399)).select(asked.alias("cve"), F.col("location").alias("target"))


# --- as a format, for streams that say themselves how far they are -------------

#: Where a recording's notes are; Spark's readers pass over folders with such names.
NOTES = "_notes"
FIELDS = tuple(part.split()[0] for part in SCHEMA.split(", "))


@dataclass
class RecordedFile(InputPartition):
    name: str


class Recording:
    """A folder of JSON lines, as files that appear whole and don't change; names with a leading dot or underscore don't count."""

    def __init__(self, path: str):
        self.path = path

    def _place(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path)

    def _names(self, folder: str = "") -> list[str]:
        files, at = self._place()
        found = files.get_file_info(FileSelector(f"{at}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == FileType.File and f.base_name[0] not in "._")

    def read(self, partition: RecordedFile | None) -> Iterator[tuple]:
        """A file's rows, line by line; a line that is no JSON object gives a row of nulls, as from Spark's reader.  Where there are no files Spark asks with None."""
        if partition is None:
            return
        files, at = self._place()
        with files.open_input_stream(f"{at}/{partition.name}") as source:
            for line in io.TextIOWrapper(source, encoding="utf-8", errors="replace", newline="\n"):
                if line.strip():
                    yield _row(line)


def _row(line: str) -> tuple:
    try:
        found = json.loads(line)
    except ValueError:
        found = None
    if not isinstance(found, dict):
        return (None,) * len(FIELDS)
    at = found.get("fetched_at")
    return tuple((datetime.fromisoformat(at) if at else None) if field == "fetched_at" else found.get(field) for field in FIELDS)


class RecordedRows(Recording, DataSourceReader):
    """The whole recording, a task a file."""

    def partitions(self) -> list[InputPartition]:
        return [RecordedFile(name) for name in self._names()]


class RecordedArrivals(Recording, DataSourceStreamReader):
    """The recording as a stream: an offset is the number of the last note, and a note names the files that were new when it was written.

    Notes are written before Spark is told their number, whole, and never again,
    so a query that begins again at its checkpoint reads the same files for the
    same offsets, and none twice, whatever their names and times.  What one note
    names is what arrived since the last one.  One query reads with one folder
    of notes; others name their own (option ``notes``).
    """

    def __init__(self, path: str, notes: str):
        super().__init__(path)
        self.notes, self._seen, self._last = notes, None, 0

    def initialOffset(self) -> dict:
        return {"note": 0}

    def _note(self, number: int) -> list[str]:
        files, at = self._place()
        with files.open_input_stream(f"{at}/{self.notes}/{number:012d}") as source:
            return json.loads(source.read())

    def latestOffset(self) -> dict:
        if self._seen is None:
            written = [int(n) for n in self._names(self.notes)]
            self._seen = {name for number in written for name in self._note(number)}
            self._last = max(written, default=0)
        if new := [name for name in self._names() if name not in self._seen]:
            files, at = self._place()
            files.create_dir(f"{at}/{self.notes}")
            aside = f"{at}/{self.notes}/.next"
            with files.open_output_stream(aside) as out:
                out.write(json.dumps(new).encode())
            files.move(aside, f"{at}/{self.notes}/{self._last + 1:012d}")
            self._seen.update(new)
            self._last += 1
        return {"note": self._last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [RecordedFile(name) for number in range(start["note"] + 1, end["note"] + 1) for name in self._note(number)]


class Recordings(DataSource):
    """``spark.read.format("recordings").load(path)``, and the same with ``readStream``: SCHEMA, from a folder that ``record`` writes to."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordedRows(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RecordedArrivals(self.options["path"], self.options.get("notes", NOTES))


def register_format(spark: SparkSession) -> None:
    """Make the format ``recordings`` known to a session and its workers."""
    ship(spark)
    spark.dataSource.register(Recordings)
