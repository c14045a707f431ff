"""Numbered notes in a folder that all processes see: each number is written once, whole, or not at all.

A note appears under its number in one step, and of two writers of one number
only one succeeds, so the numbers are an order that everyone agrees on.  Notes
are small (what is live, who holds a lease); tables are Spark's to write.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    """The path of a file of this machine (or a folder mounted on it); None if another file system has it."""
    parts = urlsplit(path)
    return parts.path if parts.scheme in ("", "file") else None


def _hadoop(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, own = _hadoop(spark, path)
    files.delete(own, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    files, own = _hadoop(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(own)] if files.exists(own) else []


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that isn't there yet; False if it is.

    It is written beside its place and then linked (or, where another file
    system has it, renamed) to it, which fails if somebody was faster.
    """
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    if (own := _local(path)) is not None:
        here = _local(aside)
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with open(here, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(here, own)
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
        return True
    files, target = _hadoop(spark, path)
    source = spark._jvm.org.apache.hadoop.fs.Path(aside)
    out = files.create(source, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.exists(target) and files.rename(source, target):
        return True
    files.delete(source, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    if (own := _local(path)) is not None:
        with open(own, encoding="utf-8") as source:
            return source.read()
    files, target = _hadoop(spark, path)
    source = files.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


@dataclass(frozen=True)
class Ledger:
    """Notes 1, 2, 3, ... in a folder."""

    spark: SparkSession
    folder: str

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in names(self.spark, self.folder) if n.isdigit())

    def _floor(self) -> int:
        """The number below which notes have been forgotten."""
        return max((int(n.partition("-")[2]) for n in names(self.spark, self.folder) if n.startswith("floor-")), default=0)

    def write(self, number: int, note: Any) -> bool:
        """False if there is such a note already."""
        return create_once(self.spark, f"{self.folder}/{number:012d}", json.dumps(note))

    def read(self, number: int) -> Any:
        return json.loads(read_text(self.spark, f"{self.folder}/{number:012d}"))

    def last(self) -> tuple[int, Any]:
        """The greatest number and its note; 0 and None if there is none."""
        while numbers := self.numbers():
            try:
                return numbers[-1], self.read(numbers[-1])
            except FileNotFoundError:  # forgotten meanwhile
                continue
        return 0, None

    def change(self, step: Callable[[Any], Any]) -> tuple[int, Any]:
        """Write what ``step`` makes of the last note as the next one, anew as often as somebody else was faster; a step that gives None leaves things as they are."""
        while True:
            number, note = self.last()
            new = step(note)
            if new is None:
                return number, note
            if self.write(number + 1, new):
                if self._floor() <= number + 1:
                    return number + 1, new
                # the number was free because its note has been forgotten: this came too late
                remove(self.spark, f"{self.folder}/{number + 1:012d}")

    def forget(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` notes; who would still write one of the deleted numbers is told by the floor."""
        gone = self.numbers()[:-keep]
        if gone:
            create_once(self.spark, f"{self.folder}/floor-{gone[-1] + 1:012d}", "")
            for number in gone:
                remove(self.spark, f"{self.folder}/{number:012d}")
