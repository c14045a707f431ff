"""Binary files and snapshots: PDFs in, cached files and versioned snapshots out."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import BadDownload, OtherVersion, TooLarge
from ..functions.scalars import file_name_of
from ..shipping import ship
from .pdf import page_texts

PDF_MAGIC, PDF_MOST = b"%PDF", 100 * 1024 * 1024
SNAPSHOT_VERSION = 1


def pdf_files(spark: SparkSession, path: str, most: int = PDF_MOST) -> DataFrame:
    """(path, size, sha256, error, content) of PDFs; ``error`` says what isn't one or is too big, without its content.

    The test of the size reaches the scan, so files that are too big aren't read.
    """
    rows = spark.read.format("binaryFile").load(path)
    big = rows.where(F.col("length") > most).select("path", F.col("length").alias("size"), F.lit(None).cast("string").alias("sha256"), F.lit("too_large").alias("error"), F.lit(None).cast("binary").alias("content"))
    error = F.when(F.substring("content", 1, 4) != F.lit(PDF_MAGIC), "not_pdf")
    fine = rows.where(F.col("length") <= most).select("path", F.col("length").alias("size"), F.when(error.isNull(), F.sha2("content", 256)).alias("sha256"), error.alias("error"), F.when(error.isNull(), F.col("content")).alias("content"))
    return fine.unionByName(big)


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows: list[tuple] = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            try:
                rows += [(path, n, text, None) for n, text in enumerate(page_texts(content), 1)]
            except Exception as error:  # whatever is wrong with one file is that file's
                rows.append((path, None, None, f"{type(error).__name__}: {error}"))
        yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page, text, error) of PDFs; a file that can't be read is one row that says why."""
    ship(files.sparkSession)
    bad = files.where("error is not null").select("path", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), "error")
    return files.where("error is null").select("path", "content").mapInPandas(_texts, "path string, page int, text string, error string").unionByName(bad)


def write_files(files: DataFrame, folder: str, refresh: bool = False) -> DataFrame:
    """Keep files (name, content) in the shared folder, each name once, and say of each: name, size, sha256, reused.

    A name that is there is reused, unless ``refresh``: then the new content is
    written behind it, and the latest write counts.  Any file system that Spark
    writes to will do.
    """
    spark = files.sparkSession
    run = int(spark.sql("select unix_micros(current_timestamp())").first()[0])
    facts = files.dropDuplicates(["name"]).select("name", "content", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.lit(run).alias("run"))
    try:
        there = stored_files(spark, folder).select("name")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        there = spark.createDataFrame([], "name string")
    new = facts if refresh else facts.join(there, "name", "left_anti")
    new.write.mode("append").parquet(f"{folder}/files")
    return stored_files(spark, folder).join(files.select("name").distinct(), "name", "left_semi").select("name", "size", "sha256", (F.col("run") < run).alias("reused"))


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content, size, sha256, run): the latest write of every name."""
    rows = spark.read.parquet(f"{folder}/files")
    last = rows.groupBy("name").agg(F.max("run").alias("run"))
    return rows.join(last, ["name", "run"])


def with_file_name(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.withColumn("file_name", file_name_of(F.col(url)))


def write_atomically(target: Path, content: bytes) -> None:
    """Readers see the old file or the whole new one."""
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(content)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def store_pdf(folder: Path, name: str, content: bytes, refresh: bool = False) -> dict:
    """Put a PDF into the cache folder, or find it there: path, size, sha256, whether it was there."""
    target = folder / name
    if target.exists() and not refresh:
        content, reused = target.read_bytes(), True
    else:
        reused = False
        if len(content) > PDF_MOST:
            raise TooLarge(f"{len(content)} bytes")
        if not content.startswith(PDF_MAGIC):
            raise BadDownload("not a PDF")
        write_atomically(target, content)
    return {"path": str(target), "size": len(content), "sha256": hashlib.sha256(content).hexdigest(), "reused": reused}


def write_snapshot(rows: DataFrame, folder: str, version: int = SNAPSHOT_VERSION) -> str:
    """A new version of a table beside the old ones, and the pointer moved to it when it is whole.

    The pointer is a one-line table of its own that names the folder, written by
    Spark, so any file system that Spark writes to will do.
    """
    spark = rows.sparkSession
    run = int(spark.sql("select unix_micros(current_timestamp())").first()[0])
    rows.write.parquet(f"{folder}/data-{run}")
    meta = [(run, version, f"data-{run}", json.dumps(rows.schema.jsonValue()))]
    spark.createDataFrame(meta, "run long, version int, data string, schema string").coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return f"{folder}/data-{run}"


def read_snapshot(spark: SparkSession, folder: str, version: int = SNAPSHOT_VERSION) -> DataFrame:
    """The latest version; one that another schema version wrote is refused."""
    last = spark.read.parquet(f"{folder}/versions").orderBy(F.desc("run")).first()
    if last["version"] != version:
        raise OtherVersion(f"the snapshot has version {last['version']}, not {version}")
    return spark.read.parquet(f"{folder}/{last['data']}")


def migrate_snapshot(spark: SparkSession, folder: str, change, old: int, new: int) -> str:
    """Rewrite the latest snapshot of version ``old`` by ``change`` (DataFrame to DataFrame) as version ``new``; the old one stays until then and after."""
    return write_snapshot(change(read_snapshot(spark, folder, old)), folder, new)


def data_folder(environ: dict[str, str] | None = None) -> tuple[Path, str]:
    """(where data lives, what said so): FOLIOGRAPH_HOME, else the user's data folder."""
    environ = os.environ if environ is None else environ
    for name, below in (("FOLIOGRAPH_HOME", ""), ("XDG_DATA_HOME", "foliograph"), ("LOCALAPPDATA", "foliograph")):
        if environ.get(name):
            return Path(environ[name]).expanduser() / below, name
    return Path.home() / ".local/share/foliograph", "home"


def folder_of(what: str, environ: dict[str, str] | None = None) -> tuple[Path, str]:
    """The folder of ``pdf`` or ``index``: FOLIOGRAPH_PDF_DIR, FOLIOGRAPH_INDEX_DIR, else one in the data folder."""
    environ = os.environ if environ is None else environ
    name = f"FOLIOGRAPH_{what.upper()}_DIR"
    if environ.get(name):
        return Path(environ[name]).expanduser().absolute(), name
    base, why = data_folder(environ)
    return base / what, why
