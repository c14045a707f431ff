"""Bring this package to Python workers that can't import it from their own path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch, about, and its rows at most.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 10_000


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that many short texts or few long ones go to Python at once.

    Both settings are upper bounds of memory for the session; a caller's smaller ones stay.
    """
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Send the package's source to the application's workers, once; Spark serves it to executors that come later too.  The session's Arrow batches are bounded."""
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="foliograph-src-"), "foliograph_src.zip")
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: ``spark.checkpoint.dir``; only on one machine, where that is unset (tests), a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _folders.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="foliograph-"))
