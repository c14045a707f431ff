"""The state of bulletins as a table that grows batch by batch, without the log that made it.

A version is a set of buckets; a batch of attempts rewrites only the buckets
that it touches, from their state and its own attempts, so no key's history is
ever gathered again.  A ledger says which folder each bucket is in and which
batch came last, so a batch that comes again changes nothing, and readers keep
the version that they began with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import STATE, fold_onto
from .ledger import Ledger, names, remove


@dataclass(frozen=True)
class StateTable:
    """States by ``key`` in a folder; ``kind`` is the key's type, ``buckets`` how many a new table has."""

    spark: SparkSession
    folder: str
    key: str = "bulletin"
    kind: str = "bigint"
    buckets: int = 64

    @property
    def _ledger(self) -> Ledger:
        return Ledger(self.spark, f"{self.folder}/versions")

    def _note(self) -> dict:
        return self._ledger.last()[1] or {"batch": -1, "buckets": self.buckets, "at": {}}

    def _read(self, note: dict, some: set[int] | None = None) -> DataFrame:
        """States of some buckets, or all."""
        schema = f"{self.key} {self.kind}, {STATE[len('struct<') : -1].replace(':', ' ')}"
        at = [f"{self.folder}/states/v={v}/bucket={b}" for b, v in sorted(note["at"].items()) if some is None or int(b) in some]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    @property
    def states(self) -> DataFrame:
        """What ``ingest.current_state`` gives for all attempts that were taken in."""
        return self._read(self._note())

    def take_in(self, attempts: DataFrame, batch: int) -> StateTable:
        """Fold a batch of attempts, all later than those of the batches before it; meant for ``foreachBatch``."""
        note = self._note()
        if batch <= note["batch"]:
            return self
        bucket = F.pmod(F.xxhash64(self.key), F.lit(note["buckets"])).cast("int")
        touched = {r[0] for r in attempts.select(bucket.alias("b")).distinct().collect()}  # as many as there are buckets
        version = Ledger(self.spark, f"{self.folder}/claims").change(lambda n: (n or 0) + 1)[0]
        if touched:
            folded = fold_onto(self._read(note, touched), attempts, self.key).withColumn("bucket", bucket)
            folded.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/states/v={version}")
        new = note | {"batch": batch, "at": note["at"] | {str(b): version for b in sorted(touched)}}
        # of two that fold the same batch one is enough
        self._ledger.change(lambda last: new if (last or {"batch": -1})["batch"] == note["batch"] else None)
        return self

    def vacuum(self) -> StateTable:
        """Delete the folders that no bucket of the latest version is in; readers of older versions must be done."""
        used = {str(v) for v in self._note()["at"].values()}
        for folder in names(self.spark, f"{self.folder}/states"):
            if folder.startswith("v=") and folder[2:] not in used:
                remove(self.spark, f"{self.folder}/states/{folder}")
        self._ledger.forget()
        return self
