"""What the operators share: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shipping import shared_folder, ship

#: These characters separate words; it is what ``bytes.split()`` splits on.
GAPS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data directory, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Ship the package to the workers, and bound Arrow batches by bytes (``shipping.bound_batches``)."""
    ship(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder, which checkpoints go to."""
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a table that may be broadcast, in memory, about.
BROADCAST_BYTES = 64 << 20


def fit_for_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a materialised table, with a broadcast hint if its size, which is measured, is at most ``most`` bytes; else as it is."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    row = sum(wide, F.lit(16 + 8 * len(df.columns)).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null, without a Python worker.

    Each word becomes one letter, together with the gap before it, and letters
    are counted: no list of words is made, which of a long text takes many times
    its size.
    """
    letters = F.regexp_replace(F.rtrim(text, F.lit(GAPS)), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


_held: dict[str, object] = {}


def worker_memory(name: str, make: Callable[[], object]):
    """What ``make`` gives, kept in a Python worker for its further tasks; only the last name asked for is kept."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


class WordMemo(dict):
    """Word -> ``make(word)``, remembered for a bounded number of short words.

    Two generations of at most ``words / 2`` each: a full one becomes the old
    one and the one before it goes; words that are met again move up.
    """

    def __init__(self, make: Callable[[bytes], object], words: int, longest: int = 64):
        self.make, self.half, self.longest, self.old = make, words // 2, longest, {}

    def __missing__(self, word: bytes):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > self.longest:
                return value
        self.keep(word, value)
        return value

    def keep(self, word: bytes, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[word] = value
