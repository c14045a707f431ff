"""A corpus pipeline of four of the operators: filter, deduplicate, mix, pack.

Each stage takes what its predecessor kept, as written and reread; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm._shared import ensure_checkpoint_dir
from foliograph.llm.quality_classifier import quality_stage
from foliograph.llm.sequence_packing import packing_stage
from foliograph.llm.simhash_dedup import near_duplicate_stage
from foliograph.llm.source_mixing import mixing_stage

#: In order: documents of low quality go; of near copies one stays; sources are mixed to target weights; the mix is packed.
STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training, tokenizing and packing can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
