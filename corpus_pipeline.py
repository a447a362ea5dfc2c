"""The corpus pipeline: toxicity, quality rules, near-duplicate removal, substring removal and packing, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import packing, quality, simhash, substring_dedup, toxicity
from siltstone.llm.common import cut, remove, shared_dir, table

#: (name, function) in order; each function takes (spark, docs, sf_dir).
STAGES = [
    ("toxicity", toxicity.stage),
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("substring_dedup", substring_dedup.stage),
    ("packing", packing.stage),
]

#: SQL expresses neither the trained classifier nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage returns is written to the shared folder and read by the next.

    A stage's rows go when the next one's are written; the result is kept as a checkpoint, and the folder is removed.
    """
    import uuid

    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
            if before:
                remove(spark, before)
            before = f"{at}/{name}"
            docs = spark.read.parquet(before)
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(spark, at)
