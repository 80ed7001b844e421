"""From raw documents to packed training sequences.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. Stages before the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.common import dropped, scope, table, written
from rankloom.llm.minhash import stage_near_duplicates
from rankloom.llm.packing import stage_packing
from rankloom.llm.quality_classifier import stage_quality
from rankloom.llm.quality_rules import stage_rules
from rankloom.llm.suffix_dedup import stage_passages

STAGES = [
    ("quality_classifier", stage_quality),
    ("quality_rules", stage_rules),
    ("near_duplicates", stage_near_duplicates),
    ("repeated_passages", stage_passages),
    ("packing", stage_packing),
]

#: Compression, signatures and suffix arrays have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scope() as keep:  # what a stage wrote on its way is deleted
            after = keep(written(stage(spark, docs, sf_dir), name))
        dropped(docs)
        docs = after
    return docs
