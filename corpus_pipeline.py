"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet in the shared folder and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import common, exact_dedup, jaccard_join, language_id, mixing, packing

STAGES = [
    ("language_id", language_id.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_jaccard", jaccard_join.pipeline_stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can express neither rank-order profiles nor raking; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
