"""From raw documents to packed training sequences, in five stages.

Every stage is one of the text operators; its result is written as Parquet in the shared folder and read again
as the next one's documents, so a lost executor repeats a task and never an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from gridspark.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact dedup", exact_dedup.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("best-fit packing", packing.stage),
]

#: Scores, chosen paths, alignments and packing are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of the kept documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
