"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagescale.llm import stages
from pagescale.session import cut_lineage, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_recurring_lines),
    ("minhash_near_dedup", stages.keep_one_of_each_group),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("mixing", stages.mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs, f"pipeline-{name}")
    return docs
