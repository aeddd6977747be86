"""The corpus pipeline: the stages that turn documents into tokens, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import stages
from treeloom.llm.common import materialize, table

STAGES = [
    ("language ID", stages.known_language),
    ("line dedup", stages.without_repeated_lines),
    ("MinHash near-dedup", stages.one_of_each_group),
    ("benchmark decontamination", stages.without_benchmark),
    ("SentencePiece encoding and decoding", stages.tokens),
]

#: Language profiles, signatures and tokens cannot be expressed in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
