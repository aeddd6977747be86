"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what goes on.

Each judges rows, whatever their doc_id: by the file and number of a row, or by a written number. An empty table gives
an empty one. Null and empty texts have no letter, no shingle, no word and no piece, and go with the first stage.
Texts of any length are judged whole. Of repeated rows, which tie, all stay or go in language ID and decontamination;
line dedup leaves lines to the first of them and near-dedup leaves the first. Other columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language, linededup, neardup, pieces
from .common import ROW, order_of, sealed, table, unsealed
from .queries import tokenizer


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found (no text, or no letter). Where none is labelled, letters decide."""
    model = language.fit(docs.filter(~language.fold_is(F.col("doc_id"), 3, 1)))
    if not model[0]:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the columns are called
    found = language.predict(plain, model, plain.columns, f"c{docs.columns.index('text')}")
    return found.filter("lang_pred <> 'und'").select(plain.columns).toDF(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that stand, alike but for two edits, earlier in the corpus; texts that lose every line go."""
    return linededup.without_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: that of the smallest doc_id; one without doc_id if all are."""
    keyed = sealed(docs)
    found = neardup.near_duplicates(keyed.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    # the operator keeps the smallest key of a group, which need not be the key of the smallest doc_id
    grouped = found.join(keyed.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(F.struct(*order_of(ROW))).alias("first"))
    kept = grouped.select(F.col(f"first.{ROW}").alias(ROW))
    return unsealed(keyed.join(kept, ROW, "left_semi").select(keyed.columns), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a window of a benchmark item."""
    keyed = sealed(docs)
    found = decontamination.contamination(keyed.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaked = found.filter("contaminated").select(F.col("doc_id").alias(ROW))
    return unsealed(keyed.join(leaked, ROW, "left_anti").select(keyed.columns), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document, its text restored from them to be compared with the given one."""
    return pieces.encode(docs, tokenizer())
