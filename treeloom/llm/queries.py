"""The named query of each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, extraction, fingerprints, language, linededup, mixing, neardup, oracles, periodic, pieces, prefixtrie, secrets, sharding, toxicity
from .common import table

#: Bytes of a shard's texts.
SHARD_BYTES = 1 << 20


def tokenizer() -> bytes:
    """The SentencePiece model file, read on the driver; TREELOOM_TOKENIZER names another."""
    return Path(os.environ.get("TREELOOM_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")).read_bytes()


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language.fold_is(F.col("doc_id"), 4, 2)
    scored = toxicity.score(docs, toxicity.fit(docs.filter(~held_out), labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_toxic", "spans")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.fold_is(F.col("doc_id"), 3, 1)
    scored = language.predict(docs, language.fit(docs.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(periodic.repeated_tail(table(spark, sf_dir, "documents")))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_document_fingerprints, op3_minhash_near_dedup, op4_toxicity, op5_language_id, op6_html_extraction, op7_sharding, op8_decontamination, op9_line_dedup, op10_sentencepiece,
        op11_prefix_trie, op12_periodic_runs, op13_source_mixing,
    )
}

ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op7_sharding": oracles.SHARDING.format(limit=SHARD_BYTES),
    "op8_decontamination": oracles.DECONTAMINATION,
    "op11_prefix_trie": oracles.PREFIX_TRIE,
    "op12_periodic_runs": oracles.PERIODIC_RUNS,
    "op13_source_mixing": oracles.MIXING.format(block=mixing.BLOCK, repeats=mixing.REPEATS, weights=list(mixing.WEIGHTS), golden=mixing.GOLDEN, range=mixing.RANGE),
    "op9_line_dedup": oracles.LINE_DEDUP.format(chars=linededup.MIN_CHARS, edits=linededup.EDITS),
}
