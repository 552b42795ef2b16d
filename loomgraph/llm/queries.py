"""Queries of this package by name; each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import avi, bpe, compact_windows, fill_in_middle, hard_negatives, language_id, line_dedup, mixing, repetition, resharding, rule_ensemble, simhash, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), _pieces())


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage of a document that others have too; of equal texts the least document has them, the others a row of kind copy."""
    return compact_windows.of_each_document(compact_windows.repeated_passages(_table(spark, sf_dir, "documents")))


def op3_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.round_trip(_table(spark, sf_dir, "documents"))


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.fit(docs, _table(spark, sf_dir, "labels")))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _vocabulary())


def encode_documents(docs: DataFrame) -> DataFrame:
    """Encoding by the public multilingual ranks, as the pipeline and its query use it."""
    return bpe.encode(docs, _vocabulary(), _pattern())


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"))


def op11_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.reshard(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_compact_windows,
        op3_avi_motion_jpeg,
        op4_rule_ensemble,
        op5_source_mixing,
        op6_repetition_coverage,
        op7_line_dedup,
        op8_simhash,
        op9_token_counts,
        op10_byte_bpe,
        op11_resharding,
        op12_hard_negatives,
        op13_fill_in_middle,
    )
}

#: DuckDB SQL for the rows of a query, where SQL can express it.
ORACLE_SQL: dict[str, str] = {
    "op5_source_mixing": mixing.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
