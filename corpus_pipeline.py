"""A corpus pipeline of the operators in loomgraph.llm: each stage takes what the one before has kept."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import line_dedup, mixing, queries, rule_ensemble, simhash


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of `like`, n_chars (if there) counted anew from the text."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(like.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble predicts to be of low quality; the labels come from sf_dir.

    A null text is scored as an empty one, null ids are scored like others, repeated rows and ties alike; an empty table stays empty,
    very long texts are scored whole, and further columns stay as they are.
    """
    model = rule_ensemble.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_ensemble.accepted(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share from all but one of them; a document without lines left keeps an empty text.

    A null text becomes empty, a null id is less than all others; rows that repeat the largest id all keep their lines. Very long texts
    are split whole; an empty table stays empty; further columns stay as they are, but n_chars is counted anew.
    """
    taken = {c.lower() for c in docs.columns}  # Spark's names know no case
    free = next(name for k in range(len(taken) + 1) if (name := f"lines_dropped_{k}") not in taken)
    return _columns(line_dedup.drop_lines(docs, dropped=free), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of least doc_id (null ids last; equal rows count as copies).

    Null and empty texts are copies of each other. Very long texts are hashed whole; an empty table stays empty; further columns stay as they are.
    """
    return simhash.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as its source's target needs it; rows without words are taken as their source's least keys are.

    A null source is a source, null ids hash alike, ties are parted by a row's place; an empty table stays empty. A text's length is no matter, and
    further columns stay as they are.
    """
    return mixing.mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that is left (a null or empty text has no tokens).

    Repeated rows give repeated rows, null ids stay null, very long texts are encoded whole, an empty table gives no rows; further columns are not carried on.
    """
    return queries.encode_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each keeps is written as Parquet in the shared folder and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    into = os.path.join(shared, f"corpus-pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{into}/{k}-{name}")
        docs = spark.read.parquet(f"{into}/{k}-{name}")
    return docs


#: SQL can express neither the classifier nor the fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None
