"""The corpus pipeline: quality rules, exact and near deduplication, mixing, encoding.

Every stage works on rows, so rows that share an id are rows of their own; columns of any other name, ``kept``, ``slot`` or
``id`` among them, pass through all stages but the last untouched; an empty table stays an empty table with its columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import bpe, common, exact_dedup, mixing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null, empty or too short text is rejected.  Equal texts have equal verdicts.  Without labels of both kinds
    the base rules decide alone.
    """
    common.tune(spark)
    return quality.keep_quality(docs, common.table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays.

    Null counts as empty text.  A null doc_id loses to any other; of rows that tie in both, exactly one stays.
    """
    common.tune(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest doc_id.

    Texts without a word, null ones too, are alike.  A null doc_id loses to any other; of rows that tie in the doc_id,
    the one with the smallest digest of its text stays, and of equal rows exactly one.
    """
    common.tune(spark)
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, in the order of the mixing schedule.

    A null source is a source of its own, a null doc_id sorts as the text 'null', and rows that tie in the doc_id are in
    any order among themselves.  Texts are not looked at.
    """
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and its position in the mixing schedule.

    The result has doc_id, what :func:`bpe.encode_documents` finds, and position; a null text has no tokens, a null doc_id stays null,
    and repeated rows have a position each.
    """
    common.tune(spark)
    placed = mixing.written_order(docs, keep=("doc_id", "text")).select(F.struct("doc_id", "position").alias("at"), "text")
    found = bpe.encode_documents(placed, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, id_col="at")
    return found.select("at.doc_id", *found.columns[1:], "at.position")


STAGES = [("quality rules", quality_rules), ("exact dedup", drop_exact), ("near dedup", drop_near), ("mixing", mix_sources), ("encoding", encode)]

#: The classifier and SimHash can't be said in SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = common.durable(docs, f"pipeline{n}")
    return docs
