"""Searches over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import call_table, uses_invocation
from ..schema import NODES


def arriving_nodes(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """A stream of the ``nodes`` in Parquet files that are put into ``folder``."""
    return spark.readStream.schema(", ".join(f"{c} {t}" for c, t in NODES.items())).option("maxFilesPerTrigger", files_each).parquet(folder)


def arriving_calls(nodes: DataFrame, pattern: str) -> DataFrame:
    """Matching calls of a stream of nodes as rows of the call table; no state."""
    return call_table(nodes.where("kind in ('MethodInvocation', 'NewClass')"), F.col("file_id"), pattern)


def files_seen_using(nodes: DataFrame, patterns: list[str]) -> DataFrame:
    """Each file once, when a call that a pattern matches is first seen in it; the state is a row a file."""
    return uses_invocation(nodes.where("kind in ('MethodInvocation', 'NewClass')"), patterns)
