"""Exact histogram of encoded lengths, whose suffix sums answer every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, packed, text_of

SPAN = 1024


def token_lengths(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``(n_tokens)`` of every whole text under a rank file; null counts as empty, which has none."""
    with open(vocabulary_path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: of fixed size

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(enc.encode_ordinary(t)) for t in b.column("__text").to_pylist()], pa.int64())], names=["n_tokens"])

    return packed(docs, __text=text_of(text_col)).select("__text").mapInArrow(go, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """For each length that occurs: how many documents have it, and what follows for a limit of that length.

    ``lengths(n_tokens)`` is one row a document.  Columns: n_tokens, docs;
    docs_at_most, tokens_at_most (this length or shorter); docs_over,
    tokens_over (longer: the suffix sums); tokens_kept, what is left when every
    document is cut to this length; share_at_most, the quantile of this length.
    The counts are summed in the tasks first.  The sums run within spans of
    lengths, and over one row a span, so no task holds the whole histogram.
    An empty table gives no rows; equal lengths share one.
    """
    hist = durable(lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")).withColumn("span", F.floor(F.col("n_tokens") / SPAN)), "histogram")
    sums = hist.groupBy("span").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    over_spans = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    longer = sums.select("span", F.coalesce(F.sum("d").over(over_spans), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(over_spans), F.lit(0)).alias("t"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    inside = Window.partitionBy("span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = (
        hist.withColumn("di", F.coalesce(F.sum("docs").over(inside), F.lit(0)))
        .withColumn("ti", F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(inside), F.lit(0)))
        .join(longer, "span")
        .withColumn("docs_over", F.col("d") + F.col("di"))
        .withColumn("tokens_over", F.col("t") + F.col("ti"))
    )
    return out.select(
        "n_tokens",
        "docs",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_at_most"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_at_most"),
        "docs_over",
        "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("tokens_kept"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_at_most"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits, read off the histogram: (limit, docs_over, tokens_kept).  A limit
    below every length cuts all documents; an empty histogram gives zeros."""
    cuts = [
        F.struct(
            F.lit(n).cast("long").alias("limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > n, F.col("docs"))), F.lit(0)).alias("docs_over"),
            F.coalesce(F.sum(F.col("docs") * F.least("n_tokens", F.lit(n))), F.lit(0)).alias("tokens_kept"),
        )
        for n in limits
    ]
    return histogram.agg(F.array(*cuts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of the documents does not exceed: (share, n_tokens)."""
    found = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return histogram.agg(F.array(*found).alias("x")).select(F.explode("x").alias("x")).select("x.*")
