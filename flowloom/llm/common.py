"""Helpers shared by the corpus operators: inputs, durable intermediates, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Keep an Arrow batch small: whole documents may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def durable(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, is computed once, and outlives any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """One side of a join whose sides both grow with the input, so that both shuffle whatever size Spark expects.

    Spark sizes an exploded table by its input and a file by its compressed bytes, so it may broadcast what is a hundred times larger; the driver would hold all of it.
    """
    return df.hint("merge")


def packed(df: DataFrame, **named: str | Column) -> DataFrame:
    """All columns of ``df`` in one struct ``__row`` beside the named expressions, so that no input name can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("__row"), *[(F.col(f"`{v}`") if isinstance(v, str) else v).alias(k) for k, v in named.items()])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected graph ``links(a, b)``.

    Returns ``(node, root)`` for every linked node that is not a root itself; the
    root is the smallest node of its component.  Alternates large-star and small-star
    contraction; each round is written to the shared folder.  A hub is met only
    by a pre-aggregated minimum and a join that adaptive execution may split.
    Empty links give no rows; self-links and repeated links do no harm.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large-star: larger neighbours of u (and u's own side) move to u's smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = durable(both.where("v > u").join(growing(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small-star: u and its smaller neighbours move to the smallest of them
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(growing(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = durable(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle; raise max_rounds")
