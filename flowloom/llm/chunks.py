"""Long ordered groups cut into chunks, so that no group has to be one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .mixing import written_order

#: Rows of a chunk at most.
CHUNK_ROWS = 4096


def group_key(column: str) -> Column:
    """A group's name that is never null: a null group is a group of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{column}`").cast("string")), F.lit("n"))


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with their ``position`` in the order of ``by``, nulls first; rows that tie in all of it stand in any order.

    Ranges of the order are dealt to tasks, a group or a value that holds many rows to several.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(n, *by, "__tie").sortWithinPartitions(*by, "__tie").drop("__tie")
    return written_order(durable(dealt, "ordered"))


def chunk_strings(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, **symbols: str) -> DataFrame:
    """``(key, chunk, first, last, *symbols)``: the one-character columns ``symbols`` of ``rows(key, position)`` as strings, a row for each group and chunk.

    Chunks are stretches of ``chunk_rows`` positions, numbered one by one, so the chunk before one is known by its number;
    ``first`` and ``last`` say whether a group starts or ends there.
    """
    told = F.struct("position", *[F.col(c).alias(name) for name, c in symbols.items()])
    cut = rows.groupBy("key", F.expr(f"position div {chunk_rows}").alias("chunk")).agg(F.array_sort(F.collect_list(told)).alias("rows"))
    cut = durable(cut.select("key", "chunk", *[F.array_join(F.col(f"rows.{name}"), "").alias(name) for name in symbols]), "chunks")
    ends = cut.groupBy("key").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return cut.join(ends, "key").select("key", "chunk", (F.col("chunk") == F.col("low")).alias("first"), (F.col("chunk") == F.col("high")).alias("last"), *symbols)


def entry_states(maps: DataFrame, start: int = 0) -> DataFrame:
    """``(key, chunk, entry)``: the state of a machine where each chunk begins, from ``maps(key, chunk, first, exits)``.

    ``exits[s]`` is the state that a chunk ends in when it begins in s; a group begins in ``start``.
    Maps are composed over 1, 2, 4, ... chunks, so the rounds grow with the logarithm of a group's length; what is the same for every state needs no more rounds.
    """
    opened = maps.where("first").select("key", "chunk", F.lit(start).alias("entry"))
    begun = F.when(F.col("first"), F.transform("exits", lambda _: F.col("exits")[start])).otherwise(F.col("exits"))
    told = durable(maps.where("not last").select("key", (F.col("chunk") + 1).alias("chunk"), F.col("chunk").alias("base"), begun.alias("map")), "maps")
    while not (open_ := told.where("size(array_distinct(map)) > 1")).isEmpty():
        before = told.select("key", F.col("chunk").alias("base"), F.col("base").alias("further"), F.col("map").alias("inner"))
        moved = open_.join(before, ["key", "base"]).select("key", "chunk", F.col("further").alias("base"), F.expr("transform(inner, s -> map[s])").alias("map"))
        told = durable(told.where("size(array_distinct(map)) = 1").unionByName(moved), "maps")
    return opened.unionByName(told.select("key", "chunk", F.col("map")[0].alias("entry")))
