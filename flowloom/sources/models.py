"""Flow and sink models from CSV files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import access_path, model_name
from ..schema import FLOW_MODELS, SINK_MODELS


def _read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    parts = [spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(p) for p in paths]
    return reduce(DataFrame.unionByName, parts)


def compiled(models: DataFrame) -> DataFrame:
    """Models with their full type name, look-up name and access paths as columns."""
    out = models.withColumn("fqn", F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), "type")).withColumn("lookup", model_name(F.col("type"), F.col("name"))).withColumn("from_", access_path(F.col("input")))
    return out.withColumn("to_", access_path(F.col("output"))) if "output" in models.columns else out


def flow_models(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files together; a kind other than value and taint is an error."""
    known = _read(spark, paths, FLOW_MODELS).drop("ext", "provenance")
    checked = F.when(F.col("kind").isin("value", "taint"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of flow model: "), F.coalesce("kind", F.lit("null")))).cast("string"))
    return compiled(known.withColumn("kind", checked))


def sink_models(spark: SparkSession, paths: list[str]) -> DataFrame:
    return compiled(_read(spark, paths, SINK_MODELS).drop("ext", "provenance"))
