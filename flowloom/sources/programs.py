"""Tables of the star schema as programs and flow graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import durable
from ..schema import as_nodes

#: Each user's events are a method.  Events run in time order: a signup declares a variable, a purchase
#: assigns it, a click copies another one into it, a view passes it to a call, and an error is an `if`
#: whose block holds the events up to the next error.  ``{k}`` reads the variable's number.
EVENT_PROGRAM = """
WITH e AS (
  SELECT user_id AS u, event_type AS t, CAST(value AS STRING) AS val, CAST({k} AS INT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events),
f AS (
  SELECT u, t, val, rn, n, concat('v', CAST(k % 8 AS STRING)) AS v, concat('v', CAST(CAST(floor(k / 8.0) AS INT) % 8 AS STRING)) AS w,
         max(CASE WHEN t = 'error' THEN rn END) OVER (PARTITION BY u ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS err,
         coalesce(min(CASE WHEN t = 'error' THEN rn END) OVER (PARTITION BY u ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n + 1) AS nxt
  FROM e),
g AS (
  SELECT *, CAST(u AS BIGINT) * 4294967296 AS base,
         CASE WHEN err IS NULL OR t = 'error' THEN 1 ELSE err * 8 + 2 END AS up,
         CASE WHEN err IS NULL OR t = 'error' THEN 2 ELSE 4 END AS d
  FROM f),
s AS (
  SELECT u, base, base AS id, NULL AS parent, 'root' AS role, 0 AS ordinal, 0 AS pre, (n + 1) * 16 + 15 AS post, 0 AS depth, 'MethodDeclaration' AS kind, concat('user', CAST(u AS STRING)) AS name, NULL AS lit FROM g WHERE rn = 1
  UNION ALL SELECT u, base, base + 1, base, 'body', 0, 1, (n + 1) * 16 + 14, 1, 'Block', NULL, NULL FROM g WHERE rn = 1
  UNION ALL SELECT u, base, base + rn * 8, base + up, 'statement', rn, rn * 16, CASE WHEN t = 'error' THEN nxt * 16 - 1 ELSE rn * 16 + 12 END, d,
       CASE t WHEN 'error' THEN 'If' WHEN 'signup' THEN 'VariableDeclaration' WHEN 'view' THEN 'MethodInvocation' ELSE 'Assignment' END,
       CASE t WHEN 'signup' THEN v WHEN 'view' THEN 'view' END, NULL FROM g
  UNION ALL SELECT u, base, base + rn * 8 + 1, base + rn * 8, CASE t WHEN 'error' THEN 'condition' WHEN 'signup' THEN 'initializer' WHEN 'view' THEN 'argument' ELSE 'variable' END, 0, rn * 16 + 1, rn * 16 + 2, d + 1,
       CASE t WHEN 'signup' THEN 'Literal' ELSE 'Identifier' END, CASE t WHEN 'signup' THEN NULL ELSE v END, CASE t WHEN 'signup' THEN val END FROM g
  UNION ALL SELECT u, base, base + rn * 8 + 2, base + rn * 8, CASE t WHEN 'error' THEN 'true_part' ELSE 'assignment' END, 1, rn * 16 + 3, CASE t WHEN 'error' THEN nxt * 16 - 2 ELSE rn * 16 + 4 END, d + 1,
       CASE t WHEN 'error' THEN 'Block' WHEN 'purchase' THEN 'Literal' ELSE 'Identifier' END, CASE t WHEN 'click' THEN w END, CASE t WHEN 'purchase' THEN val END FROM g WHERE t IN ('error', 'purchase', 'click')),
nodes AS (
  SELECT concat('f', CAST(u % 16 AS STRING)) AS file_id, id AS node_id, parent AS parent_id, role, CAST(ordinal AS INT) AS ordinal,
         base + pre AS pre, base + post AS post, depth, kind, name, lit AS literal_value, CAST(u AS STRING) AS owner FROM s)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programs of :data:`EVENT_PROGRAM` as a ``nodes`` table."""
    sql = EVENT_PROGRAM.replace("{k}", "get_json_object(props, '$.k')").replace("FROM events)", "FROM {events})")
    # the rows are numbered once, not for each kind of node
    rows, shape = sql.split(",\ns AS (", 1)
    placed = durable(spark.sql(rows + " SELECT * FROM g", events=events(spark, sf_dir)))
    flat = spark.sql("WITH s AS (" + shape.replace("FROM g", "FROM {placed}") + "SELECT * FROM nodes", placed=placed)
    call = F.struct(F.lit("shop.Events").alias("declaring"), F.lit("view").alias("name"), F.array(F.lit("double")).alias("params"), F.lit("void").alias("ret"), F.array(F.lit("Static")).alias("flags"))
    return durable(as_nodes(
        flat.withColumn("literal", F.when(F.col("literal_value").isNotNull(), F.struct(F.lit("double").alias("type"), F.col("literal_value").alias("value"))))
        .withColumn("method_type", F.when(F.col("kind") == "MethodInvocation", call))
        .withColumn("type", F.when(F.col("kind").isin("Identifier", "Literal", "VariableDeclaration"), F.lit("double")))
    ))


def line_name() -> Column:
    return F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey")


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer → order → line → {part, supplier} as ``(src, dst, kind)``; repeated rows make repeated edges."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l", line_name())
    return (
        orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("orders").alias("kind"))
        .unionByName(line.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.col("l").alias("dst"), F.lit("has").alias("kind")))
        .unionByName(line.select(F.col("l").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("of").alias("kind")))
        .unionByName(line.select(F.col("l").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("from").alias("kind")))
    )


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as call sites: the brand is the declaring type, the type the method's name, the size picks the parameters."""
    params = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array(F.lit("java.lang.String"))).otherwise(F.array(F.lit("java.lang.String"), F.lit("int")))
    method = F.struct(F.concat(F.lit("shop."), F.regexp_replace("p_brand", "#", "")).alias("declaring"), F.lower("p_type").alias("name"), params.alias("params"), F.lit("double").alias("ret"), F.array().cast("array<string>").alias("flags"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file_id"), F.col("p_partkey").alias("node_id"), method.alias("method_type"))


def brand_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``type_edges``: each brand extends a line of five, each line the root type."""
    brand = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.regexp_replace("p_brand", "#", "").alias("b")).distinct()
    line = F.concat(F.lit("shop.Line"), F.regexp_extract("b", "([0-9]+)", 1).cast("int") % 5)
    return (
        brand.select(F.concat(F.lit("shop."), "b").alias("fqn"), line.alias("super_fqn"), F.lit("class").alias("relation"))
        .unionByName(brand.select(line.alias("fqn"), F.lit("shop.Item").alias("super_fqn"), F.lit("interface").alias("relation")).distinct())
    )
