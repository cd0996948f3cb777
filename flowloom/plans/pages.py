"""Queries over web pages as trees, and over conversations as calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import flow, tree
from ..sources.dom import ENDS, TAGS_A_PAGE, VOID, page_nodes


def page_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested tags of every page."""
    return page_nodes(spark, sf_dir).select("file_id", "node_id", "parent_id", "depth", "kind")


def page_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest landmark around each link."""
    nodes = page_nodes(spark, sf_dir)
    chained = tree.chains(nodes, nodes.where("kind = 'a'"), columns=("kind",))
    return tree.nearest_in(chained, lambda a: a["anc_kind"].isin("nav", "article", "footer", "body"), "kind").select("file_id", "node_id", "found_id", F.col("found_kind").alias("landmark"))


def page_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost element below the body around each link."""
    nodes = page_nodes(spark, sf_dir)
    chained = tree.chains(nodes, nodes.where("kind = 'a'"), columns=("kind",))
    return tree.outermost_in(chained, lambda a: ~a["anc_kind"].isin("html", "body")).select("file_id", "node_id", "found_id")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns are calls of the conversation, assistant turns what it returns; each answers the latest call before it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("call", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(before))


def answered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return edges from assistant turns to the user turns that they answer, by (conversation, call)."""
    turns = _turns(spark, sf_dir)
    method = F.struct("conv_id", "call").alias("method")
    returns = turns.where("role = 'assistant' and call is not null").select(method, F.col("turn").alias("node"))
    calls = turns.where("role = 'user'").select(method, F.col("turn").alias("call"))
    return flow.return_edges(returns, calls.distinct()).select("src", "dst", "kind")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _told(which: int) -> str:
    return "CASE " + " ".join(f"WHEN kind IN {tuple(rule[0]) + ('',)} THEN {_list(rule[which])}" for rule in ENDS) + " ELSE CAST([] AS VARCHAR[]) END"


#: Tag by tag over all pages at once: the open elements, innermost first, before and after each tag.
_OPEN = rf"""
WITH RECURSIVE h AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\b[^>]*>.*?</script\s*>', '', 'gis'), '<style\b[^>]*>.*?</style\s*>', '', 'gis') AS h FROM pages),
a AS (SELECT page_id, regexp_extract_all(h, '</?[A-Za-z][A-Za-z0-9-]*\b[^>]*>') AS tags FROM h),
t AS (SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM a),
k AS (SELECT page_id, pos, starts_with(tag, '</') AS shut, ends_with(tag, '/>') AS alone, lower(regexp_extract(tag, '[A-Za-z][A-Za-z0-9-]*')) AS kind FROM t),
r AS (SELECT *, {_told(1)} AS ends, {_told(2)} AS within FROM k),
s AS (
  SELECT page_id, -1::BIGINT AS pos, CAST([] AS STRUCT(pos BIGINT, kind VARCHAR)[]) AS around, CAST([] AS STRUCT(pos BIGINT, kind VARCHAR)[]) AS stack, NULL::VARCHAR AS kind, true AS shut FROM h
  UNION ALL
  SELECT page_id, pos, rest, CASE WHEN shut OR alone OR kind IN {VOID} THEN rest ELSE [struct_pack(pos := pos, kind := kind)] || rest END, kind, shut
  FROM (SELECT q.*, CASE WHEN shut AND hit > 0 OR NOT shut AND hit > 0 AND list_contains(ends, before[hit].kind) THEN before[hit + 1 :] ELSE before END AS rest
        FROM (SELECT r.*, s.stack AS before, coalesce(list_position(list_transform(s.stack, lambda x: CASE WHEN r.shut THEN x.kind = r.kind ELSE list_contains(r.ends, x.kind) OR list_contains(r.within, x.kind) END), true), 0) AS hit
              FROM s JOIN r ON r.page_id = s.page_id AND r.pos = s.pos + 1) q)),
o AS (SELECT page_id, pos, kind, around FROM s WHERE NOT shut),
x AS (SELECT page_id, pos, kind, unnest(around).pos AS apos, unnest(around).kind AS akind FROM o)
"""
SQL = {
    "page_trees": _OPEN + f"SELECT concat('page', page_id) AS file_id, page_id * {TAGS_A_PAGE} + pos AS node_id, page_id * {TAGS_A_PAGE} + around[1].pos AS parent_id, len(around)::INT AS depth, kind FROM o",
    "page_landmarks": _OPEN + f"SELECT concat('page', page_id) AS file_id, page_id * {TAGS_A_PAGE} + pos AS node_id, page_id * {TAGS_A_PAGE} + max(apos) AS found_id, max_by(akind, apos) AS landmark FROM x WHERE kind = 'a' AND akind IN ('nav', 'article', 'footer', 'body') GROUP BY page_id, pos",
    "page_outermost": _OPEN + f"SELECT concat('page', page_id) AS file_id, page_id * {TAGS_A_PAGE} + pos AS node_id, page_id * {TAGS_A_PAGE} + min(apos) AS found_id FROM x WHERE kind = 'a' AND akind NOT IN ('html', 'body') GROUP BY page_id, pos",
    "answered_turns": "SELECT a.turn AS src, max(u.turn) AS dst, 'return' AS kind FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.role = 'user' AND u.turn <= a.turn WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn",
}
QUERIES = {f.__name__: f for f in (page_trees, page_landmarks, page_outermost, answered_turns)}
