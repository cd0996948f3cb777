"""Queries over the users' events as programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cfg, flow, scope, search, traits, tree
from ..sources.programs import EVENT_PROGRAM, event_nodes

VALUE = 100


def _key(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select("file_id", "node_id", *columns)


def ancestor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ancestors each node has, and how many of them are blocks."""
    chained = tree.chains(event_nodes(spark, sf_dir), columns=("kind",)).where(F.size("chain") > 0)
    return _key(chained, F.size("chain").cast("long").alias("n"), F.size(F.filter("chain", lambda a: a["anc_kind"] == "Block")).cast("long").alias("blocks"))


def enclosing_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(tree.nearest_in(tree.chains(event_nodes(spark, sf_dir), columns=("kind",)), lambda a: a["anc_kind"] == "If"), "found_id")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(tree.callable_blocks(event_nodes(spark, sf_dir)), "block_id")


def branch_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.sub_blocks(event_nodes(spark, sf_dir))


def variable_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(traits.var_access(event_nodes(spark, sf_dir)), "name", "is_lvalue", "is_rvalue")


def expression_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(traits.expressions(event_nodes(spark, sf_dir)), "expr_kind")


def statement_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(traits.statements(event_nodes(spark, sf_dir)), "kind", "stmt_kind")


def method_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(traits.methods(event_nodes(spark, sf_dir)), "method_name", "return_type")


def declared_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(traits.variables(event_nodes(spark, sf_dir)), "name", "variable_kind", "callable_id")


def call_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(traits.calls(event_nodes(spark, sf_dir)), "n_args")


def first_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(traits.arguments(event_nodes(spark, sf_dir), 0), "call_id")


def filled_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(traits.parameters_filled(event_nodes(spark, sf_dir), 0), "call_id")


def guard_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(traits.guards(event_nodes(spark, sf_dir)), "guard_kind")


def resolved_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = event_nodes(spark, sf_dir)
    return _key(scope.resolve(traits.var_access(nodes), scope.declarations(nodes)), "decl_id")


def values_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.assigned_values(event_nodes(spark, sf_dir)).select("file_id", "decl_id", "value_id")


def folded_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.fold_constants(event_nodes(spark, sf_dir))


def folded_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.literals_of(scope.fold_constants(event_nodes(spark, sf_dir)), "double")


def writes_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.reaching_writes(event_nodes(spark, sf_dir))


def flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(flow.data_flow_nodes(event_nodes(spark, sf_dir)), "df_kind")


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.value_edges(event_nodes(spark, sf_dir))


SPEC = flow.FlowSpec(lambda n: (F.col("kind") == "Literal") & (F.col("literal.value").try_cast("double") > VALUE), lambda n: F.col("role") == "argument")


def local_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between large values and the arguments of views."""
    return flow.local_marks(event_nodes(spark, sf_dir), SPEC)


def method_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of view as the search finds them."""
    return search.find_methods(event_nodes(spark, sf_dir), "shop.Events v*(double)")


def flow_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, conditions and exits of every user's control flow."""
    cfg_nodes, cfg_edges, _ = cfg.control_flow(event_nodes(spark, sf_dir))
    return cfg.counts(cfg_nodes, cfg_edges)


def guarded_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch blocks that stay reachable when conditions on v0 to v3 let nothing into their branch."""
    nodes = event_nodes(spark, sf_dir)
    cfg_nodes, cfg_edges, units = cfg.control_flow(nodes)
    kept = cfg.keep_edges(cfg_edges, cfg_nodes, nodes, lambda n: (F.col("name").isin("v0", "v1", "v2", "v3"), F.lit(False)))
    return cfg.reachable_blocks(kept).join(cfg_nodes.where("kind = 'block'"), ["file_id", "graph_id", "cfg_id"]).select("file_id", "graph_id", F.expr("cfg_id div 2").alias("leader"))


def graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = event_nodes(spark, sf_dir)
    cfg_nodes, _, _ = cfg.control_flow(nodes)
    return cfg.numbered(cfg_nodes, nodes).select("file_id", "node_id", "label")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, blocks, conditions and end of every graph, reached from either side."""
    _, cfg_edges, _ = cfg.control_flow(event_nodes(spark, sf_dir))
    return cfg.all_nodes(cfg_edges)


def scoped_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses to each variable inside the block that declares it."""
    nodes = event_nodes(spark, sf_dir)
    blocks = tree.parents(nodes, "pre", "post").where("kind = 'VariableDeclaration'").select("file_id", F.col("node_id").alias("decl_id"), F.col("parent_pre").alias("scope_pre"), F.col("parent_post").alias("scope_post"))
    return scope.accesses_in_scope(scope.resolve(traits.var_access(nodes), scope.declarations(nodes)), blocks)


def branch_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost block that holds all views of a user, by the shortest path of blocks."""
    nodes = event_nodes(spark, sf_dir)
    views = nodes.where("kind = 'MethodInvocation'").select(F.col("owner").alias("group"), "file_id", "node_id")
    return tree.common_block(views, nodes)


def _sql(query: str, more: str = "") -> str:
    return EVENT_PROGRAM.replace("{k}", "json_extract_string(props, '$.k')") + more + query


_P = "n JOIN nodes p ON p.file_id = n.file_id AND p.node_id = n.parent_id"
_READ = "n.kind = 'Identifier' AND NOT (p.kind = 'Assignment' AND n.role = 'variable')"
#: Base rows of a control-flow graph: each statement or condition, its error group, and what its block is led by.
_CFG = """
, q AS (SELECT u, base, t, rn, n, err, nxt FROM g),
errs AS (SELECT u, base, rn, nxt, v, row_number() OVER (PARTITION BY u ORDER BY rn) AS e, n FROM g WHERE t = 'error'),
lead AS (
  SELECT base, base + 1 AS graph_id, base + min(rn) * 8 + CASE WHEN min(CASE WHEN rn = 1 AND t = 'error' THEN 1 END) = 1 THEN 1 ELSE 0 END AS leader, 0 AS e, 'head' AS part FROM q GROUP BY base
  UNION ALL SELECT base, base + 1, base + (rn + 1) * 8, e, 'branch' FROM errs WHERE nxt > rn + 1
  UNION ALL SELECT base, base + 1, base + rn * 8 + 1, e, 'condition' FROM errs WHERE e > 1)
"""
SQL = {
    "ancestor_counts": _sql("SELECT n.file_id, n.node_id, count(*) AS n, count(*) FILTER (a.kind = 'Block') AS blocks FROM nodes n JOIN nodes a ON a.file_id = n.file_id AND a.owner = n.owner AND a.pre < n.pre AND a.post > n.post GROUP BY ALL"),
    "enclosing_if": _sql("SELECT n.file_id, n.node_id, max_by(a.node_id, a.depth) AS found_id FROM nodes n JOIN nodes a ON a.owner = n.owner AND a.pre < n.pre AND a.post > n.post WHERE a.kind = 'If' GROUP BY ALL"),
    "bodies": _sql("SELECT n.file_id, n.node_id, b.node_id AS block_id FROM nodes n JOIN nodes b ON b.owner = n.owner AND b.role = 'body' WHERE n.role <> 'root'"),
    "branch_blocks": _sql("SELECT file_id, parent_id AS stmt_id, node_id AS block_id FROM nodes WHERE role = 'true_part'"),
    "variable_accesses": _sql(f"SELECT n.file_id, n.node_id, n.name, n.role = 'variable' AS is_lvalue, NOT n.role = 'variable' AS is_rvalue FROM nodes {_P} WHERE n.kind = 'Identifier'"),
    "expression_views": _sql("SELECT file_id, node_id, CASE kind WHEN 'Identifier' THEN 'VarAccess' WHEN 'Literal' THEN 'Literal' WHEN 'MethodInvocation' THEN 'MethodAccess' ELSE 'ExprFallback' END AS expr_kind FROM nodes WHERE kind IN ('Identifier', 'Literal', 'MethodInvocation', 'Assignment')"),
    "statement_views": _sql("SELECT file_id, node_id, kind, 'StmtFallback' AS stmt_kind FROM nodes WHERE role = 'statement' OR kind = 'Block'"),
    "method_views": _sql("SELECT file_id, node_id, name AS method_name, 'void' AS return_type FROM nodes WHERE role = 'root'"),
    "declared_variables": _sql("SELECT n.file_id, n.node_id, n.name, 'LocalVariable' AS variable_kind, r.node_id AS callable_id FROM nodes n JOIN nodes r ON r.owner = n.owner AND r.role = 'root' WHERE n.kind = 'VariableDeclaration'"),
    "call_views": _sql("SELECT file_id, node_id, 1 AS n_args FROM nodes WHERE kind = 'MethodInvocation'"),
    "first_arguments": _sql("SELECT file_id, node_id, parent_id AS call_id FROM nodes WHERE role = 'argument'"),
    "filled_parameters": _sql("SELECT file_id, node_id, parent_id AS call_id FROM nodes WHERE role = 'argument'"),
    "guard_nodes": _sql("SELECT file_id, node_id, 'expression' AS guard_kind FROM nodes WHERE role = 'condition'"),
    "resolved_variables": _sql("SELECT n.file_id, n.node_id, (SELECT max_by(d.node_id, d.pre) FROM nodes d WHERE d.kind = 'VariableDeclaration' AND d.owner = n.owner AND d.name = n.name AND d.pre <= n.pre) AS decl_id FROM nodes n WHERE n.kind = 'Identifier'"),
    "values_assigned": _sql("""SELECT file_id, decl_id, value_id FROM (
        SELECT file_id, parent_id AS decl_id, node_id AS value_id FROM nodes WHERE role = 'initializer'
        UNION ALL SELECT n.file_id, (SELECT max_by(d.node_id, d.pre) FROM nodes d WHERE d.kind = 'VariableDeclaration' AND d.owner = n.owner AND d.name = n.name AND d.pre <= n.pre), v.node_id
        FROM nodes n JOIN nodes v ON v.parent_id = n.parent_id AND v.role = 'assignment' WHERE n.role = 'variable') WHERE decl_id IS NOT NULL"""),
    "writes_seen": _sql("""SELECT r.file_id, r.node_id, max_by(w.id, w.at) AS write_id FROM nodes r
        JOIN (SELECT d.owner, d.name, d.node_id AS id, d.post AS at, d.parent_id AS blk FROM nodes d WHERE d.kind = 'VariableDeclaration'
              UNION ALL SELECT v.owner, v.name, a.node_id, a.post, a.parent_id FROM nodes v JOIN nodes a ON a.node_id = v.parent_id WHERE v.role = 'variable') w ON w.owner = r.owner AND w.name = r.name AND w.at <= r.pre
        JOIN nodes b ON b.node_id = w.blk AND b.owner = r.owner AND b.pre < r.pre AND b.post > r.post
        WHERE r.kind = 'Identifier' AND r.role <> 'variable' GROUP BY ALL"""),
    "flow_nodes": _sql("SELECT file_id, node_id, 'expression' AS df_kind FROM nodes WHERE kind IN ('Identifier', 'Literal', 'MethodInvocation', 'Assignment')"),
    "method_calls": _sql("SELECT file_id, node_id FROM nodes WHERE kind = 'MethodInvocation'"),
    "flow_graphs": _sql(
        """SELECT concat('f', CAST(u % 16 AS STRING)) AS file_id, base + 1 AS graph_id, (SELECT count(*) FROM lead l WHERE l.base = q.base) AS bb, count(*) FILTER (t = 'error') AS cn,
        CASE WHEN count(*) FILTER (t = 'error') = 0 THEN 1 WHEN max(CASE WHEN t = 'error' THEN rn END) = max(n) THEN 1 ELSE 2 END AS ex FROM q GROUP BY u, base""",
        _CFG,
    ),
    "guarded_reach": _sql(
        """SELECT concat('f', CAST((l.base // 4294967296) % 16 AS STRING)) AS file_id, l.graph_id, l.leader FROM lead l LEFT JOIN errs x ON x.base = l.base AND x.e = l.e
        WHERE l.part <> 'branch' OR x.v NOT IN ('v0', 'v1', 'v2', 'v3')""",
        _CFG,
    ),
    "graph_labels": _sql(
        """, mark AS (SELECT base, leader AS node_id, 'L' AS k FROM lead UNION ALL SELECT base, base + rn * 8 + 1, 'C' FROM errs)
        SELECT concat('f', CAST((base // 4294967296) % 16 AS STRING)) AS file_id, node_id, concat(row_number() OVER (PARTITION BY base, k ORDER BY node_id), k) AS label FROM mark""",
        _CFG,
    ),
}
SQL["graph_nodes"] = _sql(
    """, ids AS (SELECT base, leader * 2 AS cfg_id FROM lead UNION ALL SELECT base, (base + rn * 8 + 1) * 2 + 1 FROM errs UNION ALL SELECT DISTINCT base, -1 FROM g UNION ALL SELECT DISTINCT base, -2 FROM g)
    SELECT concat('f', CAST((base // 4294967296) % 16 AS STRING)) AS file_id, base + 1 AS graph_id, cfg_id FROM ids""",
    _CFG,
)
SQL["scoped_accesses"] = _sql("""SELECT r.file_id, r.node_id, d.node_id AS decl_id
    FROM (SELECT *, max(CASE WHEN kind = 'VariableDeclaration' THEN pre END) OVER (PARTITION BY owner, name ORDER BY pre) AS dpre FROM nodes WHERE kind IN ('Identifier', 'VariableDeclaration')) r
    JOIN nodes d ON d.owner = r.owner AND d.pre = r.dpre JOIN nodes b ON b.owner = d.owner AND b.node_id = d.parent_id
    WHERE r.kind = 'Identifier' AND b.pre <= r.pre AND b.post >= r.pre""")
SQL["branch_summaries"] = _sql("""SELECT u AS "group", blk AS block_id FROM (SELECT owner AS u, parent_id AS blk, row_number() OVER (PARTITION BY owner ORDER BY depth, node_id) AS rn FROM nodes WHERE kind = 'MethodInvocation') WHERE rn = 1""")
SQL["folded_constants"] = SQL["values_assigned"].replace("SELECT file_id, decl_id, value_id FROM (", ", va AS (SELECT file_id, decl_id, value_id FROM (", 1) + f"""),
    one AS (SELECT decl_id, min(value_id) AS value_id FROM va GROUP BY 1 HAVING count(*) = 1),
    rd AS (SELECT n.file_id, n.node_id, (SELECT max_by(d.node_id, d.pre) FROM nodes d WHERE d.kind = 'VariableDeclaration' AND d.owner = n.owner AND d.name = n.name AND d.pre <= n.pre) AS decl_id FROM nodes {_P} WHERE {_READ})
    SELECT rd.file_id, rd.node_id, coalesce(one.value_id, rd.node_id) AS constant_id, l.literal_value AS literal FROM rd LEFT JOIN one USING (decl_id) LEFT JOIN nodes l ON l.node_id = one.value_id AND l.kind = 'Literal'"""
SQL["folded_doubles"] = "SELECT file_id, node_id, constant_id, CAST(literal AS DOUBLE) AS value FROM (" + SQL["folded_constants"] + ") WHERE literal IS NOT NULL"
SQL["flow_edges"] = SQL["writes_seen"].replace("SELECT r.file_id", ", ws AS (SELECT r.file_id", 1).replace(
    ") w ON w.owner = r.owner AND w.name = r.name AND w.at <= r.pre",
    """ UNION ALL SELECT i.owner, i.name, i.node_id, i.pre, max_by(k.node_id, k.depth) FROM nodes i JOIN nodes k ON k.owner = i.owner AND k.kind = 'Block' AND k.pre < i.pre AND k.post > i.post WHERE i.kind = 'Identifier' AND i.role <> 'variable' GROUP BY ALL) w
        ON w.owner = r.owner AND w.name = r.name AND w.at <= r.pre AND w.id <> r.node_id""",
) + """)
    SELECT file_id, node_id AS src, parent_id AS dst, 'write' AS kind FROM nodes WHERE role IN ('initializer', 'assignment')
    UNION ALL SELECT file_id, write_id, node_id, 'read' FROM ws"""
SQL["local_flow"] = "WITH RECURSIVE fe AS (" + SQL["flow_edges"] + f"""), nn AS ({_sql("SELECT * FROM nodes")}),
    a AS (SELECT file_id, node_id FROM nn WHERE kind = 'Literal' AND TRY_CAST(literal_value AS DOUBLE) > {VALUE} UNION SELECT fe.file_id, fe.dst FROM a JOIN fe ON fe.file_id = a.file_id AND fe.src = a.node_id),
    z AS (SELECT file_id, node_id FROM nn WHERE role = 'argument' UNION SELECT fe.file_id, fe.src FROM z JOIN fe ON fe.file_id = z.file_id AND fe.dst = z.node_id)
    SELECT a.file_id, a.node_id, n.kind = 'Literal' AS is_source, n.role = 'argument' AS is_sink FROM a JOIN z USING (file_id, node_id) JOIN nn n USING (file_id, node_id)"""
QUERIES = {
    f.__name__: f
    for f in (
        ancestor_counts, enclosing_if, bodies, branch_blocks, variable_accesses, expression_views, statement_views, method_views, declared_variables, call_views, first_arguments, filled_parameters, guard_nodes,
        resolved_variables, values_assigned, folded_constants, folded_doubles, writes_seen, flow_nodes, flow_edges, local_flow, method_calls, flow_graphs, guarded_reach, graph_labels, graph_nodes, scoped_accesses, branch_summaries,
    )
}
