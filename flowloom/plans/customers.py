"""Queries over the customers as programs, and SQL that says from the customers alone what each construct adds to the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cfg, flow, models, scope, search, traits
from ..operators import desugar
from ..sources.customers import CONSTRUCTS, FLOWS, LIBRARY_IDS, METHOD_IDS, customer_nodes, numbered
from ..sources.models import compiled


def _counted(nodes: DataFrame, found: DataFrame, *by: str, **sums: str) -> DataFrame:
    """How often each method has what was found."""
    owner = nodes.select("file_id", "node_id", F.col("owner").alias("method"))
    return found.join(owner, ["file_id", "node_id"]).groupBy("method", *by).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])


def customer_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, conditions and exits of every method's control flow; sound graphs only have what the rules ask."""
    cfg_nodes, cfg_edges, _ = cfg.control_flow(customer_nodes(spark, sf_dir))
    broken = cfg.invalid(cfg_nodes, cfg_edges).groupBy("file_id", "graph_id").agg(F.count("*").alias("invalid"))
    return cfg.counts(cfg_nodes, cfg_edges).join(broken, ["file_id", "graph_id"], "left").withColumn("invalid", F.coalesce("invalid", F.lit(0)))


def customer_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes, diamonds and arrows, and how many of them for true and false, each method's drawing has."""
    nodes = customer_nodes(spark, sf_dir)
    cfg_nodes, cfg_edges, units = cfg.control_flow(nodes)
    drawn = cfg.dot(cfg_nodes, cfg_edges, search.block_text(units, nodes).select("file_id", "cfg_id", "label"))
    marks = {"boxes": "shape=box", "diamonds": "shape=diamond", "arrows": " -> ", "trues": 'label="True"', "falses": 'label="False"'}
    return drawn.select("file_id", "graph_id", *[F.regexp_count("dot", F.lit(m)).cast("long").alias(n) for n, m in marks.items()])


def customer_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = customer_nodes(spark, sf_dir)
    return _counted(nodes, traits.expressions(nodes), "expr_kind")


def customer_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = customer_nodes(spark, sf_dir)
    return _counted(nodes, traits.statements(nodes), "stmt_kind")


def customer_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = customer_nodes(spark, sf_dir)
    return _counted(nodes, traits.guards(nodes), "guard_kind")


def customer_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = customer_nodes(spark, sf_dir)
    return _counted(nodes, traits.calls(nodes), "kind", args="n_args")


def customer_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = customer_nodes(spark, sf_dir)
    return _counted(nodes, traits.variables(nodes), "variable_kind", "position")


def customer_callables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = customer_nodes(spark, sf_dir)
    return _counted(nodes, traits.methods(nodes), "method_name", "return_type")


def customer_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = customer_nodes(spark, sf_dir)
    return _counted(nodes, traits.var_access(nodes), "is_lvalue", "is_rvalue")


def customer_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binaries, with how many of them have a literal on the right."""
    nodes = customer_nodes(spark, sf_dir)
    right = nodes.where("kind = 'Literal'").select("file_id", F.col("node_id").alias("right_id"), F.lit(1).alias("literal"))
    return _counted(nodes, traits.binaries(nodes).join(right, ["file_id", "right_id"], "left").withColumn("literal", F.coalesce("literal", F.lit(0))), "operator", literals="literal")


def customer_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = customer_nodes(spark, sf_dir)
    return _counted(nodes, traits.selects(nodes))


def customer_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments that fill a first parameter, all of them where it takes many, and first arguments."""
    nodes = customer_nodes(spark, sf_dir)
    first = traits.arguments(nodes, 0).select("file_id", "node_id", F.lit(1).alias("first"))
    return _counted(nodes, traits.parameters_filled(nodes, 0).join(first, ["file_id", "node_id"], "left").withColumn("first", F.coalesce("first", F.lit(0))), firsts="first")


def customer_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, with how many of them are always one literal."""
    nodes = customer_nodes(spark, sf_dir)
    return _counted(nodes, scope.fold_constants(nodes).withColumn("fixed", F.col("literal").isNotNull().cast("int")), fixed="fixed")


def customer_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that control flow lets reach a URI: none behind a guard, none in dead code."""
    return search.insecure_uri_literals(customer_nodes(spark, sf_dir))


#: A model in the form of the files: what a list holds goes into the parameter of the lambda that it is given.
FOR_EACH = ("java.util", "List", True, "forEach", "", "Argument[-1].Element", "Argument[0].Parameter[0]", "value")


def customer_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow from lists through lambdas, as the model says."""
    known = compiled(spark.createDataFrame([FOR_EACH], "package string, type string, subtypes boolean, name string, signature string, input string, output string, kind string"))
    spec = flow.FlowSpec(lambda n: (F.col("role") == "select") & (F.col("name") == "xs"), lambda n: (F.col("role") == "argument") & (F.col("name") == "x"), step=lambda n: models.model_edges(n, known))
    return flow.local_marks(customer_nodes(spark, sf_dir), spec)


def customer_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow from take() through keep(..), declared once a file, to what is printed; what other() gives goes through keep(..) too, and its prints are not marked."""
    return search.flow_between_methods(customer_nodes(spark, sf_dir), "shop.* take()", "shop.* print(..)", "Arguments", "Data")


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of the graphs of :data:`FLOWS`: which block or condition leads to which, and on what outcome."""
    _, cfg_edges, _ = cfg.control_flow(customer_nodes(spark, sf_dir, FLOWS))
    return cfg_edges.where(F.col("graph_id") < LIBRARY_IDS).drop("early")


def customer_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is evaluated in the blocks of :data:`FLOWS`, by the unit's first node and the place in it."""
    nodes = customer_nodes(spark, sf_dir, FLOWS)
    _, _, units = cfg.control_flow(nodes)
    found = cfg.members(units, nodes).where(F.col("graph_id") < LIBRARY_IDS)
    return found.groupBy("file_id", "node_id").agg(F.max("pos").cast("bigint").alias("pos"), F.count("*").alias("copies"))


#: A model of a sink in the form of the files: what the lambda that a list's forEach is given returns.
RESULT_SINK = ("java.util", "List", True, "forEach", "", "Argument[0].ReturnValue", "sql-injection")


def customer_callback_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lambdas return to a method that must not get just anything."""
    known = compiled(spark.createDataFrame([RESULT_SINK], "package string, type string, subtypes boolean, name string, signature string, input string, kind string"))
    return models.model_sinks(customer_nodes(spark, sf_dir), known, "sql-injection")


def customer_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path to each print of a loop's variable, from what a loop goes over."""
    spec = flow.FlowSpec(lambda n: (F.col("role") == "iterable") & (F.col("name") == "xs"), lambda n: (F.col("role") == "argument") & (F.col("name") == "x"), step=flow.element_edges)
    nodes = customer_nodes(spark, sf_dir, FLOWS)
    found = flow.witnesses(nodes, spec, nodes)
    return found.select("file_id", "source_id", "sink_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


#: Methods of a functional type and of the type above it: one is left to implement.
ACTIONS = [("shop.Base", "run", 0, []), ("shop.Base", "stop", 0, []), ("shop.Base", "of", 0, ["Static"]), ("shop.Action", "stop", 0, ["Default"])]


def customer_lambdas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callables by name, lambdas by the one method of their type that they implement."""
    nodes = customer_nodes(spark, sf_dir, FLOWS)
    known = spark.createDataFrame(ACTIONS, "type string, name string, arity int, flags array<string>")
    above = spark.createDataFrame([("shop.Action", "shop.Base")], "sub string, super string")
    return _counted(nodes, traits.methods(nodes, known, above), "kind", "method_name")


def customer_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses to the instance itself, by what they are part of."""
    nodes = customer_nodes(spark, sf_dir, FLOWS)
    return _counted(nodes, traits.expressions(nodes).where("expr_kind = 'InstanceAccess'"), "role")


def customer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses to fields that no program declares: nations are types below their regions, which have fields xs and q; nations have v, every other one q."""
    nodes = customer_nodes(spark, sf_dir, FLOWS)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("shop.Lib"), "n_nationkey").alias("sub"), F.concat(F.lit("shop.Region"), "n_regionkey").alias("super"), (F.col("n_nationkey") % 2 == 0).alias("even"))
    own = nation.select(F.col("sub").alias("type"), F.explode(F.when(F.col("even"), F.array(F.lit("q"), F.lit("v"))).otherwise(F.array(F.lit("v")))).alias("name"))
    fields = own.unionByName(nation.select(F.col("super").alias("type"), F.explode(F.array(F.lit("q"), F.lit("xs"))).alias("name")).distinct()).withColumn("field_type", F.lit("int"))
    found = scope.resolve(traits.var_access(nodes), scope.declarations(nodes))
    return scope.resolve_fields(found, nodes, fields, nation.select("sub", "super"))


def customer_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each loop's list, how much lies on its own flows to prints, and how many of them are prints: its loop and those behind it that read the list again."""
    spec = flow.FlowSpec(lambda n: (F.col("role") == "iterable") & (F.col("name") == "xs"), lambda n: (F.col("role") == "argument") & (F.col("name") == "x"), step=flow.element_edges)
    nodes = customer_nodes(spark, sf_dir, FLOWS)
    return flow.local_summary_counts(nodes, spec, nodes)


def customer_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow from what a loop goes over, through its variable, to what is printed."""
    spec = flow.FlowSpec(lambda n: (F.col("role") == "iterable") & (F.col("name") == "xs"), lambda n: (F.col("role") == "argument") & (F.col("name") == "x"), step=flow.element_edges)
    return flow.local_marks(customer_nodes(spark, sf_dir, FLOWS), spec)


QUERIES = {
    f.__name__: f
    for f in (
        customer_graphs, customer_drawings, customer_expressions, customer_statements, customer_guards, customer_calls, customer_variables, customer_callables, customer_accesses,
        customer_operators, customer_receivers, customer_filled, customer_folds, customer_uris, customer_callbacks, customer_between, customer_edges, customer_members, customer_elements, customer_callback_sinks, customer_witnesses, customer_lambdas, customer_fields, customer_instances, customer_summaries,
    )
}

#: Blocks, conditions and exits that each construct adds to a graph.
_GRAPH = {"if_else": (3, 1, 0), "if_and": (3, 2, 0), "while": (2, 1, 0), "do_while": (2, 1, 0), "for": (3, 1, 0), "for_each": (2, 1, 0), "switch": (5, 2, 0), "throw": (2, 1, 1), "expression": (3, 1, 0), "jumps": (6, 3, 0), "return": (2, 1, 1), "uri_guarded": (2, 1, 0), "uri_dead": (2, 1, 0)}
#: How many of what each construct has, the call of ``line`` before it included; of a key, one number, or the count and sums.
_CALLS_ONLY = {"if_else": 4, "while": 3, "do_while": 3, "try": 4, "jumps": 5}
_EXPRESSIONS = {k: {"MethodAccess": n} for k, n in _CALLS_ONLY.items()} | {
    "if_and": {"MethodAccess": 4, "BinaryExpr": 1}, "for": {"MethodAccess": 2, "VarAccess": 2, "Literal": 2, "BinaryExpr": 1, "ExprFallback": 1}, "for_each": {"MethodAccess": 2, "VarAccess": 1},
    "switch": {"MethodAccess": 4, "VarAccess": 1}, "throw": {"MethodAccess": 2, "ExprFallback": 1, "ClassInstanceExpr": 1}, "callback": {"MethodAccess": 3, "VarAccess": 2, "ExprFallback": 1},
    "expression": {"MethodAccess": 3, "ClassInstanceExpr": 1, "Literal": 3, "BinaryExpr": 1, "ExprFallback": 2}, "block": {"MethodAccess": 1, "ExprFallback": 2, "VarAccess": 2, "Literal": 1},
    "varargs": {"MethodAccess": 2, "Literal": 2, "VarAccess": 1}, "return": {"MethodAccess": 2, "VarAccess": 1}, "between": {"MethodAccess": 4}, "between_other": {"MethodAccess": 4}, "uri": {"MethodAccess": 2, "Literal": 1},
    "uri_guarded": {"MethodAccess": 3, "Literal": 4}, "uri_dead": {"MethodAccess": 2, "Literal": 2}, "frame": {"VarAccess": 1},
}
_FALLBACKS = {"if_else": 7, "if_and": 6, "while": 5, "do_while": 5, "for": 6, "for_each": 5, "switch": 7, "try": 8, "throw": 7, "callback": 4, "expression": 5, "block": 4, "jumps": 13, "varargs": 2, "return": 4, "between": 4, "between_other": 4, "uri": 2, "uri_guarded": 5, "uri_dead": 4, "frame": 2}
_STATEMENTS = {k: {"StmtFallback": n} | ({"ReturnStmt": 1} if k in ("return", "frame") else {}) for k, n in _FALLBACKS.items()}
_GUARDS = {k: {"expression": n} for k, n in {"if_else": 1, "if_and": 3, "while": 1, "do_while": 1, "for": 1, "throw": 2, "expression": 1, "jumps": 3, "return": 1, "uri_guarded": 1, "uri_dead": 1}.items()} | {"switch": {"case": 3}}
_CALLS = {k: {"MethodInvocation": (n, 0)} for k, n in (_CALLS_ONLY | {"if_and": 4, "for": 2, "for_each": 2, "switch": 4, "block": 1, "return": 2}).items()} | {
    "throw": {"MethodInvocation": (2, 0), "NewClass": (1, 0)}, "callback": {"MethodInvocation": (3, 2)}, "expression": {"MethodInvocation": (3, 0), "NewClass": (1, 1)}, "varargs": {"MethodInvocation": (2, 3)},
    "between": {"MethodInvocation": (4, 2)}, "between_other": {"MethodInvocation": (4, 2)}, "uri": {"MethodInvocation": (2, 1)}, "uri_guarded": {"MethodInvocation": (3, 3)}, "uri_dead": {"MethodInvocation": (2, 1)},
}
_VARIABLES = {"for": {("LocalVariable", None): 1}, "for_each": {("LocalVariable", None): 1}, "callback": {("Parameter", 0): 1}, "expression": {("LocalVariable", None): 1}, "frame": {("Parameter", 0): 1}}
_READ, _BOTH = (False, True), (True, True)
_ACCESSES = {"for": {_READ: 1, _BOTH: 1}, "for_each": {_READ: 1}, "switch": {_READ: 1}, "callback": {_READ: 2}, "block": {_BOTH: 2}, "varargs": {_READ: 1}, "return": {_READ: 1}, "frame": {_READ: 1}}
_OPERATORS = {"if_and": {"And": (1, 0)}, "for": {"LessThan": (1, 1)}, "expression": {"Addition": (1, 0)}}
_RECEIVERS = {"callback": 1, "expression": 1, "uri_guarded": 1}
_FILLED = {"callback": (2, 2), "expression": (1, 1), "varargs": (3, 1), "between": (2, 2), "between_other": (2, 2), "uri": (1, 1), "uri_guarded": (2, 2), "uri_dead": (1, 1)}


def _text(v) -> str:
    return "CAST(NULL AS INT)" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"


_BASE = f"""WITH c AS (
  SELECT concat('f', c_nationkey) AS file_id, concat(c_nationkey, '-', c_mktsegment) AS method, c_nationkey AS nation, c_custkey AS k, c_custkey % {len(CONSTRUCTS)} AS c,
         min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS first FROM customer),
f AS (SELECT DISTINCT file_id, method, nation, first FROM c)
"""


def _sums(table: dict, keys: tuple[str, ...] = (), numbers: tuple[str, ...] = ("n",)) -> str:
    """The constructs' numbers, summed for each method and key; ``frame`` is what every method has around its statements, the declared ``keep`` too."""
    rows, order = [], list(CONSTRUCTS)
    for k, told in table.items():
        for key, ns in told.items() if keys else [((), told)]:
            key, ns = key if isinstance(key, tuple) else (key,), ns if isinstance(ns, tuple) else (ns,)
            rows.append(f"({', '.join(map(_text, (-1 if k == 'frame' else order.index(k), *key, *ns)))})")
    columns = ", ".join((*keys, *numbers))
    return _BASE + f""", m(c, {columns}) AS (VALUES {', '.join(rows)}),
    every AS (SELECT method, c FROM c UNION ALL SELECT method, -1 FROM f UNION ALL SELECT DISTINCT concat('keep-', nation), -1 FROM f)
    SELECT {', '.join(('method', *keys))}, {', '.join(f'sum({n})::BIGINT AS {n}' for n in numbers)} FROM every JOIN m USING (c) GROUP BY {', '.join(('method', *keys))}"""


def _graphs(columns: str) -> str:
    order = list(CONSTRUCTS)
    rows = ", ".join(f"({order.index(k)}, {b}, {n}, {x})" for k, (b, n, x) in _GRAPH.items())
    return _BASE + f""", m(c, bb, cn, ex) AS (VALUES {rows}),
    g AS (SELECT file_id, {METHOD_IDS} + first * 8 + 1 AS graph_id, 1 + coalesce(sum(bb), 0)::BIGINT AS bb, coalesce(sum(cn), 0)::BIGINT AS cn, 1 + coalesce(sum(ex), 0)::BIGINT AS ex FROM c LEFT JOIN m USING (c) GROUP BY ALL
          UNION ALL SELECT DISTINCT file_id, {LIBRARY_IDS} + nation * 8 + 1, 1, 0, 1 FROM f)
    SELECT file_id, graph_id, {columns} FROM g"""


def _at(construct: str, tree_node: int) -> str:
    return f"SELECT file_id, k * 64 + {tree_node} AS node_id FROM c WHERE c = {list(CONSTRUCTS).index(construct)}"


_FOLDED = {k: list(CONSTRUCTS).index(k) for k in ("for", "for_each", "switch", "callback", "block", "varargs", "return")}
#: A variable whose only value is a literal is that literal: i of the last for before a read, and n where one customer of the method adds 2 to it.
_FOLDS = _BASE + """SELECT method, sum(n)::BIGINT AS n, sum(fixed)::BIGINT AS fixed FROM (
    SELECT method, CASE WHEN c IN ({for}, {callback}, {block}) THEN 2 WHEN c IN ({for_each}, {switch}, {varargs}, {return}) THEN 1 ELSE 0 END AS n,
           CASE WHEN c = {for} THEN 2 WHEN c = {block} THEN seen::INT + (adds = 1)::INT WHEN c IN ({switch}, {varargs}, {return}) THEN (adds = 1)::INT ELSE 0 END AS fixed
    FROM (SELECT *, bool_or(c = {for}) OVER (PARTITION BY method ORDER BY k) AS seen, count(*) FILTER (c = {block}) OVER (PARTITION BY method) AS adds FROM c)
    UNION ALL SELECT method, 1, (count(*) FILTER (c = {block}) = 1)::INT FROM c GROUP BY method
    UNION ALL SELECT DISTINCT concat('keep-', nation), 1, 0 FROM f) GROUP BY method""".format(**_FOLDED)

#: The edges of each construct: E is the block that the call of ``line`` before it is in, N the one behind it, and END the method's end; "x?"
#: is the condition x, "x'1" a copy of x that is made for exits ("2" breaks, "3" continues; "4" exits of a finally block inside another),
#: "x<" and "x>" the start and end of the body that x has, "x!" what is made for the loop x, and "x#2" the second x.
_EDGES = {
    "try_return": "E a?, a? Return +, Return END, a? s -",
    "try_nested": "E a?, a? Return +, Return b'1?, b'1? x'1 +, x'1 END, b'1? END -, a? s -, s b?, b? x +, x N, b? N -",
    "try_break": "E a?, a? b +, b b?, b? Break +, Break N, b? c -, c c?, c? Continue +, Continue a?, c? s -, s a?, a? N -",
    "try_inner": "E a?, a? b +, b b?, b? Break +, Break t, b? s -, s a?, a? t -",
    "lambda": "E block#1<, block#1< s, s a?, a? Return +, Return block#1>, a? t -, t block#1>, block#1> run",
    "lambdas": "E block#1<, block#1< s, s block#1>, block#1> Lambda#2, Lambda#2 block#2<, block#2< Lambda#3, Lambda#3 block#3<, block#3< t, t block#3>, block#3> go, go block#2>, block#2> run",
    "anonymous": "E ClassBody<, ClassBody< f, f block#1<, block#1< s, s block#1>, block#1> g, g block#2<, block#2< a, a a?, a? t +, t block#2>, a? block#2> -, block#2> ClassBody>, ClassBody> run",
    "for_each": "E ForEach!?, ForEach!? a +, a a?, a? Break +, Break N, a? b -, b b?, b? Continue +, Continue ForEach!?, b? print -, print ForEach!?, ForEach!? N -",
    "for": "E a?, a? b +, b b?, b? Continue +, Continue a?, b? s -, s Unary, Unary a?, a? N -",
    "do": "E s, s b?, b? Continue +, Continue a?, b? t -, t a?, a? s +, a? N -",
    "else_if": "E a?, a? s +, s N, a? b -, b b?, b? t +, t N, b? x -, x N",
    "or": "E a?, a? s +, a? b -, b b?, b? s -, b? N +, s N",
    "loops": "E a?, a? b +, b b?, b? s +, s b?, b? t -, t a?, a? N -",
    "rules": "E 1?, 1? s +, s N, 1? 2 -, 2 2?, 2? t +, t N, 2? x -, x N",
    "falls": "E 1?, 1? s +, s t, 1? 2 -, 2 2?, 2? t +, t x, 2? x -",
    "straight": "", "order": "", "cast": "",
    "itself": "E InstanceOf?, InstanceOf? s +, s N, InstanceOf? N -",
}


#: What leads the block that goes on behind a construct, where no edge leads to N.
_TAILS = {"try_return": "s", "try_inner": "t", "lambda": "run", "lambdas": "run", "anonymous": "run", "falls": "x"}


#: What is evaluated in each unit of a construct, in order; "*2" tells how many blocks have the unit, "@3" what is made for a loop.
_ORDER = {
    "try_return": "a | n Return | s | t*2", "try_nested": "a | n Return | s | t*2 | b*2 | x*2", "try_break": "a | b | Break | c | Continue | s | t*3", "try_inner": "a | b | Break | s | t",
    "lambda": "Lambda | s | a | n Return | t | run", "lambdas": "Lambda | s | Lambda#2 | Lambda#3 | t | go | run", "anonymous": "<constructor> | f | s | n Return | g | a | t | run",
    "for_each": f"xs ForEach@{desugar.ITERATOR_CALL} ForEach@{desugar.ITERATOR} | x | ForEach@{desugar.ITERATOR_READ} ForEach@{desugar.HAS_NEXT} | a | Break | b | Continue | x#2 print", "for": "0 i | a | i#2 Unary | b | Continue | s",
    "do": "s | b | Continue | t | a", "else_if": "a | s | b | t | x", "or": "a | b | s", "loops": "a | b | s | t", "rules": "s | t | x", "falls": "s | t | x", "straight": "s | a b Binary Assert | C",
    "order": "Assignment q 1 g 2 f Parentheses r Binary v", "cast": "ArrayAccess TypeCast z", "itself": "this InstanceOf | super s",
}


def _place(construct: str, name: str) -> int:
    """The number of a node of a construct by its name, literal or kind; the call of ``line`` is the first of all."""
    name, _, nth = name.partition("#")
    return numbered(FLOWS[construct], name)[int(nth or 1) - 1]


def _end(construct: str, told: str) -> str:
    """The SQL of an end of an edge, for a customer k."""
    if told in ("E", "N", "END"):
        return {"E": "'E', 0, 0, 0", "N": "'N', 0, 0, 0", "END": "'END', 0, 0, 0"}[told]
    asks = told.endswith("?")
    told = told.removesuffix("?")
    name, _, way = told.partition("'")
    digit = int(way or 0)
    for sign, what in (("<", desugar.ENTER), (">", desugar.LEAVE), ("!", desugar.HAS_NEXT)):
        if name.endswith(sign):
            name, digit = name.removesuffix(sign), what * 64
    return f"'', {_place(construct, name)}, {digit}, {int(asks)}"


def _edges_sql() -> str:
    order, rows = list(FLOWS), []
    for construct, told in _EDGES.items():
        for edge in filter(None, told.split(", ")):
            src, dst, *way = edge.split(" ")
            rows.append(f"({order.index(construct)}, {_end(construct, src)}, {_end(construct, dst)}, {({'+': chr(39) + 'true' + chr(39), '-': chr(39) + 'false' + chr(39)}[way[0]]) if way else 'NULL'})")
    open_ = ", ".join(str(order.index(c)) for c, told in _EDGES.items() if not told)
    tails = " ".join(f"WHEN {order.index(c)} THEN {_place(c, n)}" for c, n in _TAILS.items())
    unit = lambda s: f"2 * (CASE WHEN {s}d = 0 THEN k * 64 + {s}j ELSE -((k * 64 + {s}j + 1) * 1024 + {s}d) END) + {s}c"
    return _FLOW_BASE + f""", m(c, st, sj, sd, sc, dt, dj, dd, dc, branch) AS (VALUES {', '.join(rows)}),
    -- the statements of a method, its return at the end; a block goes on over constructs without an edge
    s AS (SELECT file_id, method, first, k, c, k * 64 AS unit FROM c UNION ALL SELECT file_id, method, first, NULL, NULL, {METHOD_IDS} + first * 8 + 3 FROM f),
    o AS (SELECT *, lag(c) OVER w AS before, lag(k * 64 + CASE c {tails} END) OVER w AS tail FROM s WINDOW w AS (PARTITION BY method ORDER BY k NULLS LAST)),
    l AS (SELECT *, last_value(CASE WHEN before IN ({open_}) THEN NULL ELSE coalesce(tail, unit) END IGNORE NULLS) OVER (PARTITION BY method ORDER BY k NULLS LAST) AS led FROM o),
    n AS (SELECT *, lead(unit) OVER (PARTITION BY method ORDER BY k NULLS LAST) AS next FROM l),
    e AS (SELECT file_id, first, CASE st WHEN 'E' THEN 2 * led ELSE {unit('s')} END AS src, CASE dt WHEN 'N' THEN 2 * next WHEN 'END' THEN {cfg.END} ELSE {unit('d')} END AS dst, branch FROM n JOIN m USING (c)
      UNION ALL SELECT file_id, first, 2 * led, {cfg.END}, NULL FROM n WHERE k IS NULL
      UNION ALL SELECT file_id, first, {cfg.START}, 2 * arg_min(unit, coalesce(k, 1e18)), NULL FROM n GROUP BY ALL)
    SELECT file_id, {METHOD_IDS} + first * 8 + 1 AS graph_id, src, dst, branch FROM e"""


_FLOW_BASE = _BASE.replace(f"c_custkey % {len(CONSTRUCTS)}", f"c_custkey % {len(FLOWS)}")


def _members_sql() -> str:
    rows = []
    for n, (construct, told) in enumerate((c, _ORDER[c]) for c in FLOWS):
        for unit in ["line", *told.split(" | ")]:
            unit, _, copies = unit.partition("*")
            for pos, name in enumerate(unit.split(" ")):
                name, _, what = name.partition("@")
                rows.append(f"({n}, {0 if name == 'line' else _place(construct, name)}, {int(what or 0)}, {pos}, {int(copies or 1)})")
    return _FLOW_BASE + f""", m(c, j, what, pos, copies) AS (VALUES {', '.join(rows)})
    SELECT file_id, CASE WHEN what = 0 THEN k * 64 + j ELSE -((k * 64 + j + 1) * 1024 + what * 64) END AS node_id, pos::BIGINT AS pos, copies::BIGINT AS copies FROM c JOIN m USING (c)
    UNION ALL SELECT file_id, {METHOD_IDS} + first * 8 + x, 4 - x, 1 FROM f, (VALUES (3), (4)) v(x)"""


def _elements_sql() -> str:
    loop, read = list(FLOWS).index("for_each"), list(FLOWS).index("cast")
    at = lambda name: _place("for_each", name)
    loops = " UNION ALL ".join(f"SELECT file_id, k * 64 + {at(n)}, {a}, {b} FROM c WHERE c = {loop}" for n, a, b in (("xs", "true", "false"), ("x", "false", "false"), ("x#2", "false", "true")))
    # another read of the list between two loops hands it on from one to the other
    return _FLOW_BASE + f""", o AS (SELECT *, bool_or(c = {loop}) OVER (PARTITION BY method ORDER BY k) AS behind, bool_or(c = {loop}) OVER (PARTITION BY method ORDER BY k DESC) AS ahead FROM c)
    SELECT file_id, k * 64 + {_place("cast", "xs")} AS node_id, false AS is_source, false AS is_sink FROM o WHERE c = {read} AND behind AND ahead UNION ALL {loops}"""


SQL = {
    "customer_edges": _edges_sql(),
    "customer_members": _members_sql(),
    "customer_elements": _elements_sql(),
    "customer_lambdas": _FLOW_BASE + ", m(c, kind, method_name, n) AS (VALUES " + ", ".join(f"({list(FLOWS).index(c)}, '{k}', '{name}', {n})" for c, k, name, n in (("lambda", "Lambda", "run", 1), ("lambdas", "Lambda", "run", 3), ("anonymous", "MethodDeclaration", "f", 1), ("anonymous", "MethodDeclaration", "g", 1))) + """)
        SELECT method, kind, method_name, sum(n)::BIGINT AS n FROM c JOIN m USING (c) GROUP BY ALL UNION ALL SELECT method, 'MethodDeclaration', 'segment', 1 FROM f UNION ALL SELECT DISTINCT concat('keep-', nation), 'MethodDeclaration', 'keep', 1 FROM f""",
    "customer_instances": _FLOW_BASE + f"""SELECT method, role, count(*) AS n FROM c, (VALUES ('target'), ('select')) v(role) WHERE c = {list(FLOWS).index("itself")} GROUP BY ALL""",
    "customer_summaries": _FLOW_BASE + f""", o AS (SELECT *, bool_or(c = {list(FLOWS).index("for_each")}) OVER (PARTITION BY method ORDER BY k DESC) AS ahead FROM c)
        SELECT a.file_id, a.k * 64 + {_place("for_each", "xs")} AS source_id, sum(CASE WHEN b.c = {list(FLOWS).index("for_each")} THEN 3 ELSE 1 END)::BIGINT AS participants, count(*) FILTER (b.c = {list(FLOWS).index("for_each")}) AS sinks
        FROM c a JOIN o b ON a.method = b.method AND b.k >= a.k AND (b.c = {list(FLOWS).index("for_each")} OR (b.c = {list(FLOWS).index("cast")} AND b.ahead)) WHERE a.c = {list(FLOWS).index("for_each")} GROUP BY ALL""",
    "customer_fields": _FLOW_BASE + ", m(c, j, name) AS (VALUES " + ", ".join(f"({list(FLOWS).index(c)}, {_place(c, n)}, '{n}')" for c, n in (("for_each", "xs"), ("cast", "xs"), ("order", "q"), ("order", "v"))) + """),
        t AS (SELECT file_id, k * 64 + j AS node_id, name, CASE WHEN name = 'v' OR (name = 'q' AND nation % 2 = 0) THEN concat('shop.Lib', nation) ELSE concat('shop.Region', n_regionkey) END AS owner FROM c JOIN m USING (c) JOIN nation ON n_nationkey = nation)
        SELECT file_id, node_id, owner, md5(concat(owner, '#', name, '#int')) AS field_id FROM t""",
    "customer_callback_sinks": _BASE + _at("callback", 5),
    "customer_witnesses": _FLOW_BASE + " SELECT file_id, k * 64 + {a} AS source_id, k * 64 + {c} AS sink_id, concat(k * 64 + {a}, ',', k * 64 + {b}, ',', k * 64 + {c}) AS path FROM c WHERE c = {n}".format(
        a=_place("for_each", "xs"), b=_place("for_each", "x"), c=_place("for_each", "x#2"), n=list(FLOWS).index("for_each")),
    "customer_graphs": _graphs("bb, cn, ex, 0::BIGINT AS invalid"),
    "customer_drawings": _graphs("bb AS boxes, cn AS diamonds, 1 + bb + 2 * cn AS arrows, cn AS trues, cn AS falses"),
    "customer_expressions": _sums(_EXPRESSIONS, ("expr_kind",)),
    "customer_statements": _sums(_STATEMENTS, ("stmt_kind",)),
    "customer_guards": _sums(_GUARDS, ("guard_kind",)),
    "customer_calls": _sums(_CALLS, ("kind",), ("n", "args")),
    "customer_variables": _sums(_VARIABLES, ("variable_kind", "position")),
    "customer_callables": _BASE + f"""SELECT method, 'segment' AS method_name, 'int' AS return_type, 1 AS n FROM f UNION ALL SELECT DISTINCT concat('keep-', nation), 'keep', 'int', 1 FROM f
        UNION ALL SELECT method, '<lambda>', 'void', count(*) FROM c WHERE c = {list(CONSTRUCTS).index("callback")} GROUP BY method""",
    "customer_accesses": _sums(_ACCESSES, ("is_lvalue", "is_rvalue")),
    "customer_operators": _sums(_OPERATORS, ("operator",), ("n", "literals")),
    "customer_receivers": _sums(_RECEIVERS),
    "customer_filled": _sums(_FILLED, (), ("n", "firsts")),
    "customer_folds": _FOLDS,
    # a guard that shuts both ways lets control flow no further
    "customer_uris": _BASE + f"""SELECT file_id, k * 64 + 2 AS node_id, 'https://a' AS fixed
        FROM (SELECT *, bool_or(c = {list(CONSTRUCTS).index("uri_guarded")}) OVER (PARTITION BY method ORDER BY k) AS shut FROM c) WHERE c = {list(CONSTRUCTS).index("uri")} AND NOT shut""",
    # a for-each between two callbacks of a method reads the list that flows on from one to the other
    "customer_callbacks": _BASE + " UNION ALL ".join(f"SELECT file_id, node_id, {a} AS is_source, {b} AS is_sink FROM ({_at('callback', n)})" for n, a, b in ((2, "true", "false"), (4, "false", "false"), (6, "false", "true"))) + f"""
        UNION ALL SELECT file_id, k * 64 + 3, false, false FROM (SELECT *, bool_or(c = {list(CONSTRUCTS).index("callback")}) OVER (PARTITION BY method ORDER BY k) AS behind, bool_or(c = {list(CONSTRUCTS).index("callback")}) OVER (PARTITION BY method ORDER BY k DESC) AS ahead FROM c)
        WHERE c = {list(CONSTRUCTS).index("for_each")} AND behind AND ahead""",
    "customer_between": _BASE + f"""SELECT file_id, node_id, true AS is_source, false AS is_sink FROM ({_at('between', 3)}) UNION ALL SELECT file_id, node_id, false, true FROM ({_at('between', 2)})
        UNION ALL SELECT DISTINCT file_id, {LIBRARY_IDS} + nation * 8 + x, false, false FROM c, (VALUES (2), (4)) v(x) WHERE c = {list(CONSTRUCTS).index("between")}""",
}
