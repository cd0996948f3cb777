"""Data flow with user-defined sources, sinks, steps and barriers, within and across methods."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import durable
from . import cfg, graph
from .calls import matched_participants
from .models import call_arguments, declaration_of
from .scope import flow_before
from .traits import var_access
from .tree import KEY, chains, lambda_results, nearest_in, parents


def nothing(nodes: DataFrame) -> Column:
    return F.lit(False)


@dataclass(frozen=True)
class FlowSpec:
    """What to follow: predicates over a ``nodes`` table, as columns.

    ``step`` adds edges to those of plain data flow; it gets the nodes and returns
    ``(file_id, src, dst)``.  ``is_barrier_guard`` gets the nodes and returns two columns: whether a condition
    lets nothing through when it is true, and when it is false.
    """

    is_source: Callable[[DataFrame], Column]
    is_sink: Callable[[DataFrame], Column]
    is_barrier: Callable[[DataFrame], Column] = nothing
    step: Callable[[DataFrame], DataFrame] | None = None
    is_barrier_guard: Callable[[DataFrame], tuple[Column, Column]] | None = None

    def edges(self, nodes: DataFrame) -> DataFrame:
        found = value_edges(nodes)
        if self.step is not None:
            found = found.unionByName(self.step(nodes).select("file_id", "src", "dst", F.lit("additional").alias("kind")))
        bars = nodes.where(self.is_barrier(nodes)).select("file_id", F.col("node_id").alias("dst"))
        return found.join(bars, ["file_id", "dst"], "left_anti").join(bars.withColumnRenamed("dst", "src"), ["file_id", "src"], "left_anti")


@dataclass(frozen=True)
class TaintSpec(FlowSpec):
    """A :class:`FlowSpec` that also follows what keeps part of a value: string addition, and calls named in ``through``."""

    through: tuple[str, ...] = ()
    sanitizers: tuple[str, ...] = field(default=())

    def edges(self, nodes: DataFrame) -> DataFrame:
        bars = nodes.where(F.col("kind").isin("MethodInvocation") & F.col("method_type.name").isin(*self.sanitizers)).select("file_id", F.col("node_id").alias("dst"))
        found = super().edges(nodes).unionByName(taint_edges(nodes, self.through))
        return found.join(bars, ["file_id", "dst"], "left_anti")


def value_edges(nodes: DataFrame) -> DataFrame:
    """``(file_id, src, dst, kind)``: steps that keep a value whole.

    A value to the variable that it initialises or is assigned to, that write along
    the reads that see it, the right side of a compound assignment to its variable, through casts
    and parentheses, from a ternary's branches, and from a lambda's result to the lambda.
    """
    whole = F.when(F.col("parent_kind").isin("TypeCast", "Parentheses") | ((F.col("parent_kind") == "Ternary") & F.col("role").isin("true_part", "false_part")), "through")
    held = F.when(((F.col("parent_kind") == "VariableDeclaration") & (F.col("role") == "initializer")) | ((F.col("parent_kind") == "Assignment") & (F.col("role") == "assignment")), "write")
    direct = parents(nodes, "kind").withColumn("step", F.coalesce(held, whole)).where("step is not null").select("file_id", F.col("node_id").alias("src"), F.col("parent_id").alias("dst"), F.col("step").alias("kind"))
    compound = nodes.where("kind = 'CompoundAssignment'").select("file_id", F.col("node_id").alias("parent_id"))
    target = nodes.where("role = 'variable' and kind = 'Identifier'").select("file_id", "parent_id", F.col("node_id").alias("dst"))
    mixed = nodes.where("role = 'assignment'").select("file_id", "parent_id", F.col("node_id").alias("src")).join(compound, ["file_id", "parent_id"], "left_semi").join(target, ["file_id", "parent_id"]).select("file_id", "src", "dst", F.lit("write").alias("kind"))
    seen = flow_before(nodes).select("file_id", F.col("seen_id").alias("src"), F.col("node_id").alias("dst"), F.lit("read").alias("kind"))
    result = lambda_results(nodes).select("file_id", F.col("node_id").alias("src"), F.col("lambda_id").alias("dst"), F.lit("result").alias("kind"))
    return direct.unionByName(mixed).unionByName(seen).unionByName(result).dropDuplicates(["file_id", "src", "dst"])


def element_edges(nodes: DataFrame) -> DataFrame:
    """What a for-each goes over, to its variable: a ``step`` for a flow specification."""
    heads = nodes.where("role in ('control', 'iterable')").groupBy("file_id", "parent_id").agg(F.max(F.when(F.col("role") == "iterable", F.col("node_id"))).alias("src"), F.max(F.when(F.col("role") == "control", F.col("node_id"))).alias("dst"))
    return heads.where("src is not null and dst is not null").select("file_id", "src", "dst")


def taint_edges(nodes: DataFrame, through: tuple[str, ...]) -> DataFrame:
    """Operands of a string addition to it, and the receiver and arguments of calls that pass taint on."""
    p = parents(nodes, "kind", "operator", "type", "method_type")
    add = p.where("parent_kind = 'Binary' and parent_operator = 'Addition' and parent_type = 'java.lang.String'")
    passed = p.where(F.col("parent_kind").isin("MethodInvocation", "NewClass") & F.col("role").isin("select", "argument") & F.col("parent_method_type.name").isin(*through))
    return add.unionByName(passed).select("file_id", F.col("node_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("taint").alias("kind"))


def data_flow_nodes(nodes: DataFrame) -> DataFrame:
    """Where data can be: expressions and parameters; local declarations are not."""
    return nodes.where("role = 'parameter' or kind in ('Identifier', 'Literal', 'MethodInvocation', 'NewClass', 'Binary', 'Unary', 'Ternary', 'TypeCast', 'Parentheses', 'Lambda', 'Assignment')").select(*KEY, F.when(F.col("role") == "parameter", "parameter").otherwise("expression").alias("df_kind"))


def _rooted(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("file_id", "root")


def live_code(nodes: DataFrame, guard: Callable[[DataFrame], tuple[Column, Column]] | None = None) -> DataFrame:
    """``(file_id, node_id)`` of all nodes but :func:`dead_code`."""
    nodes = durable(nodes)
    return nodes.select(*KEY).join(dead_code(nodes, nodes, guard), list(KEY), "left_anti")


def dead_code(nodes: DataFrame, of: DataFrame, guard: Callable[[DataFrame], tuple[Column, Column]] | None = None) -> DataFrame:
    """``(file_id, node_id)`` of those of ``of(file_id, node_id)`` that control flow never reaches: after a return, behind a literal
    condition or behind a barrier guard, and what lies inside.  What belongs to no body is live.

    Control flow is built for the files that have some of ``of`` and something that can stop it, and only what is asked for climbs to its units.
    """
    files = durable(nodes.where(cfg.may_stop(nodes, guard)).select("file_id").distinct().join(of.select("file_id").distinct(), "file_id", "left_semi"))
    if files.isEmpty():
        return files.join(of.select(*KEY), "file_id").select(*KEY)
    whole, live = cfg.live_units(durable(nodes.join(files, "file_id", "left_semi")), guard)
    wanted = whole.join(of.select(*KEY).distinct(), list(KEY), "left_semi")
    chained = chains(whole, wanted, include_self=True, columns=("kind", "role", "is_condition"), keep=())
    units = F.explode(F.filter("chain", lambda a: a["anc_is_condition"].isNotNull()))
    up = chained.select(*KEY, "chain", units.alias("unit"))
    inside = up.select(*KEY, F.col("unit.anc_id").alias("unit_id"), F.filter("chain", lambda a: a["up"] >= F.col("unit.up")).alias("chain")).where(cfg.graph_block().isNotNull())
    return inside.join(live.select("file_id", F.col("node_id").alias("unit_id")), ["file_id", "unit_id"], "left_anti").select(*KEY).distinct()


def _steps(nodes: DataFrame, spec: FlowSpec) -> DataFrame:
    return _rooted(spec.edges(nodes)).select("root", "src", "dst")


def _among(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The steps between nodes of ``keep(file_id, node_id)``."""
    for end in ("src", "dst"):
        edges = edges.join(keep.select(F.col("file_id").alias("root"), F.col("node_id").alias(end)), ["root", end], "left_semi")
    return durable(edges)


def _ends(nodes: DataFrame, spec: FlowSpec) -> list[DataFrame]:
    """Sources and sinks, as ``(root, node)``."""
    return [nodes.where(test(nodes)).select(F.col("file_id").alias("root"), F.col("node_id").alias("node")) for test in (spec.is_source, spec.is_sink)]


def _between(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``(root, node)`` on the flows along ``edges(root, src, dst)`` from sources to sinks."""
    ahead = graph.reach(edges, sources, doublings=2)
    live = edges.join(ahead.withColumnRenamed("node", "src"), ["root", "src"], "left_semi")
    back = graph.reach(graph.backward(live), sinks.join(ahead, ["root", "node"], "left_semi"), doublings=2)
    return ahead.join(back, ["root", "node"], "left_semi")


def _flows(nodes: DataFrame, spec: FlowSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(edges, on, dead)``: the steps, what lies on flows along them, and what of that is :func:`dead_code`.

    Dead code takes flows away and adds none, so only what lies on a flow is asked whether it is dead.
    """
    edges = durable(_steps(nodes, spec))
    on = durable(_between(edges, *_ends(nodes, spec)).select(F.col("root").alias("file_id"), F.col("node").alias("node_id")))
    return edges, on, durable(dead_code(nodes, on, spec.is_barrier_guard))


def _local_graph(nodes: DataFrame, spec: FlowSpec, reachable: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The nodes that count, and the steps ``(root, src, dst)`` between them."""
    if reachable is None:
        nodes = durable(nodes)
        edges, on, dead = _flows(nodes, spec)
        keep = durable(on.join(dead, list(KEY), "left_anti"))
    else:
        edges, keep = _steps(nodes, spec), durable(reachable.select(*KEY).distinct())
    return nodes.join(keep, list(KEY), "left_semi"), _among(edges, keep)


def local_marks(nodes: DataFrame, spec: FlowSpec, reachable: DataFrame | None = None) -> DataFrame:
    """``(file_id, node_id, is_source, is_sink)`` of every node on a flow from a source to a sink of its file.

    Only code in ``reachable(file_id, node_id)`` counts; None stands for :func:`live_code` under the specification's barrier guards.
    """
    if reachable is None:
        alive = nodes = durable(nodes)
        edges, on, dead = _flows(nodes, spec)
        if not dead.isEmpty():
            keep = durable(on.join(dead, list(KEY), "left_anti"))
            alive, edges, on = nodes.join(keep, list(KEY), "left_semi"), _among(edges, keep), None
    else:
        (alive, edges), on = _local_graph(nodes, spec, reachable), None
    sources, sinks = _ends(alive, spec)
    on = _between(edges, sources, sinks) if on is None else on.select(F.col("file_id").alias("root"), F.col("node_id").alias("node"))
    marked = on.join(sources.withColumn("is_source", F.lit(True)), ["root", "node"], "left").join(sinks.withColumn("is_sink", F.lit(True)), ["root", "node"], "left")
    return marked.select(F.col("root").alias("file_id"), F.col("node").alias("node_id"), F.coalesce("is_source", F.lit(False)).alias("is_source"), F.coalesce("is_sink", F.lit(False)).alias("is_sink"))


def _summary_pairs(steps: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``(root, node, is_sink)``: what lies on the flows along ``steps(src, dst)`` from each of ``sources(node)`` to ``sinks(node)``."""
    ahead = durable(graph.reach(steps, sources.select(F.col("node").alias("root"), "node"), doublings=2))
    back = graph.reach(graph.backward(steps), ahead.join(sinks, "node", "left_semi").select("root", "node"), doublings=2)
    return ahead.join(back, ["root", "node"], "left_semi").join(sinks.withColumn("is_sink", F.lit(True)), "node", "left").withColumn("is_sink", F.coalesce("is_sink", F.lit(False)))


def _summary_graph(nodes: DataFrame, spec: FlowSpec, reachable: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps between nodes that are named with their file, sources and sinks."""
    alive, edges = _local_graph(nodes, spec, reachable)
    named = lambda c: F.struct(F.col("root").alias("file_id"), F.col(c).alias("node_id")).alias(c)
    ends = [alive.where(test(alive)).select(F.struct("file_id", "node_id").alias("node")).distinct() for test in (spec.is_source, spec.is_sink)]
    return durable(edges.select(named("src"), named("dst")).distinct()), *ends


def local_summaries(nodes: DataFrame, spec: FlowSpec, reachable: DataFrame | None = None) -> DataFrame:
    """``(file_id, source_id, node_id, is_sink)``: for each source apart, what lies on its flows to the sinks of its file, in code that counts as for
    :func:`local_marks`; sources without a sink have no rows."""
    on = _summary_pairs(*_summary_graph(nodes, spec, reachable))
    return on.select("root.file_id", F.col("root.node_id").alias("source_id"), "node.node_id", "is_sink")


def local_summary_counts(nodes: DataFrame, spec: FlowSpec, reachable: DataFrame | None = None) -> DataFrame:
    """``(file_id, source_id, participants, sinks)``: how many rows :func:`local_summaries` has for each source, and how many of them are sinks.

    Where flow only branches out, what a source reaches is a tree, and the counts are sums over it (:func:`graph.subtree_sums`), so that a long row of
    sources is not expanded into all pairs.  Sources whose flow meets itself again have their nodes counted one by one.
    """
    steps, sources, sinks = _summary_graph(nodes, spec, reachable)
    met = steps.groupBy(F.col("dst").alias("node")).count().where("count > 1").select("node")
    one = F.lit(0).alias("root")
    knotted = durable(graph.reach(graph.backward(steps).select(one, "src", "dst"), met.select(one, "node")).select("node"))
    free = durable(steps.join(knotted.withColumnRenamed("node", "src"), "src", "left_anti"))
    sinks = durable(sinks)
    every = free.select(F.col("src").alias("node")).unionByName(free.select(F.col("dst").alias("node"))).unionByName(sources).distinct()
    flagged = every.join(sinks.withColumn("amount", F.lit(1)), "node", "left").withColumn("amount", F.coalesce("amount", F.lit(0)).cast("bigint"))
    jumps, endless = graph.tree_jumps(free.select(F.col("dst").alias("node"), F.col("src").alias("before")))
    reached = graph.subtree_sums(jumps, flagged)
    on = graph.subtree_sums(jumps, reached.select("node", (F.col("amount") > 0).cast("bigint").alias("amount")))
    odd = knotted.unionByName(endless).distinct()
    told = sources.join(odd, "node", "left_anti").join(on.withColumnRenamed("amount", "participants"), "node").join(reached.withColumnRenamed("amount", "sinks"), "node").where("sinks > 0")
    left = durable(sources.join(odd, "node", "left_semi"))
    if not left.isEmpty():
        pairs = _summary_pairs(steps, left, sinks).groupBy(F.col("root").alias("node")).agg(F.count("*").alias("participants"), F.count_if("is_sink").alias("sinks"))
        told = told.unionByName(pairs)
    return told.select("node.file_id", F.col("node.node_id").alias("source_id"), "participants", "sinks")


def local_paths(nodes: DataFrame, spec: FlowSpec, depth: int, reachable: DataFrame | None = None) -> DataFrame:
    """``(file_id, source_id, path, sink_id)``: the simple paths of ``depth`` steps at most from a source to a sink of its file, in code
    that counts as for :func:`local_marks`.  A source that is a sink is a path of one node."""
    alive, edges = _local_graph(nodes, spec, reachable)
    named = lambda c: F.struct(F.col("root").alias("file_id"), F.col(c).alias("node_id")).alias(c)
    ends = [alive.where(test(alive)).select(F.struct("file_id", "node_id").alias("node")) for test in (spec.is_source, spec.is_sink)]
    found = graph.paths(edges.select(named("src"), named("dst")), *ends, depth)
    return found.select("source.file_id", F.col("source.node_id").alias("source_id"), F.transform("path", lambda x: x["node_id"]).alias("path"), F.col("sink.node_id").alias("sink_id"))


def witnesses(nodes: DataFrame, spec: FlowSpec, reachable: DataFrame | None = None) -> DataFrame:
    """``(file_id, source_id, path, sink_id)``: one shortest path to each sink that a source of its file flows to, in code that counts as for
    :func:`local_marks`; see :func:`graph.shortest_paths`."""
    alive, edges = _local_graph(nodes, spec, reachable)
    named = lambda c: F.struct(F.col("root").alias("file_id"), F.col(c).alias("node_id")).alias(c)
    ends = [alive.where(test(alive)).select(F.struct("file_id", "node_id").alias("node")) for test in (spec.is_source, spec.is_sink)]
    found = graph.shortest_paths(edges.select(named("src"), named("dst")), *ends)
    return found.select("sink.file_id", F.col("source.node_id").alias("source_id"), F.transform("path", lambda x: x["node_id"]).alias("path"), F.col("sink.node_id").alias("sink_id"))


def files_with_flow(nodes: DataFrame, marks: DataFrame, wanted: bool = True) -> DataFrame:
    """Files in which some node lies on a flow, or (``wanted=False``) none does."""
    return nodes.select("file_id").distinct().join(marks.select("file_id").distinct(), "file_id", "left_semi" if wanted else "left_anti")


# --- across methods -------------------------------------------------------------------------------------


def argument_edges(arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """Arguments to the parameters that they fill: an equi-join on (method, position).

    ``arguments(method, position, node, call)``, ``parameters(method, position, node)``.
    """
    p = parameters.select("method", "position", F.col("node").alias("dst"))
    return arguments.join(p, ["method", "position"]).select(F.col("node").alias("src"), "dst", F.lit("argument").alias("kind"), "call")


def return_edges(returns: DataFrame, calls: DataFrame) -> DataFrame:
    """Returned values to the calls of their method: ``returns(method, node)``, ``calls(method, call)``."""
    return returns.join(calls, "method").select(F.col("node").alias("src"), F.col("call").alias("dst"), F.lit("return").alias("kind"), "call")


def returned_values(nodes: DataFrame) -> DataFrame:
    """``(file_id, node_id, method_type)``: expressions that a method declaration returns; those of lambdas are not among them."""
    value = parents(nodes, "kind").where("parent_kind = 'Return'").select(*KEY, "parent_id")
    owner = nearest_in(chains(nodes, value, columns=("kind", "method_type")), lambda a: a["anc_kind"].isin("Lambda", "MethodDeclaration"), "kind", "method_type")
    return owner.where("found_kind = 'MethodDeclaration' and found_method_type is not null").select(*KEY, F.col("found_method_type").alias("method_type"))


def global_edges(nodes: DataFrame, spec: FlowSpec, type_variables: DataFrame | None = None) -> DataFrame:
    """``(src, dst, kind, call)`` over all files; nodes are named ``(file_id, node_id)``.

    The local steps of every node, arguments to the parameters that they fill, and returned values to the calls. Calls meet the
    declared method of theirs (:func:`models.declaration_of`); ``type_variables(method_type, type_variables)`` of the
    declared methods that have some.  A varargs parameter takes all arguments from its position on.
    """
    nodes = durable(nodes)
    at = F.struct("file_id", "node_id")
    local = spec.edges(nodes).select(F.struct("file_id", F.col("src").alias("node_id")).alias("src"), F.struct("file_id", F.col("dst").alias("node_id")).alias("dst"), F.lit("local").alias("kind"))
    declared = nodes.where("kind = 'MethodDeclaration' and method_type is not null").select(*KEY, "method_type")
    known = declared.select("method_type").distinct()
    known = known.withColumn("type_variables", F.array().cast("array<string>")) if type_variables is None else known.join(type_variables, "method_type", "left").withColumn("type_variables", F.coalesce("type_variables", F.array().cast("array<string>")))
    called = nodes.where("kind in ('MethodInvocation', 'NewClass') and method_type is not null").select(*KEY, "method_type")
    names = durable(declaration_of(called, known))
    given = call_arguments(nodes).where("position >= 0").join(names, "method_type")
    last = F.size("declaration.params") - 1
    filled = F.when(F.array_contains("declaration.flags", "Varargs"), F.least("position", last)).otherwise(F.col("position"))
    arguments = given.select(F.col("declaration").alias("method"), filled.alias("position"), at.alias("node"), F.struct("file_id", F.col("call_id").alias("node_id")).alias("call"))
    slots = nodes.where("role = 'parameter'").select("file_id", "node_id", F.col("ordinal").alias("position"), F.col("parent_id").alias("of"))
    parameters = slots.join(declared.select("file_id", F.col("node_id").alias("of"), "method_type"), ["file_id", "of"]).select(F.col("method_type").alias("method"), "position", at.alias("node"))
    returns = returned_values(nodes).select(F.col("method_type").alias("method"), at.alias("node"))
    calls = called.join(names, "method_type").select(F.col("declaration").alias("method"), at.alias("call"))
    between = argument_edges(arguments, parameters).unionByName(return_edges(returns, calls))
    return local.withColumn("call", F.lit(None).cast(between.schema["call"].dataType)).unionByName(between).distinct()


def global_marks(nodes: DataFrame, spec: FlowSpec, type_variables: DataFrame | None = None) -> DataFrame:
    """``(file_id, node_id, is_source, is_sink)`` of every node on a flow from a source to a sink, through calls and over files.

    A flow that entered a method by a call leaves it by that call (:mod:`calls`).
    """
    nodes = durable(nodes)
    at = F.struct("file_id", "node_id").alias("node")
    sources, sinks = nodes.where(spec.is_source(nodes)).select(at).distinct(), nodes.where(spec.is_sink(nodes)).select(at).distinct()
    on = matched_participants(durable(global_edges(nodes, spec, type_variables)), sources, sinks)
    marked = on.join(sources.withColumn("is_source", F.lit(True)), "node", "left").join(sinks.withColumn("is_sink", F.lit(True)), "node", "left")
    return marked.select("node.file_id", "node.node_id", F.coalesce("is_source", F.lit(False)).alias("is_source"), F.coalesce("is_sink", F.lit(False)).alias("is_sink"))


def shortcut_edges(arguments: DataFrame) -> DataFrame:
    """Any argument to its call: more than what flows, to be pruned by the steps that do."""
    return arguments.select(F.col("node").alias("src"), F.col("call").alias("dst"), F.lit("shortcut").alias("kind"), "call")


def prune_shortcuts(edges: DataFrame, real: DataFrame) -> DataFrame:
    """Drop the shortcuts that are no ``real(src, dst)`` step."""
    return edges.where("kind <> 'shortcut'").unionByName(edges.where("kind = 'shortcut'").join(real.select("src", "dst").distinct(), ["src", "dst"], "left_semi").select(edges.columns))


def summary(marked: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """``(node, is_source, is_sink, is_participant)``, false where a node takes no part."""
    return all_nodes.select("node").join(marked, "node", "left").select("node", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_source", "is_sink", "is_participant")])


def labels(marked: DataFrame) -> DataFrame:
    """``(node, labels)``: 'source', 'sink' or both for what the flow starts from and ends in, none for the rest."""
    return marked.select("node", F.array_compact(F.array(F.when(F.col("is_source"), "source"), F.when(F.col("is_sink"), "sink"))).alias("labels"))


def uses_of(nodes: DataFrame) -> DataFrame:
    """Reads that data flow can continue from."""
    return var_access(nodes).where("is_rvalue")
