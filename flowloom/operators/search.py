"""Searches over calls and flows, and how their results are told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import durable
from ..functions.matching import any_matches, matching_calls, method_matches
from . import flow, graph
from .tree import KEY, parents


def find_methods(nodes: DataFrame, pattern: str, hierarchy: DataFrame | None = None, follow: str = "none") -> DataFrame:
    """``(file_id, node_id)`` of matching calls, constructors and member references; with ``follow``
    'data' or 'taint', whatever their values reach as well."""
    hits = matching_calls(nodes.where("kind in ('MethodInvocation', 'NewClass', 'MemberReference')"), pattern, hierarchy).select(*KEY)
    if follow == "none":
        return hits
    edges = flow.value_edges(nodes)
    if follow == "taint":
        edges = edges.unionByName(flow.taint_edges(nodes, PASSES_TAINT))
    seeds = hits.select(F.col("file_id").alias("root"), F.col("node_id").alias("node"))
    found = graph.reach(edges.select(F.col("file_id").alias("root"), "src", "dst"), seeds)
    return found.select(F.col("root").alias("file_id"), F.col("node").alias("node_id"))


def find_declarations(nodes: DataFrame, pattern: str) -> DataFrame:
    """Method declarations that match."""
    return nodes.where("kind = 'MethodDeclaration'").where(method_matches(F.col("method_type"), pattern)).select(*KEY)


def call_table(calls: DataFrame, source_file: Column, pattern: str) -> DataFrame:
    """The tabular result of a search: five strings a call."""
    m = F.col("method_type")
    return calls.where(method_matches(m, pattern)).select(
        source_file.alias("sourceFile"),
        F.concat(m["declaring"], F.lit(" "), m["name"], F.lit("("), F.array_join(m["params"], ", "), F.lit(")")).alias("method"),
        m["declaring"].alias("className"),
        m["name"].alias("methodName"),
        F.array_join(m["params"], ", ").alias("argumentTypes"),
    )


def uses_invocation(calls: DataFrame, patterns: list[str]) -> DataFrame:
    """Files with a call that one of the patterns matches."""
    return calls.where(any_matches(F.col("method_type"), patterns)).select("file_id").distinct()


def uses_all_invocations(calls: DataFrame, patterns: list[str]) -> DataFrame:
    """Files in which every pattern has a matching call: a relational division."""
    hit = F.array_compact(F.array(*[F.when(method_matches(F.col("method_type"), p), F.lit(i)) for i, p in enumerate(patterns)]))
    met = calls.select("file_id", F.explode(hit).alias("i")).groupBy("file_id").agg(F.count_distinct("i").alias("n"))
    return met.where(F.col("n") == len(set(patterns))).select("file_id")


def flow_between(edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """``(node, is_source, is_sink, is_participant)`` of what lies between matching starts and ends."""
    on = graph.participants(edges, starts, ends, depth)
    a = starts.select("node", F.lit(True).alias("is_source")).distinct()
    b = ends.select("node", F.lit(True).alias("is_sink")).distinct()
    return on.join(a, "node", "left").join(b, "node", "left").select("node", F.coalesce("is_source", F.lit(False)).alias("is_source"), F.coalesce("is_sink", F.lit(False)).alias("is_sink"), F.lit(True).alias("is_participant"))


#: What a method may be asked for: its receiver, its arguments or both.
TARGETS = {"Select": ("select",), "Arguments": ("argument",), "Both": ("select", "argument")}
#: Calls that pass taint from receiver and arguments on, where no model says so.
PASSES_TAINT = ("concat", "substring", "trim", "toLowerCase", "toUpperCase", "toString")


def flow_between_methods(nodes: DataFrame, start: str, end: str, target: str = "Both", kind: str = "Data", start_types: DataFrame | None = None, end_types: DataFrame | None = None) -> DataFrame:
    """``(file_id, node_id, is_source, is_sink)``: flow from calls that match ``start`` to the ``target`` of calls that match ``end``.

    The patterns are those of :func:`find_methods`; ``*_types``, where given, let overrides match.  Follows data or taint,
    through calls and over files.  Another target or kind is an error.
    """
    if target not in TARGETS or kind not in ("Data", "Taint"):
        raise ValueError(f"unknown target or kind of flow: {target}, {kind}")
    nodes = durable(nodes)
    calls = nodes.where("kind in ('MethodInvocation', 'NewClass')")
    starts = matching_calls(calls, start, start_types).select(*KEY, F.lit(True).alias("starts_here"))
    ends = matching_calls(calls, end, end_types).select("file_id", F.col("node_id").alias("parent_id"))
    into = nodes.where(F.col("role").isin(*TARGETS[target])).join(ends, ["file_id", "parent_id"]).select(*KEY, F.lit(True).alias("ends_here"))
    told = nodes.join(starts.distinct(), list(KEY), "left").join(into.distinct(), list(KEY), "left")
    here = lambda c: lambda n: F.coalesce(c, F.lit(False))
    spec = flow.TaintSpec(here("starts_here"), here("ends_here"), through=PASSES_TAINT) if kind == "Taint" else flow.FlowSpec(here("starts_here"), here("ends_here"))
    return flow.global_marks(told, spec)


def secure_scheme(c: Column) -> Column:
    """A literal with http:// at its start gets https://."""
    return F.when(c.startswith("http://"), F.concat(F.lit("https://"), F.substr(c, F.lit(8)))).otherwise(c)


def insecure_uri_literals(nodes: DataFrame) -> DataFrame:
    """``(file_id, node_id, fixed)``: http literals that flow into URI.create, with what they should be.

    The left side of any binary passes the value on; a condition that calls String.replace lets nothing through, whatever it says, nor what follows.
    """
    p = parents(nodes, "kind", "method_type", "operator")

    def left(n: DataFrame) -> DataFrame:
        return parents(n, "kind").where("parent_kind = 'Binary' and role = 'left'").select("file_id", F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))

    sink = p.where("parent_kind = 'MethodInvocation' and role = 'argument' and parent_method_type.declaring = 'java.net.URI' and parent_method_type.name = 'create'").select(*KEY, F.lit(True).alias("to_uri"))
    def replaces(n: DataFrame) -> tuple[Column, Column]:
        m = F.coalesce((F.col("method_type.declaring") == "java.lang.String") & (F.col("method_type.name") == "replace"), F.lit(False))
        return m, m

    spec = flow.FlowSpec(lambda n: (F.col("kind") == "Literal") & F.coalesce(F.col("literal.value").startswith("http://"), F.lit(False)), lambda n: F.coalesce("to_uri", F.lit(False)), step=left, is_barrier_guard=replaces)
    marks = flow.local_marks(nodes.join(sink, list(KEY), "left"), spec)
    return marks.where("is_source").join(nodes, list(KEY)).select(*KEY, secure_scheme(F.col("literal.value")).alias("fixed"))


def block_text(block_units: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(file_id, graph_id, cfg_id, label)``: the text of a block's units in document order."""
    met = block_units.join(nodes.select(*KEY, "pre", F.coalesce("text", "name", "kind").alias("t")), list(KEY))
    return met.groupBy("file_id", "graph_id", "cfg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "t"))), lambda x: x["t"]), "\n").alias("label"))
