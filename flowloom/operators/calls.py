"""Flow through calls where a return goes back to the call that was entered, whatever the depth of calls.

A path may leave methods that it did not enter, then enter methods that it does not leave; what it enters and leaves in between
must match.  Summary edges, from an argument to the call that what it fills flows back to, stand for the matched parts, so
that no stack of calls travels along and recursion ends.  Edges are ``(src, dst, kind, call)``, those of kind ``argument``
and ``return`` with their call.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import durable
from . import graph

#: Edges of two and four steps, so that a round of a closure goes four times as far.
DOUBLINGS = 2


def level_edges(edges: DataFrame) -> DataFrame:
    """The steps that stay in their method."""
    return edges.where("kind not in ('argument', 'return')").select("src", "dst")


def summaries(edges: DataFrame, named: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(inside, through)`` of distinct ``edges`` that are read from files.

    ``inside(root, node)``: what each parameter reaches in its method, calls that come back included.
    ``through(src, dst, parameter, result)``: an argument, the call that its parameter's value comes back to, and, where ``named``, by what.
    A round joins the parameters that have come to reach a result with the calls on both sides, by method and call, and goes on from the new
    edges alone; there are as many rounds as calls are nested in what is found.
    """
    level = durable(level_edges(edges).distinct())
    enter = edges.where("kind = 'argument'").select(F.col("src").alias("argument"), F.col("dst").alias("parameter"), "call")
    leave = edges.where("kind = 'return'").select(F.col("src").alias("result"), F.col("dst").alias("back"), "call")
    told = ["src", "dst", "parameter", "result"] if named else ["src", "dst"]
    fresh = graph.reach(level, enter.select(F.col("parameter").alias("root"), F.col("parameter").alias("node")), doublings=DOUBLINGS)
    inside, through = fresh, None
    while True:
        done = fresh.select(F.col("root").alias("parameter"), F.col("node").alias("result"))
        found = done.join(leave, "result").join(enter, ["parameter", "call"]).select(F.col("argument").alias("src"), F.col("back").alias("dst"), "parameter", "result").select(told).distinct()
        new = durable(found if through is None else found.join(through, told, "left_anti"))
        if new.isEmpty():
            return inside, new if through is None else through
        through = new if through is None else durable(through.unionByName(new))
        begun = inside.withColumnRenamed("node", "src").join(new.select("src", "dst"), "src").select("root", F.col("dst").alias("node"))
        fresh = durable(graph.extend(level.unionByName(through.select("src", "dst")), begun, inside))
        if fresh.isEmpty():  # no parameter's value gets further, so no call comes back anew
            return inside, through
        inside = durable(inside.unionByName(fresh))


def two_phases(plain: DataFrame, first: DataFrame, second: DataFrame, seeds: DataFrame, pooled: bool = False) -> DataFrame:
    """``(root, node, phase)``: what ``seeds(root, node)`` reach by ``plain`` and ``first`` edges (phase 0), and then, once a ``second`` one is taken, by ``plain`` and ``second`` ones (phase 1).  Where all seeds have the root 0, ``pooled`` lets long rows condense."""
    at = lambda c, phase: F.struct(F.col(c).alias("node"), F.lit(phase).alias("phase")).alias(c)
    steps = [df.select(at("src", a), at("dst", b)) for df, a, b in ((plain, 0, 0), (plain, 1, 1), (first, 0, 0), (second, 0, 1), (second, 1, 1))]
    steps = reduce(DataFrame.unionByName, steps)
    if pooled:
        steps = steps.select(F.lit(0).alias("root"), "src", "dst")
    found = graph.reach(steps, seeds.select("root", at("node", 0)), doublings=DOUBLINGS)
    return found.select("root", "node.node", "node.phase")


def _kinds(edges: DataFrame, through: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps that stay in a method or come back to it, arguments, and returns."""
    level = level_edges(edges).unionByName(through.select("src", "dst"))
    return level, *[edges.where(f"kind = '{k}'").select("src", "dst") for k in ("argument", "return")]


def matched_reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, node)`` of what each of ``sources(node)`` reaches where a flow that entered a method by a call leaves it by
    that call alone, and one that started inside may return to every caller.  What a matched call passes through counts."""
    edges = durable(edges.select("src", "dst", "kind", "call").distinct())
    level, arguments, returns = _kinds(edges, summaries(edges, named=False)[1])
    # up through returns, then down through arguments: a walk each, so that no step is held for either phase
    up = graph.reach(level.unionByName(returns), sources.select(F.col("node").alias("root"), "node"), doublings=DOUBLINGS, stored=True)
    entered = up.withColumnRenamed("node", "src").join(arguments, "src").select("root", F.col("dst").alias("node"))
    down = graph.reach(level.unionByName(arguments), entered, doublings=DOUBLINGS, stored=True)
    return up.unionByName(down).select(F.col("root").alias("source"), "node").distinct()


def matched_participants(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``(node)``: what lies on a matched path from ``sources(node)`` to ``sinks(node)``.

    Edges that no path takes, matched or not, go first.  A node is on a path if it is reached without a call that is still open
    and leads on somehow, or leads on without leaving a method and is reached somehow; and inside the methods of the summary
    edges on such a path, if it lies between the parameter and the result, down through the calls there.
    """
    some = graph.participants(edges, sources, sinks)
    for end in ("src", "dst"):
        edges = edges.join(some.withColumnRenamed("node", end), end, "left_semi")
    edges = durable(edges.select("src", "dst", "kind", "call").distinct())
    inside, through = summaries(edges)
    level, arguments, returns = _kinds(edges, through)
    level = durable(level.distinct())
    one = F.lit(0).alias("root")
    ahead = two_phases(level, returns, arguments, sources.join(some, "node", "left_semi").select(one, "node"))
    back = two_phases(*map(graph.backward, (level, arguments, returns)), sinks.join(some, "node", "left_semi").select(one, "node"), pooled=True)
    least = lambda df, name: durable(df.groupBy("node").agg(F.min("phase").alias(name)))  # phase 0 may do all that phase 1 may
    ahead, back = least(ahead, "ahead"), least(back, "back")
    fits = "ahead = 0 or back = 0"
    outer = ahead.join(back, "node").where(fits).select("node")
    used = through.join(ahead.withColumnRenamed("node", "src"), "src").join(back.withColumnRenamed("node", "dst"), "dst").where(fits).select(F.col("parameter").alias("root"), F.col("result").alias("node")).distinct()
    between, pairs = None, None
    while True:
        used = durable(used if pairs is None else used.join(pairs, ["root", "node"], "left_anti"))
        if used.isEmpty():
            return outer if between is None else outer.unionByName(between.select("node")).distinct()
        pairs = used if pairs is None else durable(pairs.unionByName(used))
        leads = graph.extend(graph.backward(level), used, between)
        more = leads.join(inside, ["root", "node"], "left_semi")
        between = durable(more if between is None else between.unionByName(more))
        inner = through.join(between.withColumnRenamed("node", "src"), "src").join(between.withColumnRenamed("node", "dst"), ["root", "dst"])
        used = inner.select(F.col("parameter").alias("root"), F.col("result").alias("node")).distinct()
