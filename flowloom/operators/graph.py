"""Closures over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import durable


#: Ways out of a node up to which steps through it are joined to longer ones.
FEW = 16
#: Rounds of a frontier before its edges are doubled; another two before they are once more.
SHORT = 3
#: Rounds of a frontier after which a walk that is not done condenses what is left.
PATIENCE = 3
#: Rounds in which doubts about nodes spread before all is walked.
DOUBTS = 6


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000, doublings: int = 0, stored: bool = False) -> DataFrame:
    """``(root, node)``: what each ``seeds(root, node)`` reaches along ``edges(src, dst)``, itself included.

    A frontier that moves one edge at a time and never visits a pair twice, so
    cycles end; each round's frontier is checkpointed.  An edge table
    with a ``root`` column is walked by that root alone, and what is left of it after :data:`PATIENCE` rounds is :func:`condensed`, so that
    long rows of steps take rounds by the logarithm of their length.  Without such a column each of ``doublings``, where a walk is not done after :data:`SHORT` rounds and two
    more for each, adds the edges of two steps, so that a round goes twice as far; only through nodes that :data:`FEW` edges
    leave at most, so that a hub does not pair all its ways in with all its ways out.  Edges that are ``stored`` are read from files and not written once more.
    """
    return extend(edges, seeds, None, max_rounds, doublings, stored)


def extend(edges: DataFrame, seeds: DataFrame, seen: DataFrame | None, max_rounds: int = 1000, doublings: int = 0, stored: bool = False) -> DataFrame:
    """As :func:`reach`, without the pairs of ``seen(root, node)``, which are neither given back nor walked on from."""
    on = ["root", "src"] if "root" in edges.columns else ["src"]
    known = lambda df: df if seen is None else df.join(seen, ["root", "node"], "left_anti")
    new = out = durable(known(seeds.select("root", "node").distinct()))
    if seen is not None and new.isEmpty():
        return out
    plain = steps = edges.select(*on, "dst") if stored else durable(edges.select(*on, "dst"))  # a round's pairs are distinct whether its steps are or not
    for n in range(max_rounds):
        if len(on) == 1 and n in [SHORT + 2 * k for k in range(doublings)]:
            steps = _twice(steps, on)
        ahead = new.withColumnRenamed("node", "src").join(steps, on).select("root", F.col("dst").alias("node")).distinct()
        new = durable(known(ahead.join(out, ["root", "node"], "left_anti")))
        if new.isEmpty():
            return out
        out = out.unionByName(new)
        if n + 1 == PATIENCE and len(on) == 2 and seen is None:
            return condensed(plain.distinct(), durable(out))  # longer steps would give nodes more ways in
        if n % 16 == 15:
            out = durable(out)  # else its plan grows with the rounds
    raise RuntimeError("the closure did not end; raise max_rounds")


def _twice(steps: DataFrame, on: list[str]) -> DataFrame:
    """``steps`` and those of two of them, but for what leads through a hub."""
    steps = steps.distinct()
    many = steps.groupBy(*on).count().where(F.col("count") > FEW)
    narrow = steps.join(many, on, "left_anti")
    two = steps.withColumnRenamed("dst", "mid").join(narrow.withColumnRenamed("src", "mid"), [*on[:-1], "mid"]).select(steps.columns)
    return durable(steps.unionByName(two).distinct())


def condensed(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """``(root, node)``: what ``seen(root, node)`` reaches along ``edges(root, src, dst)``, in rounds by the logarithm of the length of rows.

    A node that is entered from one place alone is reached if that place is, so it joins its region; rows of such nodes join at
    once, by pointer doubling.  Edges inside a region go and those between two regions are one, so branches that meet again, and loops,
    become such rows in the next round, and the rounds count how deep branches and loops nest.  What is reached stands by itself; what nothing
    leads to goes.  In graphs that no structure made, each round still moves the frontier by an edge between regions.
    """
    at = ["root", "node"]
    ends = lambda df, c: df.select("root", F.col(c).alias("node"))
    edges = durable(edges.join(seen.withColumnRenamed("node", "dst"), ["root", "dst"], "left_anti"))
    label = durable(ends(edges, "src").unionByName(ends(edges, "dst")).join(seen, at, "left_anti").distinct().withColumn("head", F.col("node")))
    front, heads = durable(ends(edges.join(seen.withColumnRenamed("node", "src"), ["root", "src"], "left_semi"), "dst").distinct()), None
    while not front.isEmpty():
        heads = front if heads is None else durable(heads.unionByName(front))
        inner = edges.join(heads.withColumnRenamed("node", "dst"), ["root", "dst"], "left_anti")
        entered = ends(inner, "dst").unionByName(heads).distinct()
        inner = durable(inner.join(entered.withColumnRenamed("node", "src"), ["root", "src"], "left_semi").select("root", "src", "dst"))
        one = inner.groupBy("root", F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("head")).where("n = 1").select("root", "node", "head")
        up = durable(one)
        jumped = lambda df: df.join(df.select("root", F.col("node").alias("head"), F.col("head").alias("further")), ["root", "head"], "left").select("root", "node", F.coalesce("further", "head").alias("head"), F.col("further").isNotNull().alias("open"))
        for _ in range(up.count().bit_length() // 2 + 1):  # four times as far a round; rows that close on themselves are never done, and nothing enters them
            moved = durable(jumped(jumped(up)))
            up = moved.select("root", "node", "head")
            if moved.where("open").isEmpty():
                break
        to = up.select("root", F.col("node").alias("x"), F.col("head").alias("y"))
        swap = lambda df, c: df.join(to.withColumnRenamed("x", c), ["root", c], "left").withColumn(c, F.coalesce("y", c)).drop("y")
        label = durable(swap(label, "head").select(*at, "head"))
        edges = durable(swap(swap(inner, "src"), "dst").where("src <> dst").select("root", "src", "dst").distinct())
        front = durable(ends(edges.join(heads.withColumnRenamed("node", "src"), ["root", "src"], "left_semi"), "dst").distinct().join(heads, at, "left_anti"))
    if heads is None:
        return seen
    found = label.join(heads.withColumnRenamed("node", "head"), ["root", "head"], "left_semi").select(*at)
    return seen.unionByName(found)


def unreached(edges: DataFrame, start: int) -> DataFrame:
    """``(root, node)``: the nodes of ``edges(root, src, dst, early)`` that no walk from the node ``start`` of their root reaches.

    Edges marked ``early`` lead onward in some order of the nodes, whichever that is; those that leave ``start`` must be.  By that order, a node is reached that one of them
    enters from a node without doubt.  So only nodes are doubted, and walked, that none of them enters but from nodes in doubt: in a program with
    a good order, dead code and the few nodes that control only enters from behind.  Where :data:`DOUBTS` rounds do not end the doubts, all is walked.
    """
    at = ["root", "node"]
    edges = durable(edges.select("root", "src", "dst", "early"))
    told = edges.select("root", F.col("dst").alias("node"), "early").unionByName(edges.select("root", F.col("src").alias("node"), (F.col("src") == start).alias("early")))
    doubt = new = durable(told.groupBy(*at).agg(F.max("early").alias("sure")).where("not sure").select(*at))
    if doubt.isEmpty():
        return doubt
    doubted = lambda df: df.select("root", F.col("node").alias("src"), F.lit(True).alias("doubted"))
    onward = edges.where("early")
    for _ in range(DOUBTS):
        asked = onward.join(new.withColumnRenamed("node", "src"), ["root", "src"], "left_semi").select("root", F.col("dst").alias("node")).distinct().join(doubt, at, "left_anti")
        into = onward.join(asked.withColumnRenamed("node", "dst"), ["root", "dst"], "left_semi").join(doubted(doubt), ["root", "src"], "left")
        new = durable(into.groupBy("root", F.col("dst").alias("node")).agg(F.count_if(F.col("doubted").isNull()).alias("sure")).where("sure = 0").select(*at))
        if new.isEmpty():
            break
        doubt = doubt.unionByName(new)
    else:
        seeds = edges.where(F.col("src") == start).select("root", F.col("src").alias("node"))
        return told.select(*at).distinct().join(reach(edges.select("root", "src", "dst"), seeds), at, "left_anti")
    inner = durable(edges.join(doubt.withColumnRenamed("node", "dst"), ["root", "dst"], "left_semi").join(doubted(doubt), ["root", "src"], "left"))
    seeds = inner.where("doubted is null").select("root", F.col("dst").alias("node"))
    return doubt.join(reach(inner.where("doubted").select("root", "src", "dst"), seeds), at, "left_anti")


def tree_jumps(before: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``(jumps, endless)`` of ``before(node, before)``, where one place at most leads to a node: the nodes 1, 2, 4, ... steps before each, as far as there
    are some, and ``endless(node)`` of what a loop leads to."""
    up = durable(before.where("before is not null").select("node", "before"))
    jumps, most = [], up.count().bit_length()
    while not up.isEmpty():
        if len(jumps) > most:
            return jumps, up.select("node")
        jumps.append(up)
        up = durable(up.join(up.select(F.col("node").alias("before"), F.col("before").alias("further")), "before").select("node", F.col("further").alias("before")))
    return jumps, up.select("node")


def subtree_sums(jumps: list[DataFrame], amounts: DataFrame) -> DataFrame:
    """``(node, amount)``: the sum of ``amounts(node, amount)`` over each node and what it leads to, in trees of :func:`tree_jumps`.

    After a round with the nodes 2^k steps before, a sum holds what lies fewer than 2^(k+1) steps behind; every node has one row in each round.
    """
    for up in jumps:
        further = up.join(amounts, "node").select(F.col("before").alias("node"), "amount")
        amounts = durable(amounts.unionByName(further).groupBy("node").agg(F.sum("amount").alias("amount")))
    return amounts


def reach_layered(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """As :func:`reach` on a graph whose paths have ``depth`` edges at most: joins only, without a driver loop's actions."""
    steps = edges.select("src", "dst").distinct()
    level = seeds.select("root", "node").distinct()
    out = level
    for _ in range(depth):
        level = level.withColumnRenamed("node", "src").join(steps, "src").select("root", F.col("dst").alias("node")).distinct()
        out = out.unionByName(level)
    return out.distinct()


def backward(edges: DataFrame) -> DataFrame:
    """The edges turned round."""
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def participants(edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int | None = None) -> DataFrame:
    """``(node)``: what lies on a path from ``sources(node)`` to ``sinks(node)``: reached forwards and, along edges that are, backwards.

    The walk begins where there are fewer nodes, and the way back takes only edges that it has met.
    """
    one = F.lit(0).alias("root")
    if sinks.count() < sources.count():
        edges, sources, sinks = backward(edges), sinks, sources
    if depth is not None:
        met, ahead = _met_layered(edges, sources, depth)
        return reach_layered(backward(met), sinks.join(ahead, "node", "left_semi").select(one, "node"), depth).select("node").distinct()
    edges = durable(edges.select("src", "dst").distinct()).select(one, "src", "dst")  # a single root, so that long rows condense
    ahead = durable(reach(edges, sources.select(one, "node")).select("node"))
    live = durable(edges.join(ahead.withColumnRenamed("node", "src"), "src", "left_semi"))
    return reach(backward(live), sinks.join(ahead, "node", "left_semi").select(one, "node")).select("node").distinct()


def _met_layered(edges: DataFrame, sources: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """``(edges, ahead)``: the ``edges(src, dst)`` that a walk of ``depth`` steps from ``sources(node)`` takes, and the nodes that it meets.

    Each step keeps the edges that it takes, so what the walk does not meet is neither made distinct nor written.
    """
    level, taken = sources.select("node").distinct(), []
    for _ in range(depth):
        taken.append(durable(edges.select("src", "dst").join(level.withColumnRenamed("node", "src"), "src", "left_semi").distinct()))
        level = taken[-1].select(F.col("dst").alias("node")).distinct()
    met = reduce(DataFrame.unionByName, taken).distinct()
    return met, durable(met.select(F.col("dst").alias("node")).unionByName(sources.select("node")).distinct())


def shortest_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(sink, source, path)``: for each of ``sinks(node)`` that some of ``sources(node)`` reaches along ``edges(src, dst)``, one of its shortest paths.

    Breadth first from all sources at once; each node keeps the least of the nodes before it that are nearest to a source, and the
    paths are walked back along these, two steps, four, eight at a time.  So the work grows with the edges, not with the number of paths.
    """
    steps = durable(edges.select("src", "dst").distinct())
    new = durable(sources.select("node").distinct().withColumn("before", F.col("node")))
    seen = new
    for n in range(max_rounds):
        ahead = new.select(F.col("node").alias("src")).join(steps, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("before"))
        new = durable(ahead.join(seen.select("node"), "node", "left_anti"))
        if new.isEmpty():
            break
        seen = durable(seen.unionByName(new)) if n % 8 == 7 else seen.unionByName(new)
    else:
        raise RuntimeError("the walk did not end; raise max_rounds")
    # what leads to a node, nearest last: the path of 2^k nodes before it, and the node at its start
    back = durable(seen.select("node", F.col("before").alias("first"), F.when(F.col("before") == F.col("node"), F.array().cast(f"array<{seen.schema['node'].dataType.simpleString()}>")).otherwise(F.array("before")).alias("path")))
    on = sinks.select("node").distinct().join(seen.select("node"), "node", "left_semi")
    found = on.select(F.col("node").alias("sink"), F.col("node").alias("first"), F.array("node").alias("path"))
    while True:
        found = durable(found.join(back.select(F.col("node").alias("first"), F.col("first").alias("further"), F.col("path").alias("more")), "first").select("sink", F.col("further").alias("first"), F.concat("more", "path").alias("path"), (F.size("more") > 0).alias("moved")))
        if found.where("moved").isEmpty():
            return found.select("sink", F.col("first").alias("source"), "path")
        back = durable(back.alias("a").join(back.alias("b"), F.col("a.first") == F.col("b.node")).select("a.node", F.col("b.first").alias("first"), F.concat("b.path", "a.path").alias("path")))
        found = found.drop("moved")


def paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int) -> DataFrame:
    """``(source, path, sink)``: every simple path of ``depth`` edges at most from a source to a sink.

    A source that is a sink is a path of one node.  Only edges on some such
    path are followed, so the paths kept at a level all lead on.
    """
    edges = edges.select("src", "dst")
    live = durable(participants(edges, sources, sinks, depth))
    kept = edges.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi")
    kept = durable(kept.distinct())
    level = sources.join(live, "node", "left_semi").select("node", F.array("node").alias("path")).distinct()
    out = level
    for _ in range(depth):
        level = level.withColumnRenamed("node", "src").join(kept, "src").where("not array_contains(path, dst)").select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        out = out.unionByName(level)
    return out.join(sinks.distinct(), "node", "left_semi").select(F.col("path")[0].alias("source"), "path", F.col("node").alias("sink"))
