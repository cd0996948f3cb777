"""Control-flow graphs, built from ``nodes`` with joins: every edge is what follows in the nearest ancestor that says so."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import durable
from ..schema import LOOPS, STATEMENTS
from . import graph
from .desugar import ENTER, LEAVE, ONWARD, TRUE, completed, made_id, origin_id, what_is, with_finally_copies
from .tree import KEY, ancestors, chains

START, END = -1, -2
#: The columns of a tree that control flow asks for.
TREE = ("file_id", "node_id", "parent_id", "role", "pre", "post", "kind", "name", "operator", "flags")
#: Operators nested in a condition; more is an error.
MAX_LEVELS = 10_000
#: Places, as a power of two, in which a run of units is looked for at once.
SPAN = 18
#: How often what nothing enters is taken away before gaps are looked for.
PEELS = 2
#: Levels of operators in one plan.
STRIDE = 4
#: Kinds that let control flow go on to all that is inside and behind them, but for what is fixed or shut.
PLAIN = ("MethodDeclaration", "Block", "If", "VariableDeclaration", "Assignment", "CompoundAssignment", "MethodInvocation", "NewClass", "Identifier", "Literal", "Binary", "Unary", "Parentheses", "ControlParentheses", "TypeCast", "FieldAccess", "ArrayAccess")
COMPOUND = ("Block", "If", "While", "DoWhile", "For", "Try", "Synchronized", "Switch", "Label")


def logical() -> Column:
    """Whether a node only combines conditions."""
    return F.col("kind").isin("Parentheses", "ControlParentheses") | F.coalesce(F.col("operator").isin("And", "Or", "Not"), F.lit(False))


def units(nodes: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """What control flow visits: simple statements, and the leaves of conditions, of :func:`desugar.completed` trees.

    ``(file_id, node_id, pre, at, is_condition)``; ``at`` is a place in the order of evaluation, which is behind what a unit holds unless it comes first.  A leaf is what is left of a
    condition below and, or, not and parentheses; each
    case that is no default is a condition of its own, either value of a ternary is a unit, and so are a do, which enters its body, the body of a callable without
    statements, and what has a body of its own inside an expression: a lambda, an anonymous class and the methods there.
    """
    roles = ("statement", "body", "true_part", "false_part", "init", "control", "update", "resource")
    simple = nodes.where(F.col("kind").isin(*[k for k in STATEMENTS if k not in COMPOUND and k != "ForEach"]) & F.col("role").isin(*roles))
    do = nodes.where("kind = 'DoWhile'")
    filled = nodes.select("file_id", F.col("parent_id").alias("node_id")).distinct()
    method = nodes.where("kind = 'MethodDeclaration'").select("file_id", F.col("node_id").alias("parent_id"))
    own = nodes.where("(kind = 'Block' and role in ('lambda_body', 'static_init', 'instance_init')) or (kind = 'ClassBody' and role = 'anonymous_body')")
    body = own.unionByName(nodes.where("kind = 'Block' and role = 'body'").join(method, ["file_id", "parent_id"], "left_semi").select(own.columns))
    empty = body.join(filled, list(KEY), "left_anti")
    bodies = (nested_bodies(nodes) if nested is None else nested).select("file_id", F.col("owner_id").alias("node_id"))
    carriers = nodes.join(bodies, list(KEY), "left_semi")
    told = lambda df, at, asks: df.select(*KEY, "pre", F.col(at).alias("at"), F.lit(asks).alias("is_condition"))
    plain = reduce(DataFrame.unionByName, [told(df, at, False) for df, at in ((simple, "post"), (do, "pre"), (empty, "post"), (carriers, "pre"))])
    cases = told(nodes.where("kind = 'Case' and coalesce(name, '') <> 'default'"), "pre", True)
    below = nodes.where("role = 'condition'").select(*KEY, "kind", "operator", "pre", "post")
    leaves = [below.where(~logical())]
    for n in range(0, MAX_LEVELS, STRIDE):
        below = durable(below.where(logical()))
        if below.isEmpty():
            break
        if n == 0:  # what lies below an operator
            operators = nodes.where(logical()).select("file_id", F.col("node_id").alias("parent_id"))
            operands = durable(nodes.join(operators, ["file_id", "parent_id"], "left_semi").select(*KEY, "parent_id", "kind", "operator", "pre", "post"))
        for _ in range(STRIDE):
            inner = below.where(logical()).select("file_id", F.col("node_id").alias("parent_id"))
            below = operands.join(inner, ["file_id", "parent_id"]).select(*KEY, "kind", "operator", "pre", "post")
            leaves.append(below.where(~logical()))
        leaves = [durable(reduce(DataFrame.unionByName, leaves))]
    else:
        raise ValueError(f"a condition nests operators more than {MAX_LEVELS} levels deep")
    found = reduce(DataFrame.unionByName, leaves)
    ternary = nodes.where("kind = 'Ternary'").select("file_id", F.col("node_id").alias("parent_id"))
    values = told(nodes.where("role in ('true_part', 'false_part')").join(ternary, ["file_id", "parent_id"], "left_semi"), "post", False)
    every = reduce(DataFrame.unionByName, (plain, cases, values, told(found, "post", True)))
    return every.groupBy(*KEY).agg(F.min("pre").alias("pre"), F.min("at").alias("at"), F.max("is_condition").alias("is_condition"))


def nested_bodies(nodes: DataFrame) -> DataFrame:
    """``(file_id, block_id, owner_id)``: bodies that run inside the graph around them, with what has them: the block of a lambda, the
    body of an anonymous class (role ``anonymous_body``), and those of the methods there."""
    own = nodes.where("(kind = 'Block' and role = 'lambda_body') or (kind = 'ClassBody' and role = 'anonymous_body')").select("file_id", F.col("node_id").alias("block_id"), F.col("parent_id").alias("owner_id"))
    anonymous = nodes.where("role = 'anonymous_body'").select("file_id", F.col("node_id").alias("parent_id"))
    methods = nodes.where("kind = 'MethodDeclaration'").join(anonymous, ["file_id", "parent_id"], "left_semi").select("file_id", F.col("node_id").alias("owner_id"))
    blocks = nodes.where("kind = 'Block'").select("file_id", F.col("node_id").alias("block_id"), F.col("parent_id").alias("owner_id"))
    return own.unionByName(blocks.join(methods, ["file_id", "owner_id"], "left_semi").select(own.columns)).distinct()


def graph_block(chain: str = "chain") -> Column:
    """The innermost body of a method, an initialiser, a lambda or an anonymous class among a node's ancestors and itself, as :func:`tree.chains` has them."""
    method_up = F.get(F.filter(chain, lambda a: a["anc_kind"] == "MethodDeclaration"), F.lit(0))["up"]
    named = lambda a: a["anc_kind"].isin("Block", "ClassBody") & a["anc_role"].isin("lambda_body", "static_init", "instance_init", "anonymous_body")
    return F.get(F.filter(chain, lambda a: named(a) | F.coalesce((a["anc_kind"] == "Block") & (a["up"] == method_up - 1), F.lit(False))), F.lit(0))


def build(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(units, edges)`` of every callable block: ``edges(file_id, graph_id, src, dst, branch, again, apart, dst_at)`` between units.

    ``dst`` is :data:`END` where the block is left and ``src`` is :data:`START` where it is
    entered.  Returns and throws leave, through copies of the finally blocks around them; break and continue go by the nearest loop
    (labels are not asked), through such copies too; catch bodies are
    not visited; a local class is one unit; bodies inside expressions are spliced in.  Units inside a unit, those of its ternaries and its lambdas,
    come before it.  ``again`` marks edges to the condition of a loop that has been entered: they lead to the outcome, not to what leads up to it.
    ``apart`` marks those to the update of a ``for``, which begins a block of its own.  A continue there goes to the condition.
    ``dst_at`` is the place of ``dst`` in the order of evaluation.
    All steps are equi-joins on (file, node), and the nearest ancestor is an aggregate over the levels of the tree.
    """
    return _built(*_prepared(nodes))


def _prepared(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree as control flow sees it, with ``at`` and ``is_condition`` of its units, and its nested bodies."""
    nodes = durable(with_finally_copies(completed(nodes)).select(*TREE))
    bodies = durable(nested_bodies(nodes))
    holds = F.col("is_condition").isNotNull() & ~F.col("kind").isin("Case", "DoWhile")
    return durable(nodes.join(units(nodes, bodies).select(*KEY, "at", "is_condition"), list(KEY), "left").withColumn("holds", holds)), bodies


def _built(nodes: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    kinds = {r["kind"] for r in nodes.select("kind").distinct().collect()}
    nested = not bodies.isEmpty()
    told = chains(nodes, nodes.where("is_condition is not null"), include_self=True, columns=("kind", "role", "post", "holds"), keep=("pre", "at", "is_condition", "kind")).withColumn("block", graph_block())
    own = F.filter("chain", lambda a: F.col("block").isNull() | (a["up"] <= F.col("block.up")))  # the units of a nested body are not their statement's
    # what a local class declares is not run where it stands; asked by levels, as a test of the chain that is cut would find the block anew for each of its nodes
    class_up = F.get(F.filter("chain", lambda a: (a["up"] > 0) & (a["anc_kind"] == "ClassDeclaration")), F.lit(0))["up"]
    levels = (class_up.alias("class_up"), F.col("block.up").alias("block_up")) if "ClassDeclaration" in kinds else ()
    told = told.select(*KEY, F.col("pre").alias("unit_pre"), "at", "is_condition", "kind", F.col("block.anc_id").alias("block_id"), own.alias("chain"), *levels)
    chained = durable(told.where("class_up is null or coalesce(class_up > block_up, false)").drop("class_up", "block_up") if "ClassDeclaration" in kinds else told)
    u = chained.select(*KEY, F.col("unit_pre").alias("pre"), "at", "is_condition")
    home = chained.where("block_id is not null").select(*KEY, "block_id", F.col("unit_pre").alias("pre"))
    entry, after, hosts = _inner_units(bodies, chained)
    jumps = _jumps(nodes, entry)
    step = F.struct("up", "anc_kind", "jump", "again", "y_role", "y_op", "y_parent", "y_parent_id", "y_right", "y_to", "next_case", "self_op")
    once = {"block_id": F.col("block_id"), "unit_kind": F.col("kind"), "is_condition": F.col("is_condition")}
    pairs = chained.select(*KEY, *once.values(), F.inline("chain")).select(*KEY, "anc_id", "up", "anc_kind", *[F.when(F.col("up") == 0, F.col("kind" if n == "unit_kind" else n)).alias(n) for n in once])
    steps = pairs.join(jumps, ["file_id", "anc_id"]).groupBy(*KEY).agg(F.array_sort(F.collect_list(step)).alias("steps"), *[F.max(n).alias(n) for n in once])
    first_jump = F.get(F.filter("steps", lambda a: a["jump"].isNotNull()), F.lit(0))
    steps = durable(steps.withColumn("f", first_jump).select(*KEY, "block_id", F.col("unit_kind").alias("kind"), "is_condition", F.col("f.jump").alias("follow"), F.col("f.again").alias("again"), "steps"))
    none = F.lit(None).cast("string").alias("branch")
    unknown = F.lit(None).cast("bigint")
    plain = steps.where("not is_condition").select(*KEY, "block_id", "kind", "follow", "again")
    plain = plain.withColumn("after", unknown) if hosts is None else plain.join(after, list(KEY), "left")
    if "DoWhile" in kinds:
        begins = jumps.where("y_parent = 'DoWhile'").groupBy("file_id", F.col("y_parent_id").alias("node_id")).agg(F.max(F.coalesce("y_to.to_body", "y_to.to_condition")).alias("begins")).withColumn("kind", F.lit("DoWhile"))
        plain = plain.join(begins, [*KEY, "kind"], "left").withColumn("after", F.coalesce("begins", "after"))
    plain = plain.withColumn("again", F.col("after").isNull() & F.coalesce("again", F.lit(False))).withColumn("follow", F.coalesce("after", "follow"))
    jumping = ("Return", "Throw", "Break", "Continue")
    go = plain.where(~F.col("kind").isin(*jumping)).select("file_id", F.col("block_id").alias("graph_id"), F.col("node_id").alias("src"), F.col("follow").alias("dst"), none, "again")
    every = go.unionByName(_outcomes(steps)).where("graph_id is not null")
    inside = home.select("file_id", F.col("node_id").alias("src"), F.col("block_id").alias("graph_id"))
    if kinds & set(jumping):
        way = steps.where(F.col("kind").isin(*jumping) & ~F.col("is_condition")).select(*KEY, "kind", "steps")
        every = every.unionByName(_leaving(nodes, way, entry).join(inside, ["file_id", "src"]))
    if "Case" in kinds:
        every = every.unionByName(_cases(steps, entry).join(inside, ["file_id", "src"]))
    led = home if hosts is None else home.join(hosts, list(KEY), "left_anti")
    first = led.groupBy("file_id", F.col("block_id").alias("graph_id")).agg(F.min_by("node_id", "pre").alias("dst"))
    start = first.select("file_id", "graph_id", F.lit(START).cast("bigint").alias("src"), "dst", none, F.lit(False).alias("again"))
    edges = every.select("file_id", "graph_id", "src", F.coalesce("dst", F.lit(END)).cast("bigint").alias("dst"), "branch", "again").unionByName(start)
    if "Try" in kinds or nested:
        edges = durable(edges.distinct())
    if "Try" in kinds:
        edges = _without_onward(edges)
    if nested:
        edges = _spliced(bodies, edges, inside)
    told = u.select("file_id", F.col("node_id").alias("dst"), F.col("at").alias("dst_at"), F.col("is_condition").alias("asked"))
    if nested:
        block = nodes.join(bodies.select("file_id", F.col("block_id").alias("node_id")), list(KEY), "left_semi")
        gates = [block.select("file_id", made_id(F.col("node_id"), what).alias("dst"), F.col(at).alias("dst_at"), F.lit(False).alias("asked")) for what, at in ((ENTER, "pre"), (LEAVE, "post"))]
        told = reduce(DataFrame.unionByName, gates, told)
    edges = edges.join(told, ["file_id", "dst"], "left")
    if "For" in kinds:
        updates = nodes.where("role = 'update'").groupBy("file_id", "parent_id").agg(F.min_by(F.struct("node_id", "kind"), "pre").alias("first")).where("first.kind <> 'Empty'").select("file_id", "first.node_id")
        apart = updates.join(entry, list(KEY)).select("file_id", F.col("entry").alias("dst"), F.lit(True).alias("apart")).distinct()
        edges = edges.join(apart, ["file_id", "dst"], "left")
    else:
        edges = edges.withColumn("apart", F.lit(False))
    edges = edges.select("file_id", "graph_id", "src", "dst", "branch", (F.col("again") & F.coalesce("asked", F.lit(False))).alias("again"), F.coalesce("apart", F.lit(False)).alias("apart"), "dst_at")
    return u.where(what_is(F.col("node_id")) != ONWARD), durable(edges.distinct())


def _climb(steps: DataFrame) -> DataFrame:
    """A row for each of the ``steps`` of a unit, from itself up."""
    return steps.select(*[c for c in steps.columns if c != "steps"], F.inline("steps"))


def _inner_units(nested: DataFrame, chained: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``(entry, after, hosts)``: where each node is entered; what follows a value or a body in the unit that it is inside of, which is its next
    inner unit, or the unit itself; and the units that have inner ones.  The last two are None where no unit has some."""
    host = F.get(F.filter("chain", lambda a: (a["up"] > 0) & a["anc_holds"]), F.lit(0))["anc_id"]
    inner = durable(chained.select(*KEY, host.alias("host"), "unit_pre").where("host is not null"))
    hosts = inner.select("file_id", F.col("host").alias("node_id")).distinct()
    plain = inner.isEmpty()
    leafy = (chained if plain else chained.join(hosts, list(KEY), "left_anti")).select(*KEY, "unit_pre", F.inline("chain"))
    chain = chained.select(*KEY, F.inline("chain"))
    entry = leafy.groupBy("file_id", "anc_id").agg(F.min_by("node_id", "unit_pre").alias("entry"), F.min_by(F.when(F.col("up") > 0, F.col("node_id")), F.when(F.col("up") > 0, F.col("unit_pre"))).alias("inner")).withColumnRenamed("anc_id", "node_id")
    entry = durable(entry)
    if plain:
        return entry, None, None
    values = chain.where("up = 0 and anc_role in ('true_part', 'false_part')").select(*KEY)
    ends = chain.where("up = 1 and anc_kind = 'Ternary'").join(values, list(KEY), "left_semi").join(inner.select(*KEY, "host"), list(KEY)).select("file_id", "host", F.col("anc_post").alias("at"), "node_id")
    bodies = chain.where("up = 0").join(nested.select("file_id", F.col("owner_id").alias("node_id")), list(KEY), "left_semi").join(inner.select(*KEY, "host"), list(KEY)).select("file_id", "host", F.col("anc_post").alias("at"), "node_id")
    ends = ends.unionByName(bodies).select("file_id", "host", "at", F.lit(None).cast("bigint").alias("unit"), "node_id")
    starts = inner.join(entry, list(KEY)).select("file_id", "host", F.col("unit_pre").alias("at"), F.col("entry").alias("unit"), F.lit(None).cast("bigint").alias("node_id"))
    coming = Window.partitionBy("file_id", "host").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)  # as in _jumps
    after = ends.unionByName(starts).withColumn("after", F.coalesce(F.last("unit", ignorenulls=True).over(coming), "host")).where("node_id is not null").select(*KEY, "after")
    return entry, after, hosts


def _jumps(nodes: DataFrame, entry: DataFrame) -> DataFrame:
    """Where control goes behind each node that holds units or is one, where that is told by its place, with what its surroundings are and, for conditions and the parts of a do, where the
    parts of its parent are entered."""
    # only these kinds decide where their parts lead
    deciding = nodes.where(F.col("kind").isin("If", "Ternary", "MethodDeclaration", "Lambda", *LOOPS) | F.col("operator").isin("And", "Or"))
    up = deciding.select("file_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("operator").alias("parent_operator"))
    rule, default = F.coalesce(F.array_contains("flags", "Rule"), F.lit(False)).alias("rule"), (F.col("name") == "default").alias("default")
    told = nodes.select(*KEY, "parent_id", "role", "pre", "kind", rule, default, "operator").join(entry, list(KEY)).join(up, ["file_id", "parent_id"], "left")
    parts = Window.partitionBy("file_id", "parent_id")
    slots = {f"to_{r}": F.max(F.when(F.col("role") == r, F.col("entry"))).over(parts) for r in ("condition", "control", "body", "update", "true_part", "false_part", "right", "finally", "init")}
    # the nearest behind a node is the last before it from the end on: a frame that ends with its partition is gone through again for each row
    later = Window.partitionBy("file_id", "parent_id", "role").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    in_row = F.col("role").isin("statement", "init", "update", "resource")
    # a case falls through to the body of the one behind it, a rule's case to nothing
    case_body = F.when(F.col("default"), F.col("entry")).otherwise(F.col("inner"))
    info = (
        told.withColumn("next_entry", F.last(F.when(in_row, F.col("entry")), ignorenulls=True).over(later))
        .withColumn("next_case", F.last(F.when(F.col("kind") == "Case", F.col("entry")), ignorenulls=True).over(later))
        .withColumn("fall", F.last(F.when(F.col("kind") == "Case", case_body), ignorenulls=True).over(later))
        .withColumns(slots)
    )
    loop = F.col("parent_kind")
    # (where, whether the loop has been entered)
    rules = [
        (in_row & F.col("next_entry").isNotNull(), F.col("next_entry"), False),
        ((F.col("kind") == "Case") & F.col("fall").isNotNull() & ~F.col("rule"), F.col("fall"), False),
        ((F.col("role") == "body") & (loop == "While"), F.col("to_condition"), True),
        ((F.col("role") == "body") & (loop == "DoWhile"), F.col("to_condition"), False),
        ((F.col("role") == "body") & (loop == "For") & F.col("to_update").isNotNull(), F.col("to_update"), False),
        ((F.col("role") == "body") & loop.isin("For", "ForEach"), F.col("to_condition"), True),
        ((F.col("role") == "update") & (loop == "For"), F.col("to_condition"), True),
        (F.col("role").isin("init", "control") & loop.isin("For", "ForEach"), F.when(F.col("role") == "init", F.coalesce("to_control", "to_condition")).otherwise(F.col("to_condition")), False),
        ((F.col("role") == "try_body") & F.col("to_finally").isNotNull(), F.col("to_finally"), False),
        ((F.col("role").isin("body", "lambda_body") & loop.isin("MethodDeclaration", "Lambda")) | F.col("role").isin("static_init", "instance_init", "anonymous_body"), F.lit(END), False),
    ]
    jump, again = F.when(F.lit(False), F.lit(None).cast("bigint")), F.when(F.lit(False), F.lit(None).cast("boolean"))
    for test, to, entered in rules:
        jump, again = jump.when(test, to), again.when(test, F.lit(entered))
    asks = F.col("role").isin("condition", "left")
    decides = {"y_role": F.when(asks | (F.col("role") == "try_body"), F.col("role")), "y_op": F.when(asks, F.col("parent_operator")), "y_parent": F.when((F.col("role") == "condition") | (loop == "DoWhile"), loop)}
    around = decides | {"y_parent_id": F.when(F.col("role").isin("condition", "body", "try_body"), F.col("parent_id")), "y_right": F.when(F.col("role") == "left", F.col("to_right")), "self_op": F.when(F.col("operator") == "Not", F.col("operator"))}
    to = F.when((F.col("role") == "condition") | (loop == "DoWhile"), F.struct("to_true_part", "to_false_part", "to_body", "to_condition", "to_update")).alias("y_to")
    return durable(info.select("file_id", F.col("node_id").alias("anc_id"), jump.alias("jump"), F.coalesce(again, F.lit(False)).alias("again"), *[c.alias(y) for y, c in around.items()], to, "next_case"))


def _leaving(nodes: DataFrame, steps: DataFrame, entry: DataFrame) -> DataFrame:
    """Edges from returns, throws, breaks and continues: each to the copy of the nearest finally block on its way, or to where it leads."""
    copies = nodes.where("role like 'finally\\_%'").select("file_id", F.col("parent_id").alias("y_parent_id"), F.substring("role", 9, 99).alias("way"), "node_id").join(entry, list(KEY)).select("file_id", "y_parent_id", "way", F.col("entry").alias("through"))
    way = F.when(F.col("kind") == "Break", "break").when(F.col("kind") == "Continue", "continue").otherwise("exit")
    off = steps.select(*KEY, way.alias("way"))
    climb = _climb(steps.select(*KEY, way.alias("way"), "steps"))
    loop = climb.where(F.col("anc_kind").isin(*LOOPS, "Switch")).groupBy(*KEY).agg(F.min(F.when(F.col("anc_kind") != "Switch", F.col("up"))).alias("loop_up"), F.min("up").alias("break_up"))
    climb = climb.join(loop, list(KEY), "left")
    via = climb.where("y_role = 'try_body'").join(copies, ["file_id", "y_parent_id", "way"]).where(F.when(F.col("way") == "break", F.coalesce(F.col("up") < F.col("break_up"), F.lit(True))).when(F.col("way") == "continue", F.coalesce(F.col("up") < F.col("loop_up"), F.lit(True))).otherwise(F.lit(True)))
    to_loop = nodes.where("role = 'condition'").select("file_id", F.col("parent_id").alias("y_parent_id"), "node_id").join(entry, list(KEY)).select("file_id", "y_parent_id", F.col("entry").alias("asks"))
    climb = climb.join(to_loop, ["file_id", "y_parent_id"], "left").withColumn("jump", F.when((F.col("way") == "continue") & (F.col("up") == F.col("loop_up") - 1), F.col("asks")).otherwise(F.col("jump")))
    there = climb.where("jump is not null").where(((F.col("way") == "break") & (F.col("up") >= F.col("break_up"))) | ((F.col("way") == "continue") & (F.col("up") == F.col("loop_up") - 1)))
    both = via.select(*KEY, "up", F.col("through").alias("dst"), F.lit(False).alias("again")).unionByName(there.select(*KEY, "up", F.col("jump").alias("dst"), (F.col("again") | (F.col("way") == "continue")).alias("again")))
    found = both.groupBy(*KEY).agg(F.min_by(F.struct("dst", "again"), "up").alias("to"))
    met = off.join(found, list(KEY), "left").where("to is not null or way = 'exit'")
    return met.select("file_id", F.col("node_id").alias("src"), F.coalesce("to.dst", F.lit(END)).cast("bigint").alias("dst"), F.lit(None).cast("string").alias("branch"), F.coalesce("to.again", F.lit(False)).alias("again"))


def _outcomes(steps: DataFrame) -> DataFrame:
    """Edges from the leaves of conditions: each climbs to the operator or statement that its outcome decides; every "not" on the way turns the outcome round."""
    climb = _climb(steps.where("is_condition").select(*KEY, "block_id", "follow", F.col("again").alias("follow_again"), "steps"))
    order = Window.partitionBy(*KEY).orderBy("up").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = climb.withColumn("turns", F.sum(F.when((F.col("up") > 0) & (F.col("self_op") == "Not"), 1).otherwise(0)).over(order))
    both = turned.withColumn("outcome", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("value", F.col("outcome") == (F.col("turns") % 2 == 0))
    decided = ((F.col("y_role") == "left") & (((F.col("y_op") == "And") & F.col("value")) | ((F.col("y_op") == "Or") & ~F.col("value")))) | (F.col("y_role") == "condition")
    stop = both.where(decided).groupBy(*KEY, "outcome").agg(F.min_by(F.struct("y_role", "y_parent", "y_right", "y_to", "value", "block_id", "follow", "follow_again"), "up").alias("s")).select(*KEY, "outcome", "s.*").select("*", "y_to.*")
    # a loop without a body goes on to its update, or asks again
    asks = F.col("value") & F.col("y_parent").isin(*LOOPS) & F.col("to_body").isNull() & F.col("to_update").isNull() & (F.col("y_role") != "left")
    target = (
        F.when(F.col("y_role") == "left", F.col("y_right"))
        .when(F.col("value") & F.col("y_parent").isin("If", "Ternary"), F.col("to_true_part"))
        .when(~F.col("value") & F.col("y_parent").isin("If", "Ternary"), F.col("to_false_part"))
        .when(F.col("value"), F.coalesce("to_body", "to_update", "to_condition"))
    )
    met = stop.withColumn("target", target)
    entered = F.when(F.col("target").isNull(), F.coalesce("follow_again", F.lit(False))).otherwise(F.coalesce(asks, F.lit(False)))
    return met.select("file_id", F.col("block_id").alias("graph_id"), F.col("node_id").alias("src"), F.coalesce("target", "follow").alias("dst"), F.when(F.col("outcome"), "true").otherwise("false").alias("branch"), entered.alias("again"))


def _cases(steps: DataFrame, entry: DataFrame) -> DataFrame:
    """Edges from the cases of a switch: into their bodies, and to the next case."""
    switch = F.get(F.filter("steps", lambda a: (a["anc_kind"] == "Switch") & a["jump"].isNotNull()), F.lit(0))
    own = steps.where("is_condition and steps[0].up = 0 and steps[0].anc_kind = 'Case'").select(*KEY, "follow", "again", F.col("steps")[0]["next_case"].alias("next_case"), switch.alias("past"))
    own = own.join(entry.select(*KEY, "inner"), list(KEY), "left")
    kept = lambda c: F.coalesce(c, F.lit(False)).alias("again")
    yes = own.select("file_id", F.col("node_id").alias("src"), F.coalesce("inner", "follow").alias("dst"), F.lit("true").alias("branch"), kept(F.col("inner").isNull() & F.col("again")))
    no = own.select("file_id", F.col("node_id").alias("src"), F.coalesce("next_case", "past.jump", "follow").alias("dst"), F.lit("false").alias("branch"), kept(F.col("next_case").isNull() & F.coalesce("past.again", "again")))
    return yes.unionByName(no)


def _without_onward(edges: DataFrame) -> DataFrame:
    """The edges past the made jumps at the ends of copied finally blocks: what led to one leads to where it goes."""
    made = lambda c: what_is(F.col(c)) == ONWARD
    onward = durable(edges.where(made("src")).select("file_id", F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("again").alias("to_again")))
    if onward.isEmpty():
        return edges
    edges = edges.where(~made("src"))
    while True:
        met = edges.join(onward, ["file_id", "dst"], "left").select("file_id", "graph_id", "src", F.coalesce("to", "dst").alias("dst"), "branch", F.coalesce("to_again", "again").alias("again"))
        edges = durable(met.distinct())
        if edges.where(made("dst")).isEmpty():
            return edges


def is_gate(node: Column) -> Column:
    """Whether a name stands for the start or end of a body inside another graph."""
    return what_is(node).isin(ENTER, LEAVE)


def _spliced(nested: DataFrame, edges: DataFrame, inside: DataFrame) -> DataFrame:
    """The graphs with those of nested bodies put in behind what has them, between a start and an end of their own."""
    bodies = nested.select("file_id", F.col("owner_id").alias("src"), F.col("block_id"))
    bodies = durable(bodies.join(inside.withColumnRenamed("graph_id", "outer"), ["file_id", "src"]).join(edges.where(F.col("src") == START).select("file_id", F.col("graph_id").alias("block_id")), ["file_id", "block_id"], "left_semi"))
    if bodies.isEmpty():
        return edges
    root = durable(bodies.select("file_id", F.col("block_id").alias("graph_id"), F.col("outer").alias("root")))
    while not root.join(root.select("file_id", F.col("graph_id").alias("root")), ["file_id", "root"], "left_semi").isEmpty():
        further = root.select("file_id", F.col("graph_id").alias("root"), F.col("root").alias("further"))
        root = durable(root.join(further, ["file_id", "root"], "left").select("file_id", "graph_id", F.coalesce("further", "root").alias("root")))
    gate = lambda what: made_id(F.col("block_id"), what)
    none, no = F.lit(None).cast("string").alias("branch"), F.lit(False).alias("again")
    into = bodies.select("file_id", F.col("outer").alias("graph_id"), "src", gate(ENTER).alias("dst"), none, no)
    past = edges.join(bodies.select("file_id", "src", "block_id"), ["file_id", "src"], "left").withColumn("src", F.when(F.col("block_id").isNotNull(), gate(LEAVE)).otherwise(F.col("src"))).drop("block_id")
    mine = past.join(root.select("file_id", "graph_id", "root"), ["file_id", "graph_id"], "left").withColumn("block_id", F.col("graph_id"))
    nested = F.col("root").isNotNull()
    moved = mine.select(
        "file_id", F.coalesce("root", "graph_id").alias("graph_id"), F.when(nested & (F.col("src") == START), gate(ENTER)).otherwise(F.col("src")).alias("src"), F.when(nested & (F.col("dst") == END), gate(LEAVE)).otherwise(F.col("dst")).alias("dst"), "branch", "again"
    )
    into = into.join(root, ["file_id", "graph_id"], "left").withColumn("graph_id", F.coalesce("root", "graph_id")).drop("root")
    return moved.unionByName(into)


def _graph_key() -> Column:
    return F.struct("file_id", "graph_id")


def unit_reach(edges: DataFrame) -> DataFrame:
    """``(file_id, graph_id, node_id)`` that control flow reaches from the start of each graph; edges that tell whether they are ``early`` are not all walked."""
    return _walked(edges, START).select("root.file_id", "root.graph_id", F.col("node").alias("node_id"))


def _walked(edges: DataFrame, start: int) -> DataFrame:
    """``(root, node)`` that ``edges`` reach from the node ``start`` of each graph."""
    steps = edges.select(_graph_key().alias("root"), "src", "dst", *[c for c in edges.columns if c == "early"])
    seeds = steps.where(F.col("src") == start).select("root", F.col("src").alias("node")).distinct()
    if "early" not in steps.columns:
        return graph.reach(steps, seeds)
    return seeds.unionByName(steps.select("root", F.col("dst").alias("node"))).distinct().join(graph.unreached(steps, start), ["root", "node"], "left_anti")


def heads(edges: DataFrame) -> DataFrame:
    """``(file_id, graph_id, node_id, head, place, at)``: the unit that leads each unit's row of units without a branch, how far behind it the unit is, and
    the place of the leading one in the order of evaluation.

    A unit leads when it is entered by a branch, from the start of a body, or from
    more than one place; the others join their predecessor's row: at once where it stands right before them in the order of evaluation, in the same
    stretch of 2^:data:`SPAN` places, so that no graph is one task; such runs then find theirs by pointer doubling.
    """
    at = ["file_id", "graph_id"]
    real = edges.where((F.col("dst") != END) & ~F.col("again")).withColumn("near", F.shiftright("dst_at", SPAN)).repartition(*at, "near")
    hard = F.col("apart") | (F.col("src") == START) | F.col("branch").isNotNull() | is_gate(F.col("src")) | is_gate(F.col("dst"))
    into = real.groupBy(*at, "near", F.col("dst").alias("node_id")).agg(F.count("*").alias("n"), F.count_if(hard).alias("hard"), F.max("src").alias("only"), F.max("dst_at").alias("own"))
    leads = (F.col("n") > 1) | (F.col("hard") > 0)
    order = Window.partitionBy(*at, "near").orderBy("own", "node_id")
    rows = into.withColumns({"leads": leads, "n": F.row_number().over(order), "before": F.lag("node_id").over(order)})
    # what stands right behind its predecessor joins its run; runs that no unit leads begin behind one that is elsewhere
    opens = F.col("leads") | ~F.col("before").eqNullSafe(F.col("only"))
    run = F.last(F.when(opens, F.struct("node_id", "n", "leads", "own")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    point = rows.withColumn("run", run).select(*at, "node_id", "only", F.col("run.node_id").alias("head"), (F.col("n") - F.col("run.n")).cast("bigint").alias("place"), F.when(F.col("run.leads"), F.col("run.own")).alias("at"), F.col("run.leads").alias("led"))
    point = durable(point)
    done = point.select(*at, "node_id", "head", "place", "at")
    loose = durable(point.where("not led and node_id = head").select(*at, F.col("node_id").alias("run"), F.col("only").alias("node_id")))
    if loose.isEmpty():
        return done
    up = durable(loose.join(done, [*at, "node_id"]).select(*at, "run", "head", (F.col("place") + 1).alias("place"), "at"))
    for _ in range(up.count().bit_length() + 1):
        jump = up.select(*at, F.col("run").alias("head"), F.col("head").alias("next"), F.col("place").alias("more"), F.col("at").alias("found"))
        up = durable(up.join(jump, [*at, "head"], "left").select(*at, "run", F.coalesce("next", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.coalesce("at", "found").alias("at"), F.col("next").isNotNull().alias("open")))
        if up.where("open").isEmpty():
            break
    # what has no leader after that many steps goes round in a loop that nothing enters
    told = up.select(*at, F.col("run").alias("head"), F.col("head").alias("lead"), F.col("place").alias("more"), F.col("at").alias("lead_at"), "open")
    lost = F.coalesce("open", F.lit(False))
    moved = done.join(told, [*at, "head"], "left")
    return durable(moved.select(*at, "node_id", F.when(lost, F.col("node_id")).otherwise(F.coalesce("lead", "head")).alias("head"), F.when(lost, 0).otherwise(F.col("place") + F.coalesce("more", F.lit(0))).cast("bigint").alias("place"), F.when(~lost, F.coalesce("lead_at", "at")).alias("at")))


def _into_rows(edges: DataFrame, point: DataFrame) -> DataFrame:
    """``(file_id, graph_id, src, dst, src_at, dst_at, early)``: the steps between rows of units, which are named and placed by their leaders."""
    at = ["file_id", "graph_id"]
    lead = point.where("node_id = head").select(*at, F.col("node_id").alias("dst"), F.col("at").alias("lead_at"))
    row = point.select(*at, F.col("node_id").alias("src"), "head", "at")
    into = edges.drop("dst_at").join(lead, [*at, "dst"]).join(row, [*at, "src"], "left")
    early = (F.col("src") == START) | F.coalesce(F.col("at") < F.col("lead_at"), F.lit(False))
    return into.select(*at, F.coalesce("head", "src").alias("src"), "dst", F.col("at").alias("src_at"), F.col("lead_at").alias("dst_at"), early.alias("early"))


def _lost_rows(into: DataFrame) -> DataFrame:
    """``(file_id, graph_id, head)`` of the rows that no walk along :func:`_into_rows` reaches from the start."""
    lost = graph.unreached(into.select(_graph_key().alias("root"), "src", "dst", "early"), START)
    return lost.select("root.file_id", "root.graph_id", F.col("node").alias("head"))


def dead_units(edges: DataFrame, point: DataFrame) -> DataFrame:
    """``(file_id, graph_id, src)`` that control flow does not reach from the start: a row of units is reached whole, so only the
    steps between rows count."""
    at = ["file_id", "graph_id"]
    row = point.select(*at, F.col("node_id").alias("src"), "head")
    told = edges.where(F.col("src") != START).select(*at, "src").distinct()
    # what nothing enters leads no row
    return row.join(_lost_rows(_into_rows(edges, point)), [*at, "head"], "left_semi").select(*at, "src").join(told, [*at, "src"], "left_semi").unionByName(told.join(row.select(*at, "src"), [*at, "src"], "left_anti"))


def _peeled(into: DataFrame) -> DataFrame:
    """The steps of :func:`_into_rows` without those from rows that none of them enters, :data:`PEELS` times."""
    at = ["file_id", "graph_id"]
    for _ in range(PEELS):
        entered = into.select(*at, F.col("dst").alias("src")).distinct()
        into = durable(into.where(F.col("src") == START).unionByName(into.where(F.col("src") != START).join(entered, [*at, "src"], "left_semi").select(into.columns)))
    return into


def _before_gap(into: DataFrame) -> DataFrame:
    """The steps of :func:`_into_rows` before the first place of each graph that none of them crosses: nothing from there on is reached.

    The farthest place that what stands before a row leads to is a running maximum, in stretches of 2^:data:`SPAN` places.
    Steps from what has no place stand before all others.
    """
    at = ["file_id", "graph_id"]
    into = durable(into.withColumn("place", F.coalesce("src_at", F.lit(-(1 << 63)))).withColumn("near", F.shiftright("place", SPAN)))
    asked = into.select(*at, F.explode(F.array_compact(F.array("src_at", "dst_at"))).alias("place")).distinct().select(*at, F.shiftright("place", SPAN).alias("near"), "place", F.lit(None).cast("bigint").alias("to"))
    every = into.where("dst_at is not null").select(*at, "near", "place", F.col("dst_at").alias("to")).unionByName(asked)
    earlier = Window.partitionBy(*at).orderBy("near").rowsBetween(Window.unboundedPreceding, -1)
    tops = durable(every.groupBy(*at, "near").agg(F.max("to").alias("top")).withColumn("top", F.max("top").over(earlier)))
    # a row asks before what leaves it counts
    order = Window.partitionBy(*at, "near").orderBy("place", F.col("to").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = F.greatest(F.max("to").over(order), F.col("top"))
    gaps = every.join(tops, [*at, "near"]).withColumn("far", far).where("to is null and place > coalesce(far, place - 1)")
    gap = gaps.groupBy(*at).agg(F.min("place").alias("gap"))
    return into.join(tops.join(gap, at).select(*at, "near", "gap"), [*at, "near"], "left").where("gap is null or place < gap").drop("place", "near", "gap")


def live_units(nodes: DataFrame, barrier: Callable[[DataFrame], tuple[Column, Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(tree, live)``: the tree as control flow sees it, where ``is_condition`` is null but for units, and ``live(file_id, node_id)``, the units that control
    flow reaches along edges that can be taken, as :func:`keep_edges` has it; no blocks are formed for that."""
    at = ["file_id", "graph_id"]
    tree, bodies = _prepared(nodes)
    _, edges = _built(tree, bodies)
    point = heads(edges)
    into = durable(_before_gap(_peeled(durable(_into_rows(_taken(edges, nodes, barrier), point)))))
    entered = into.select(*at, F.col("dst").alias("head")).distinct().join(_lost_rows(into), [*at, "head"], "left_anti")
    return tree, durable(point.join(entered, [*at, "head"], "left_semi").select("file_id", origin_id(F.col("node_id")).alias("node_id")).distinct())


#: What a start or an end belongs to.
GRAPH_TYPES = ("METHOD_BODY_OR_STATIC_INITIALIZER_OR_INSTANCE_INITIALIZER", "LAMBDA")


def contract(u: DataFrame, edges: DataFrame, point: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cfg_nodes, cfg_edges, block_units)``: units in a row without a branch, as :func:`heads` finds them, form a basic block.

    A condition's leaf is evaluated at the end of its block, and a condition node
    follows it.  Blocks, and the starts and ends of nested bodies, are named 2 * leader, condition nodes 2 * leaf + 1.  ``graph_type`` tells the start
    and end of a nested body from those of the graph.  ``block_units`` has the units by their place in the block; a unit of a finally
    block that was copied is in several.  Edges are ``early`` that lead onward in the order of evaluation, as :func:`graph.unreached` needs it.
    """
    at = ["file_id", "graph_id"]
    conditions = u.where("is_condition").select("file_id", "node_id")
    gate = is_gate(F.col("node_id"))
    blocks = point.where(~gate).groupBy(*at, "head").agg(F.count("*").alias("units"))
    leaf = point.join(conditions, ["file_id", "node_id"])
    ends = edges.where((F.col("src") == START)).select(*at).distinct()
    named = lambda df, cfg_id, kind, guard=F.lit(None).cast("bigint"), type_=0: df.select(*at, cfg_id.cast("bigint").alias("cfg_id"), kind.alias("kind"), guard.alias("guard_node_id"), F.lit(GRAPH_TYPES[type_]).alias("graph_type"))
    cfg_nodes = reduce(DataFrame.unionByName, (
        named(blocks, F.col("head") * 2, F.lit("block")),
        named(leaf, F.col("node_id") * 2 + 1, F.lit("condition"), origin_id(F.col("node_id"))),
        named(point.where(gate), F.col("node_id") * 2, F.when(what_is(F.col("node_id")) == ENTER, "start").otherwise("end"), type_=1),
        named(ends, F.lit(START), F.lit("start")),
        named(ends, F.lit(END), F.lit("end")),
    ))
    row = point.select(*at, F.col("node_id").alias("src"), F.col("head").alias("src_head"), F.col("at").alias("src_at")).unionByName(ends.select(*at, F.lit(START).cast("bigint").alias("src"), F.lit(START).cast("bigint").alias("src_head"), F.lit(None).cast("bigint").alias("src_at")))
    lead = point.select(*at, F.col("node_id").alias("dst"), F.col("head").alias("dst_head"), F.col("at").alias("dst_at"))
    met = edges.drop("dst_at").join(row, [*at, "src"]).join(lead, [*at, "dst"], "left").where("again or dst_head is null or src_head <> dst_head or dst = dst_head")
    source = F.when(F.col("src") == START, F.lit(START)).when(F.col("branch").isNotNull(), F.col("src") * 2 + 1).otherwise(F.col("src_head") * 2)
    target = F.when(F.col("dst") == END, F.lit(END)).when(F.col("again"), F.col("dst") * 2 + 1).otherwise(F.col("dst_head") * 2)
    # a condition stands behind its block
    early = (F.col("src") == START) | (F.col("dst") == END) | F.coalesce((F.col("src_at") < F.col("dst_at")) | ((F.col("src_at") == F.col("dst_at")) & F.col("branch").isNull() & F.col("again")), F.lit(False))
    between = met.select(*at, source.alias("src"), target.alias("dst"), "branch", early.alias("early"))
    inner = leaf.select(*at, (F.col("head") * 2).alias("src"), (F.col("node_id") * 2 + 1).alias("dst"), F.lit(None).cast("string").alias("branch"), F.lit(True).alias("early"))
    members = point.where(~gate).select(*at, origin_id(F.col("node_id")).alias("node_id"), (F.col("head") * 2).alias("cfg_id"), "place")
    return cfg_nodes, between.unionByName(inner).distinct(), members


def control_flow(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`build`, without the code that is never reached, and :func:`contract`."""
    u, edges = build(nodes)
    point = heads(edges)
    dead = durable(dead_units(edges, point))
    if not dead.isEmpty():  # rows that only dead code kept apart grow together
        edges = durable(edges.join(dead, ["file_id", "graph_id", "src"], "left_anti"))
        point = heads(edges)
    return tuple(map(durable, contract(u, edges, point)))


def counts(cfg_nodes: DataFrame, cfg_edges: DataFrame) -> DataFrame:
    """``(file_id, graph_id, bb, cn, ex)``: basic blocks, condition nodes and predecessors of the end."""
    per = cfg_nodes.groupBy("file_id", "graph_id").agg(F.count_if(F.col("kind") == "block").alias("bb"), F.count_if(F.col("kind") == "condition").alias("cn"))
    exits = cfg_edges.where(F.col("dst") == END).groupBy("file_id", "graph_id").agg(F.count_distinct("src").alias("ex"))
    return per.join(exits, ["file_id", "graph_id"], "left").withColumn("ex", F.coalesce("ex", F.lit(0)))


def summary_text(counted: DataFrame) -> DataFrame:
    """``(file_id, graph_id, text)``: the counts in words."""
    return counted.select("file_id", "graph_id", F.format_string("BB: %d CN: %d EX: %d", "bb", "cn", "ex").alias("text"))


def keep_edges(cfg_edges: DataFrame, cfg_nodes: DataFrame, nodes: DataFrame, barrier: Callable[[DataFrame], tuple[Column, Column]] | None = None) -> DataFrame:
    """The edges that can be taken: a literal condition keeps one side, and a barrier guard closes the side it holds on.

    ``barrier`` gets the guards' nodes and returns two columns: is a barrier when true, when false.
    """
    told = cfg_nodes.where("kind = 'condition'").join(_shutting(nodes, barrier), ["file_id", "guard_node_id"], "left").withColumn("fixed", F.coalesce("fixed", _made_true())).select("file_id", "graph_id", F.col("cfg_id").alias("src"), "fixed", "shut_true", "shut_false")
    return cfg_edges.join(told, ["file_id", "graph_id", "src"], "left").where(_open()).select("file_id", "graph_id", "src", "dst", "branch", *[c for c in cfg_edges.columns if c == "early"])


def _shutting(nodes: DataFrame, barrier: Callable[[DataFrame], tuple[Column, Column]] | None) -> DataFrame:
    """The nodes that let only some outcomes through where they are conditions."""
    shut_true, shut_false = barrier(nodes) if barrier else (F.lit(False), F.lit(False))
    told = nodes.select("file_id", F.col("node_id").alias("guard_node_id"), F.when(F.col("kind") == "Literal", F.col("literal.value")).alias("fixed"), shut_true.alias("shut_true"), shut_false.alias("shut_false"))
    return told.where("fixed in ('true', 'false') or shut_true or shut_false")


def _made_true() -> Column:
    """The outcome of what is made for a loop without a condition."""
    return F.when(what_is(F.col("guard_node_id")) == TRUE, "true")


def _open() -> Column:
    """Whether an edge with what :func:`_shutting` says of its condition can be taken."""
    shut = F.when(F.col("fixed").isin("true", "false"), F.col("branch") != F.col("fixed")).when(F.col("branch") == "true", F.col("shut_true")).when(F.col("branch") == "false", F.col("shut_false"))
    return ~F.coalesce(shut, F.lit(False))


def _taken(edges: DataFrame, nodes: DataFrame, barrier: Callable[[DataFrame], tuple[Column, Column]] | None) -> DataFrame:
    """As :func:`keep_edges`, of the edges between units."""
    asked = edges.where("branch is not null").withColumn("guard_node_id", origin_id(F.col("src"))).join(_shutting(nodes, barrier), ["file_id", "guard_node_id"], "left").withColumn("fixed", F.coalesce("fixed", _made_true()))
    return edges.where("branch is null").unionByName(asked.where(_open()).select(edges.columns))


def reachable_blocks(kept: DataFrame) -> DataFrame:
    """``(file_id, graph_id, cfg_id)`` of what the kept edges reach from the start; a block that another way reaches stays."""
    return unit_reach(kept).withColumnRenamed("node_id", "cfg_id")


def may_stop(nodes: DataFrame, barrier: Callable[[DataFrame], tuple[Column, Column]] | None = None) -> Column:
    """Whether a node can keep control flow from something in its file; where none does, all code is reached."""
    shut = reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in (barrier(nodes) if barrier else ())], F.lit(False))
    return ~F.coalesce(F.col("kind").isin(*PLAIN), F.lit(False)) | F.coalesce(F.col("literal.value").isin("true", "false"), F.lit(False)) | shut


def reachable_members(blocks: DataFrame, block_units: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every tree node evaluated in a reachable block: its units and what lies inside them."""
    live = block_units.join(blocks, ["file_id", "graph_id", "cfg_id"], "left_semi").select("file_id", F.col("node_id").alias("anc_id"))
    pairs = ancestors(nodes, include_self=True, columns=("kind",))
    return pairs.join(live, ["file_id", "anc_id"], "left_semi").select(*KEY).distinct()


#: Kinds whose node is evaluated before its parts, those that are not entered, and those that are no members themselves.
BEFORE, CLOSED, UNNAMED = ("Assignment", "Parentheses", "ControlParentheses"), ("ArrayAccess", "ClassDeclaration"), ("FieldAccess", "NewArray", "MemberReference", "CompoundAssignment", "Label")
#: The places of the parts of a node; a part of another role comes first.
LATER_ROLES = {"argument": 1, "right": 1, "variable": 1, "name": 1}


def members(block_units: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(file_id, graph_id, cfg_id, place, pos, node_id)``: what is evaluated in each block, by the unit's place in it and the order inside the unit.

    A node's parts come before it: a receiver, the arguments, the call; the left side, the right side, the operator; the initializer, the declaration.  An
    assignment, parentheses and a *not* come before what they hold, and the right side of an assignment before its variable.
    What :func:`units` has as a unit of its own, or lies in a body inside, is left out of the unit around it; nodes that only steer, like a ternary, are no members.  Each node carries the places of its ancestors in their
    parents up to its unit, and sorts by them.
    """
    whole = durable(completed(nodes))
    before = F.col("kind").isin(*BEFORE) | F.coalesce(F.col("operator") == "Not", F.lit(False))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in LATER_ROLES.items() for x in r]), F.col("role")), F.lit(0))
    rank = F.when((F.col("parent_kind") == "CompoundAssignment") & (F.col("role") == "variable"), -1).otherwise(rank)
    compound = whole.where("kind = 'CompoundAssignment'").select("file_id", F.col("node_id").alias("parent_id"), F.lit("CompoundAssignment").alias("parent_kind"))
    asked = units(whole).select(*KEY, F.lit(True).alias("unit"))
    narrow = whole.select(*KEY, "parent_id", "kind", "role", "operator", "ordinal").join(compound, ["file_id", "parent_id"], "left").join(asked, list(KEY), "left")
    placed = durable(narrow.select(*KEY, "parent_id", "kind", ((rank + 1).cast("bigint") * (1 << 32) + F.col("ordinal")).alias("spot"), before.alias("before"), F.col("unit").isNotNull().alias("unit")))
    chained = chains(placed, include_self=True, columns=("kind", "spot", "before", "unit")).withColumn("u", F.get(F.filter("chain", lambda a: a["anc_unit"]), F.lit(0))).where("u is not null")
    up_to = chained.withColumn("chain", F.filter("chain", lambda a: a["up"] <= F.col("u.up")))
    path = F.reverse(F.transform(F.filter("chain", lambda a: a["up"] < F.col("u.up")), lambda a: a["anc_spot"]))
    closed = F.coalesce(F.exists("chain", lambda a: (a["up"] > 0) & a["anc_kind"].isin(*CLOSED, "Block", "ClassBody")), F.lit(False))
    told = up_to.select(*KEY, F.col("u.anc_id").alias("unit_id"), path.alias("path"), F.col("chain")[0]["anc_before"].alias("first"), F.col("chain")[0]["anc_kind"].alias("kind"), closed.alias("closed"))
    # nodes sort before or behind what lies under them
    key = F.concat("path", F.array(F.when(F.col("first"), F.lit(-1)).otherwise(F.lit((1 << 63) - 1)).cast("bigint")))
    shown = told.where(~F.col("closed") & ~F.col("kind").isin(*UNNAMED, "Block", "ClassBody", "DoWhile", "Empty", "Case", "Ternary")).withColumn("key", key)
    pos = F.row_number().over(Window.partitionBy("file_id", "unit_id").orderBy("key")) - 1
    ordered = shown.select("file_id", F.col("unit_id").alias("node_id"), F.col("node_id").alias("member"), pos.alias("pos"))
    return block_units.join(ordered, list(KEY)).select("file_id", "graph_id", "cfg_id", "place", "pos", F.col("member").alias("node_id"))


def all_nodes(cfg_edges: DataFrame) -> DataFrame:
    """``(file_id, graph_id, cfg_id)``: reached from the start, or leading to the end."""
    back = _walked(graph.backward(cfg_edges), END).select("root.file_id", "root.graph_id", F.col("node").alias("cfg_id"))
    return reachable_blocks(cfg_edges).unionByName(back).distinct()


def invalid(cfg_nodes: DataFrame, cfg_edges: DataFrame) -> DataFrame:
    """Nodes that break a rule, with the rule: a block or start without exactly one successor, a
    condition without one for each outcome, an end with one, but for that of a nested body, which goes on.  Empty for a sound graph."""
    out = cfg_edges.groupBy("file_id", "graph_id", F.col("src").alias("cfg_id")).agg(F.count("*").alias("n"), F.count_distinct("branch").alias("branches"))
    met = cfg_nodes.join(out, ["file_id", "graph_id", "cfg_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rule = F.when(F.col("kind").isin("block", "start") & (F.col("n") != 1), "one successor").when((F.col("kind") == "condition") & ((F.col("n") != 2) | (F.col("branches") != 2)), "two outcomes").when((F.col("kind") == "end") & (F.col("n") > F.when(F.col("graph_type") == GRAPH_TYPES[1], 1).otherwise(0)), "no successor")
    return met.withColumn("rule", rule).where("rule is not null").select("file_id", "graph_id", "cfg_id", "kind", "rule")


def check(cfg_nodes: DataFrame, cfg_edges: DataFrame) -> None:
    """An error that names some of the nodes that break a rule, if any does."""
    broken = invalid(cfg_nodes, cfg_edges).limit(5).collect()
    if broken:
        raise ValueError("control flow is unsound: " + "; ".join(f"{r['file_id']}, graph {r['graph_id']}, {r['kind']} {r['cfg_id']}: {r['rule']}" for r in broken))


def numbered(cfg_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(file_id, graph_id, node_id, label)``: block leaders nL and conditions nC (operator), numbered in document order."""
    at = F.when(F.col("kind") == "block", origin_id(F.expr("cfg_id div 2"))).otherwise(F.col("guard_node_id"))
    nodes = completed(nodes)
    seen = cfg_nodes.where("kind in ('block', 'condition')").select("file_id", "graph_id", "kind", at.alias("node_id")).distinct().join(nodes.select(*KEY, "pre", "operator"), list(KEY))
    n = F.row_number().over(Window.partitionBy("file_id", "graph_id", "kind").orderBy("pre"))
    mark = F.when(F.col("kind") == "block", F.concat(n, F.lit("L"))).otherwise(F.concat(n, F.lit("C"), F.coalesce(F.concat(F.lit(" ("), "operator", F.lit(")")), F.lit(""))))
    return seen.select("file_id", "graph_id", "node_id", mark.alias("label"))


def dot(cfg_nodes: DataFrame, cfg_edges: DataFrame, text: DataFrame, dark: bool = False, kept: DataFrame | None = None) -> DataFrame:
    """``(file_id, graph_id, dot)``: one drawing a graph; ``text(file_id, cfg_id, label)``.

    Nodes stand in the order start, block, condition, end and then by label;
    edges say which outcome they follow, and that they are unreachable where they are not among ``kept``, if given.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in (("start", 0), ("block", 1), ("condition", 2), ("end", 3)) for x in pair]), F.col("kind"))
    shape = F.element_at(F.create_map(*[F.lit(x) for pair in (("start", "circle"), ("block", "box"), ("condition", "diamond"), ("end", "circle")) for x in pair]), F.col("kind"))
    named = cfg_nodes.join(text, ["file_id", "cfg_id"], "left").withColumn("label", F.coalesce("label", F.initcap("kind")))
    order = Window.partitionBy("file_id", "graph_id").orderBy(rank, "label", "cfg_id")
    named = named.withColumn("n", F.row_number().over(order) - 1)
    line = F.concat(F.lit("    "), "n", F.lit(" [shape="), shape, F.lit(', label="'), F.regexp_replace("label", '(["\\\\])', r"\\$1"), F.lit('"];'))
    boxes = named.groupBy("file_id", "graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), "\n").alias("boxes"))
    ids = named.select("file_id", "graph_id", "cfg_id", "n")
    met = cfg_edges.join(ids.withColumnsRenamed({"cfg_id": "src", "n": "a"}), ["file_id", "graph_id", "src"]).join(ids.withColumnsRenamed({"cfg_id": "dst", "n": "b"}), ["file_id", "graph_id", "dst"])
    shut = F.lit(False)
    if kept is not None:
        open_ = kept.select("file_id", "graph_id", "src", "dst", F.coalesce("branch", F.lit("")).alias("way")).distinct().withColumn("open", F.lit(True))
        met = met.withColumn("way", F.coalesce("branch", F.lit(""))).join(open_, ["file_id", "graph_id", "src", "dst", "way"], "left")
        shut = F.col("open").isNull()
    style = F.when(shut, ' [label="Unreachable", color="grey", style="dashed"]').when(F.col("branch") == "true", ' [label="True", color="green"]').when(F.col("branch") == "false", ' [label="False", color="red"]').otherwise("")
    arrow = F.concat(F.lit("    "), "a", F.lit(" -> "), "b", style, F.lit(";"))
    arrows = met.groupBy("file_id", "graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", arrow.alias("t")))), lambda x: x["t"]), "\n").alias("arrows"))
    head = "digraph cfg {\n" + ('    bgcolor="black"; node [color="white", fontcolor="white"]; edge [fontcolor="white"];\n' if dark else "")
    return boxes.join(arrows, ["file_id", "graph_id"], "left").select("file_id", "graph_id", F.concat(F.lit(head), "boxes", F.lit("\n"), F.coalesce("arrows", F.lit("")), F.lit("\n}")).alias("dot"))
