"""Variables: what an access refers to, what is assigned, constant folding, and local flow with kills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import durable
from .traits import field_key, var_access
from .tree import KEY, ancestors, chains, nearest


def declarations(nodes: DataFrame) -> DataFrame:
    """``(file_id, node_id, name, owner, pre)`` of every declared variable."""
    return nodes.where("kind = 'VariableDeclaration' and name is not null").select(*KEY, "name", "owner", "pre")


def resolve(accesses: DataFrame, decls: DataFrame) -> DataFrame:
    """Each access with ``decl_id``: the nearest declaration before it in document order with its name and owner.

    An as-of join by one window over the union of both sides: linear in a hot
    owner too, where an interval join would compare each pair.  No declaration
    gives null (a field of another type, or an error).
    """
    both = decls.select("file_id", "name", "owner", "pre", F.col("node_id").alias("decl"), F.lit(None).cast("bigint").alias("node_id")).unionByName(accesses.select("file_id", "name", "owner", "pre", F.lit(None).cast("bigint").alias("decl"), "node_id"))
    before = Window.partitionBy("file_id", "owner", "name").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("decl_id", F.last("decl", ignorenulls=True).over(before)).where("node_id is not null").select(*KEY, "name", "owner", "pre", "decl_id")


def resolve_fields(resolved: DataFrame, nodes: DataFrame, fields: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """``(file_id, node_id, owner, field_id)`` of accesses that no declaration explains: the field of that name of the type whose method or
    body they are in, or the nearest one above it that has some.

    ``fields(type, name, field_type)`` are declared ones, ``types(sub, super)`` the closure of the hierarchy; ``field_id`` is :func:`traits.field_key`.
    A field of a type hides those of the types above it; where two unrelated types have one, the first by name is taken.
    """
    open_ = resolved.where("decl_id is null").select(*KEY, "name")
    inner = F.col("anc_kind").isin("MethodDeclaration", "ClassDeclaration")
    around = nearest(ancestors(nodes, open_, columns=("kind", "type", "method_type")).where(inner & (F.coalesce("anc_method_type.declaring", "anc_type").isNotNull())), F.lit(True), "type", "method_type", "kind")
    at = around.select(*KEY, F.when(F.col("found_kind") == "MethodDeclaration", F.col("found_method_type.declaring")).otherwise(F.col("found_type")).alias("type"))
    held = fields.select(F.col("type").alias("owner"), "name", "field_type")
    own = held.withColumn("type", F.col("owner"))
    if types is not None:
        up = types.select(F.col("sub").alias("type"), F.col("super").alias("owner"))
        own = own.unionByName(held.join(up, "owner").select(own.columns))
        below = own.select("type", "name", F.col("owner").alias("sub")).join(types, "sub").select("type", "name", F.col("super").alias("owner"))
        own = own.join(below, ["type", "name", "owner"], "left_anti")
    first = own.groupBy("type", "name").agg(F.min(F.struct("owner", "field_type")).alias("f"))
    return open_.join(at, list(KEY)).join(first, ["type", "name"]).select(*KEY, F.col("f.owner").alias("owner"), field_key(F.col("f.owner"), F.col("name"), F.col("f.field_type")).alias("field_id"))


def accesses_in_scope(resolved: DataFrame, scopes: DataFrame) -> DataFrame:
    """Accesses inside ``scopes(file_id, scope_pre, scope_post, decl_id)`` that refer to its variable."""
    return resolved.join(scopes, ["file_id", "decl_id"]).where("scope_pre <= pre and scope_post >= pre").select(*KEY, "decl_id")


def assigned_values(nodes: DataFrame) -> DataFrame:
    """``(file_id, decl_id, value_id, pre)``: the initializers of variables and the right sides of assignments to them."""
    start = nodes.where("role = 'initializer'").select("file_id", F.col("parent_id").alias("decl_id"), F.col("node_id").alias("value_id"), "pre")
    targets = resolve(var_access(nodes).where("is_lvalue and role = 'variable'"), declarations(nodes)).where("decl_id is not null")
    stmt = nodes.where("role = 'variable'").select(*KEY, F.col("parent_id").alias("stmt_id"))
    right = nodes.where("role = 'assignment'").select("file_id", F.col("parent_id").alias("stmt_id"), F.col("node_id").alias("value_id"), F.col("pre").alias("value_pre"))
    later = targets.join(stmt, list(KEY)).join(right, ["file_id", "stmt_id"]).select("file_id", "decl_id", "value_id", F.col("value_pre").alias("pre"))
    return start.unionByName(later)


def fold_constants(nodes: DataFrame) -> DataFrame:
    """``(file_id, node_id, constant_id, literal)`` for every read: the only value that its variable ever gets, else the read itself.

    ``literal`` is that value when it is a literal, else null.
    """
    single = assigned_values(nodes).groupBy("file_id", "decl_id").agg(F.count("*").alias("n"), F.min("value_id").alias("value_id")).where("n = 1").drop("n")
    reads = resolve(var_access(nodes).where("is_rvalue"), declarations(nodes))
    found = reads.join(single, ["file_id", "decl_id"], "left").withColumn("constant_id", F.coalesce("value_id", "node_id"))
    literals = nodes.where("kind = 'Literal'").select("file_id", F.col("node_id").alias("constant_id"), F.col("literal.value").alias("literal"))
    return found.join(literals, ["file_id", "constant_id"], "left").select(*KEY, "constant_id", "literal")


def literals_of(folded: DataFrame, as_type: str) -> DataFrame:
    """Folded reads whose constant is a literal of ``as_type``; others are left out."""
    return folded.where("literal is not null").withColumn("value", F.col("literal").try_cast(as_type)).where("value is not null").select(*KEY, "constant_id", "value")


def _visible(nodes: DataFrame, with_reads: bool) -> DataFrame:
    """``(file_id, node_id, seen_id)``: the last binding of its name that each read sees.

    Declarations and plain assignments bind a name; each kills what the name held.
    A block works on a copy of its surroundings, so what is bound in a branch
    is forgotten behind it: a binding is seen from its own block and the blocks
    inside it.  A read therefore asks each block around it for the last
    binding before it, and the latest of the answers wins.  That is one window
    over bindings and questions for each name and block.
    """
    named = nodes.where("kind in ('VariableDeclaration', 'Identifier')")
    holds = F.col("kind").isin("Block", "MethodDeclaration", "Lambda")
    blocks = durable(chains(nodes, named, columns=("kind",), keep=(), only=F.coalesce(holds, F.lit(False))).select(*KEY, F.transform("chain", lambda a: a["anc_id"]).alias("around")).where(F.size("around") > 0))
    access = durable(var_access(nodes))
    stmt = nodes.where("kind = 'Assignment'").select("file_id", F.col("node_id").alias("parent_id"), F.col("post").alias("at"))
    bindings = nodes.where("kind = 'VariableDeclaration'").select(*KEY, "name", "owner", F.col("post").alias("at"), F.col("node_id").alias("seen_id")).unionByName(
        access.where("role = 'variable' and not is_rvalue").join(stmt, ["file_id", "parent_id"]).select(*KEY, "name", "owner", "at", F.col("parent_id").alias("seen_id"))
    )
    reads = access.where("is_rvalue")
    if with_reads:
        bindings = bindings.unionByName(reads.select(*KEY, "name", "owner", F.col("pre").alias("at"), F.col("node_id").alias("seen_id")))
    inner = blocks.select(*KEY, F.col("around")[0].alias("anc_id"))
    # a read asks before it binds
    bound = bindings.join(inner, list(KEY)).select("file_id", "name", "owner", "anc_id", (F.col("at") * 2 + 1).alias("at"), "seen_id", F.lit(None).cast("bigint").alias("read_id"))
    asked = reads.join(blocks, list(KEY)).withColumn("anc_id", F.explode("around")).select("file_id", "name", "owner", "anc_id", (F.col("pre") * 2).alias("at"), F.lit(None).cast("bigint").alias("seen_id"), F.col("node_id").alias("read_id"))
    before = Window.partitionBy("file_id", "owner", "name", "anc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("seen_id").isNotNull(), F.struct("at", "seen_id")), ignorenulls=True).over(before)
    answers = bound.unionByName(asked).withColumn("seen", seen).where("read_id is not null and seen is not null")
    return answers.groupBy("file_id", F.col("read_id").alias("node_id")).agg(F.max("seen").alias("s")).select(*KEY, F.col("s.seen_id").alias("seen_id"))


def reaching_writes(nodes: DataFrame) -> DataFrame:
    """``(file_id, node_id, write_id)``: the write that each read sees."""
    return _visible(nodes, False).withColumnRenamed("seen_id", "write_id")


def flow_before(nodes: DataFrame) -> DataFrame:
    """``(file_id, node_id, seen_id)``: the write or earlier read that a read's value flows on from.

    Reads of one write form a chain, so that what a call does to a variable that it
    is given reaches the reads behind it, and few edges leave a node.
    """
    return _visible(nodes, True)
