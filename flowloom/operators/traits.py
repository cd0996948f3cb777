"""Typed views over ``nodes``: filters and projections, with what a parent's role decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CALLS, STATEMENTS
from .tree import KEY, ancestors, chains, nearest_in, parents

#: Parent kind and role in which an identifier is a name, not an access to a variable (null: any role).
NOT_VARIABLES = [
    ("FieldAccess", "name_of_member"), ("MethodInvocation", "name"), ("NewClass", "class"), ("VariableDeclaration", "name"), ("MethodDeclaration", "name"),
    ("MethodDeclaration", "return_type"), ("VariableDeclaration", "type"), ("Annotation", None), ("Import", None), ("Package", None), ("ClassDeclaration", None),
    ("TypeCast", "type"), ("InstanceOf", "type"), ("TypeParameter", None), ("ParameterizedType", None), ("ArrayType", None), ("Label", None), ("Break", None),
    ("Continue", None), ("MemberReference", "name"), ("Catch", "type"), ("Case", "type"), ("NewArray", "type"),
]


def first_of(*views: tuple[Column, Column]) -> Column:
    """The value of the first view whose condition holds; null when none does."""
    return F.coalesce(*[F.when(test, value) for test, value in views])


def _value(kind: str):
    return F.col("kind") == kind


def instance_access() -> Column:
    """'this' or 'super', bare or qualified; null else."""
    return F.when(F.col("kind").isin("Identifier", "FieldAccess") & F.col("name").isin("this", "super"), F.col("name"))


def var_access(nodes: DataFrame) -> DataFrame:
    """Identifiers that access a variable, with is_lvalue, is_rvalue and has_qualifier.

    An l-value is the target of an assignment or the operand of any unary; an
    r-value is whatever is no assignment target, so targets of compound
    assignments are read as well.
    """
    ids = parents(nodes, "kind", "role").where("kind = 'Identifier' and name not in ('this', 'super')")
    barred = F.lit(False)
    for kind, role in NOT_VARIABLES:
        barred = barred | ((F.col("parent_kind") == kind) & ((F.col("role") == role) if role else F.lit(True)))
    target = (F.col("parent_kind") == "Assignment") & (F.col("role") == "variable")
    either = target | ((F.col("parent_kind") == "CompoundAssignment") & (F.col("role") == "variable")) | (F.col("parent_kind") == "Unary")
    return ids.where(~F.coalesce(barred, F.lit(False))).select(*KEY, "name", "owner", "pre", "post", "parent_id", "role", F.coalesce(either, F.lit(False)).alias("is_lvalue"), F.coalesce(~target, F.lit(True)).alias("is_rvalue"), F.coalesce(F.col("parent_kind") == "FieldAccess", F.lit(False)).alias("has_qualifier"))


def expressions(nodes: DataFrame) -> DataFrame:
    """Every expression with its view's name: instance access, variable access, literal, call, binary or fallback."""
    kinds = ("Identifier", "FieldAccess", "Literal", "MethodInvocation", "NewClass", "Binary", "Unary", "Ternary", "Lambda", "MemberReference", "TypeCast", "Parentheses", "ArrayAccess", "InstanceOf", "Assignment", "CompoundAssignment", "NewArray", "SwitchExpression")
    access = var_access(nodes).select(*KEY, F.lit(True).alias("is_access"))
    e = parents(nodes, "kind").where(F.col("kind").isin(*kinds)).join(access, list(KEY), "left")
    hidden = ((F.col("kind") == "Identifier") & (F.coalesce("parent_kind", F.lit("")) != "Javadoc")) | ((F.col("kind") == "FieldAccess") & (F.coalesce("parent_kind", F.lit("")) == "Import"))
    view = first_of(
        (instance_access().isNotNull(), F.lit("InstanceAccess")),
        (F.coalesce("is_access", F.lit(False)), F.lit("VarAccess")),
        (_value("Literal"), F.lit("Literal")),
        (_value("MethodInvocation"), F.lit("MethodAccess")),
        (_value("Binary"), F.lit("BinaryExpr")),
        (_value("NewClass"), F.lit("ClassInstanceExpr")),
        (~hidden, F.lit("ExprFallback")),
    )
    return e.withColumn("expr_kind", view).where("expr_kind is not null").select(*KEY, "kind", "expr_kind", "pre", "post", "parent_id", "role")


def calls(nodes: DataFrame) -> DataFrame:
    """Method and constructor calls with their type and how many arguments they have."""
    c = nodes.where(F.col("kind").isin(*CALLS)).select(*KEY, "kind", "method_type", "pre", "post")
    args = nodes.where("role = 'argument' and kind <> 'Empty'").groupBy("file_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_args"))
    return c.join(args, list(KEY), "left").withColumn("n_args", F.coalesce("n_args", F.lit(0)))


def binaries(nodes: DataFrame) -> DataFrame:
    """Binary expressions with the ids of both sides."""
    sides = nodes.where("role in ('left', 'right')").groupBy("file_id", F.col("parent_id").alias("node_id")).agg(F.max(F.when(F.col("role") == "left", F.col("node_id"))).alias("left_id"), F.max(F.when(F.col("role") == "right", F.col("node_id"))).alias("right_id"))
    return nodes.where("kind = 'Binary'").select(*KEY, "operator", "type").join(sides, list(KEY))


def statements(nodes: DataFrame) -> DataFrame:
    """Statements; returns are told apart, the rest (throw and try too) fall back."""
    return nodes.where(F.col("kind").isin(*STATEMENTS)).select(*KEY, "kind", F.when(F.col("kind") == "Return", "ReturnStmt").otherwise("StmtFallback").alias("stmt_kind"))


def methods(nodes: DataFrame, type_methods: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """Callables: method declarations, lambdas and initializer blocks, with a name and a return type (void where there is none).

    A lambda that does not say which method it implements takes the name from ``type_methods(type, name, arity, flags)``, by its type and how many
    parameters it has, own and inherited over ``types(sub, super)``; see :func:`single_abstract_methods`.
    """
    if type_methods is not None:
        given = nodes.where("role = 'parameter'").groupBy("file_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("arity"))
        sam = single_abstract_methods(inherited_methods(type_methods, types)).select("type", "arity", F.col("name").alias("sam"))
        nodes = nodes.join(given, list(KEY), "left").withColumn("arity", F.when(F.col("kind") == "Lambda", F.coalesce("arity", F.lit(0)))).join(sam.withColumn("arity", F.col("arity").cast("bigint")), ["type", "arity"], "left")
    else:
        nodes = nodes.withColumn("sam", F.lit(None).cast("string"))
    name = first_of(((F.col("role") == "static_init"), F.lit("<clinit>")), ((F.col("role") == "instance_init"), F.lit("<obinit>")), ((F.col("kind") == "Lambda"), F.coalesce("method_type.name", "sam", F.lit("<lambda>"))), ((F.col("kind") == "MethodDeclaration"), F.col("name")))
    return nodes.where("kind in ('MethodDeclaration', 'Lambda') or role in ('static_init', 'instance_init')").select(*KEY, "kind", name.alias("method_name"), F.coalesce("method_type.ret", F.lit("void")).alias("return_type"))


def inherited_methods(type_methods: DataFrame, types: DataFrame | None) -> DataFrame:
    """``type_methods`` with those that types inherit, a default one in place of what it overrides."""
    columns = ["type", "name", "arity", "flags"]
    own = type_methods.select(*columns)
    if types is not None:
        own = own.unionByName(own.withColumnRenamed("type", "super").join(types, "super").select(F.col("sub").alias("type"), *columns[1:])).dropDuplicates(columns)
    filled = own.where("array_contains(flags, 'Default')").select("type", "name", "arity").distinct()
    return own.where("array_contains(flags, 'Default')").unionByName(own.where("not array_contains(flags, 'Default')").join(filled, ["type", "name", "arity"], "left_anti"))


def single_abstract_methods(type_methods: DataFrame) -> DataFrame:
    """Of ``type_methods(type, name, arity, flags)``, the one that a lambda of that arity implements; none where several do."""
    open_ = type_methods.where("not array_contains(flags, 'Static') and not array_contains(flags, 'Default')")
    return open_.groupBy("type", "arity").agg(F.count("*").alias("n"), F.first("name").alias("name")).where("n = 1").drop("n")


def variables(nodes: DataFrame) -> DataFrame:
    """Declared variables as Parameter (with its position), Field or LocalVariable."""
    declared = nodes.where("kind = 'VariableDeclaration'")
    found = nearest_in(chains(nodes, declared, columns=("kind",)), lambda a: a["anc_kind"].isin("MethodDeclaration", "Lambda", "ClassDeclaration", "ClassBody"), "kind")
    place = Window.partitionBy("file_id", "parent_id").orderBy("pre")
    parameter = F.coalesce(F.col("role") == "parameter", F.lit(False))
    placed = declared.where(parameter).withColumn("position", F.row_number().over(place) - 1)
    kind = first_of((F.col("role") == "parameter", F.lit("Parameter")), (F.col("found_kind").isin("ClassDeclaration", "ClassBody"), F.lit("Field")), (F.lit(True), F.lit("LocalVariable")))
    every = declared.where(~parameter).withColumn("position", F.lit(None).cast("int")).unionByName(placed)
    return every.join(found, list(KEY), "left").select(*KEY, "name", "owner", kind.alias("variable_kind"), "position", F.array_contains("flags", "Varargs").alias("is_varargs"), F.col("found_id").alias("callable_id"))


def guards(nodes: DataFrame) -> DataFrame:
    """What can steer control flow: switch cases, and expressions that are boolean by type, operator or place."""
    boolean = F.col("type").isin("boolean", "java.lang.Boolean", "kotlin.Boolean")
    operator = F.col("operator").isin("And", "Or", "Not", "Equal", "NotEqual", "LessThan", "GreaterThan", "LessThanOrEqual", "GreaterThanOrEqual")
    place = (F.col("role") == "condition") | ((F.col("parent_kind") == "Unary") & (F.col("parent_operator") == "Not")) | ((F.col("parent_kind") == "Binary") & F.col("parent_operator").isin("And", "Or"))
    returned = (F.col("kind") == "MethodInvocation") & (F.col("method_type.ret") == "boolean")
    kind = first_of((F.col("kind") == "Case", F.lit("case")), (boolean | operator | returned | (F.col("kind") == "InstanceOf") | place, F.lit("expression")))
    e = parents(nodes, "kind", "operator").where("kind not in ('Block', 'If', 'Parentheses')")
    return e.withColumn("guard_kind", kind).where("guard_kind is not null").select(*KEY, "guard_kind")


def arguments(nodes: DataFrame, position: int | None = None) -> DataFrame:
    """Arguments of the direct parent call, all or the one at ``position``; a negative position is an error."""
    if position is not None and position < 0:
        raise ValueError("a position can't be negative")
    a = parents(nodes, "kind", "method_type").where(F.col("parent_kind").isin(*CALLS) & (F.col("role") == "argument"))
    return (a if position is None else a.where(F.col("ordinal") == position)).select(*KEY, "ordinal", F.col("parent_id").alias("call_id"), F.col("parent_method_type").alias("method_type"))


def parameters_filled(nodes: DataFrame, position: int) -> DataFrame:
    """Arguments that fill the parameter at ``position``; the last one of a varargs method takes all that follow."""
    last = F.size("method_type.params") - 1
    many = F.array_contains("method_type.flags", "Varargs") & (F.lit(position) == last)
    return arguments(nodes).where(F.when(many, F.col("ordinal") >= position).otherwise((F.col("ordinal") == position) & (F.lit(position) <= last)))


def selects(nodes: DataFrame) -> DataFrame:
    """Nodes on the receiver side of the nearest enclosing method call: ``(file_id, node_id, call_id)``."""
    pairs = ancestors(nodes, include_self=True, columns=("kind", "role"))
    call = pairs.where("anc_kind = 'MethodInvocation' and up > 0").groupBy(*KEY).agg(F.min(F.struct("up", "anc_id")).alias("c"))
    below = pairs.select(*KEY, F.col("up").alias("below"), "anc_role")
    return call.join(below, list(KEY)).where("below = c.up - 1 and below = 0 and anc_role = 'select'").select(*KEY, F.col("c.anc_id").alias("call_id"))


def views_or_errors(nodes: DataFrame, **views: Column) -> DataFrame:
    """``(file_id, node_id, view, errors)``: the first view that accepts a node, or why each does not."""
    view = first_of(*[(test, F.lit(name)) for name, test in views.items()])
    errors = F.array(*[F.concat(F.lit(f"{name} expected, found "), "kind") for name in views])
    return nodes.select(*KEY, view.alias("view"), F.when(view.isNull(), errors).otherwise(F.array().cast("array<string>")).alias("errors"))


def field_key(owner: Column, name: Column, type_: Column) -> Column:
    """A stable identity for a field that is known from its type alone."""
    return F.md5(F.concat_ws("#", owner, name, type_))
