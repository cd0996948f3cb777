"""Steps and sinks that external models describe, by joins on the method's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matching import canonical_kinds, positions, signature_matches
from . import graph
from .traits import arguments
from .tree import lambda_results, parents


def hierarchy(type_edges: DataFrame) -> DataFrame:
    """``(sub, super)``: the closure of ``type_edges(fqn, super_fqn)``, without each type itself."""
    edges = type_edges.select(F.col("fqn").alias("src"), F.col("super_fqn").alias("dst"))
    return graph.reach(edges, edges.select(F.col("src").alias("root"), F.col("src").alias("node"))).where("root <> node").select(F.col("root").alias("sub"), F.col("node").alias("super"))


def used_methods(calls: DataFrame) -> DataFrame:
    """The distinct methods that are called."""
    return calls.select("method_type").distinct()


def models_in_use(used: DataFrame, models: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """``(method_type, <model>)`` of each method that a model matches.

    The join's key is the method's name; the declaring type must be the model's
    or, when the model covers subtypes and ``types(sub, super)`` is given, below it.
    """
    u = used.select("method_type", F.col("method_type.name").alias("lookup"), F.col("method_type.declaring").alias("declaring"))
    own = u.withColumn("via", F.col("declaring"))
    if types is not None:
        up = types.select(F.col("sub").alias("declaring"), F.col("super").alias("via"))
        own = own.unionByName(u.join(up, "declaring").select(u.columns + ["via"]))
    m = models.withColumnRenamed("lookup", "model_lookup")
    met = own.join(m, (own["lookup"] == m["model_lookup"]) & (own["via"] == m["fqn"]))
    ok = (F.col("via") == F.col("declaring")) | F.col("subtypes")
    return met.where(ok & signature_matches(F.col("method_type.params"), F.col("signature"))).drop("lookup", "model_lookup", "via", "declaring").distinct()


def model_steps(used_models: DataFrame) -> DataFrame:
    """``(method_type, kind, shape, src_pos, dst_pos)``: each model's steps, a row a position.

    Shapes: to the return value (any readable output of a constructor counts as
    that), to the receiver, to another argument.  An argument to itself is no step.
    """
    plain = used_models.where("from_ is not null and to_ is not null and from_.callback = 'NONE' and to_.callback = 'NONE' and from_.root = 'ARGUMENT'")
    src = plain.withColumn("src_pos", F.explode(positions(F.col("from_.range"))))
    out = F.when(F.col("method_type.name") == "<constructor>", F.array(F.lit(None).cast("int"))).when(F.col("to_.root") == "RETURN_VALUE", F.array(F.lit(None).cast("int"))).otherwise(positions(F.col("to_.range")))
    dst = src.withColumn("dst_pos", F.explode(out))
    shape = F.when(F.col("dst_pos").isNull(), "return").when(F.col("dst_pos") == -1, "receiver").otherwise("argument")
    return dst.withColumn("shape", shape).where("dst_pos is null or src_pos <> dst_pos").select("method_type", "kind", "shape", "src_pos", "dst_pos").distinct()


def model_callbacks(used_models: DataFrame) -> DataFrame:
    """``(method_type, kind, direction, callback_arg, parameter, other)``: flow into a lambda's parameter or out of its result."""
    into = used_models.where("from_.callback = 'NONE' and from_.root = 'ARGUMENT' and to_.callback = 'PARAMETER'").select("method_type", "kind", F.lit("INTO").alias("direction"), F.explode(positions(F.col("to_.range"))).alias("callback_arg"), "from_", "to_")
    into = into.select("method_type", "kind", "direction", "callback_arg", F.explode(positions(F.col("to_.callback_range"))).alias("parameter"), "from_").select("method_type", "kind", "direction", "callback_arg", "parameter", F.explode(positions(F.col("from_.range"))).alias("other"))
    out = used_models.where("from_.callback = 'RETURN_VALUE' and to_ is not null and to_.callback = 'NONE'").withColumn("other", F.explode(F.when(F.col("to_.root") == "RETURN_VALUE", F.array(F.lit(None).cast("int"))).otherwise(positions(F.col("to_.range")))))
    out = out.select("method_type", "kind", F.lit("OUT").alias("direction"), F.explode(positions(F.col("from_.range"))).alias("callback_arg"), F.lit(None).cast("int").alias("parameter"), "other")
    return into.unionByName(out).distinct()


def step_edges(call_args: DataFrame, steps: DataFrame, kinds: tuple[str, ...] = ("value",)) -> DataFrame:
    """``(file_id, src, dst, kind)`` at each call: ``call_args(file_id, call_id, position, node_id, method_type)``, position -1 for the receiver."""
    at = call_args.join(steps.where(F.col("kind").isin(*kinds)), "method_type").where("position = src_pos")
    back = at.where("shape = 'return'").select("file_id", F.col("node_id").alias("src"), F.col("call_id").alias("dst"), "kind")
    other = call_args.select("file_id", "call_id", F.col("position").alias("dst_pos"), F.col("node_id").alias("dst"))
    side = at.where("shape <> 'return'").join(other, ["file_id", "call_id", "dst_pos"]).select("file_id", F.col("node_id").alias("src"), "dst", "kind")
    return back.unionByName(side).distinct()


def sink_shapes(used_models: DataFrame) -> DataFrame:
    """``(method_type, kind, shape, position)``: sinks that are an argument, a return value or what a lambda argument returns."""
    arg = used_models.where("from_.root = 'ARGUMENT' and from_.callback <> 'PARAMETER'").select("method_type", "kind", F.when(F.col("from_.callback") == "RETURN_VALUE", "callback").otherwise("argument").alias("shape"), F.explode(positions(F.col("from_.range"))).alias("position"))
    ret = used_models.where("from_.root = 'RETURN_VALUE'").select("method_type", "kind", F.lit("return").alias("shape"), F.lit(None).cast("int").alias("position"))
    return arg.unionByName(ret).distinct()


def sink_nodes(call_args: DataFrame, shapes: DataFrame, kind: str, results: DataFrame | None = None) -> DataFrame:
    """``(file_id, node_id)`` of the sinks of a kind, by its current or a former name.

    Of a callback, what it returns is the sink: ``results(file_id, node_id, lambda_id)``, those of :func:`tree.lambda_results`.  Without
    them, a model of a callback has no sinks.
    """
    wanted = canonical_kinds(F.lit(kind))
    met = shapes.where(F.array_contains(wanted, F.col("kind")))
    given = call_args.join(met.where("shape <> 'return'").withColumnRenamed("position", "at").drop("kind"), "method_type").where("position = at").select("file_id", "node_id", "shape")
    args = given.where("shape = 'argument'").select("file_id", "node_id")
    if results is not None:
        args = args.unionByName(given.where("shape = 'callback'").select("file_id", F.col("node_id").alias("lambda_id")).join(results, ["file_id", "lambda_id"]).select("file_id", "node_id"))
    calls = call_args.select("file_id", F.col("call_id").alias("node_id"), "method_type").distinct().join(met.where("shape = 'return'").select("method_type"), "method_type").select("file_id", "node_id")
    return args.unionByName(calls).distinct()


def model_sinks(nodes: DataFrame, models: DataFrame, kind: str, types: DataFrame | None = None) -> DataFrame:
    """``(file_id, node_id)`` of the sinks of a kind that models describe in ``nodes``: arguments, calls, and what callbacks return."""
    args = call_arguments(nodes)
    return sink_nodes(args.drop("kind"), sink_shapes(models_in_use(used_methods(args), models, types)), kind, lambda_results(nodes))


def call_arguments(nodes: DataFrame) -> DataFrame:
    """``(file_id, call_id, position, node_id, method_type, kind)`` of every receiver (position -1) and argument."""
    kinds = nodes.select("file_id", "node_id", "kind")
    given = arguments(nodes).select("file_id", "call_id", F.col("ordinal").alias("position"), "node_id", "method_type")
    receiver = parents(nodes, "kind", "method_type").where("role = 'select' and parent_kind = 'MethodInvocation'").select("file_id", F.col("parent_id").alias("call_id"), F.lit(-1).alias("position"), "node_id", F.col("parent_method_type").alias("method_type"))
    return given.unionByName(receiver).where("method_type is not null").join(kinds, ["file_id", "node_id"])


def callback_edges(nodes: DataFrame, call_args: DataFrame, callbacks: DataFrame) -> DataFrame:
    """``(file_id, src, dst, kind)`` into the parameters of lambda arguments, and out of what they return."""
    lam = call_args.where("kind = 'Lambda'").join(callbacks.withColumnRenamed("kind", "model_kind"), "method_type").where("position = callback_arg").select("file_id", "call_id", F.col("node_id").alias("lambda_id"), "direction", "parameter", "other", F.col("model_kind").alias("kind"))
    side = call_args.select("file_id", "call_id", F.col("position").alias("other"), F.col("node_id").alias("other_id"))
    params = nodes.where("role = 'parameter'").select("file_id", F.col("parent_id").alias("lambda_id"), F.col("ordinal").alias("parameter"), F.col("node_id").alias("parameter_id"))
    into = lam.where("direction = 'INTO'").join(side, ["file_id", "call_id", "other"]).join(params, ["file_id", "lambda_id", "parameter"]).select("file_id", F.col("other_id").alias("src"), F.col("parameter_id").alias("dst"), "kind")
    out = lam.where("direction = 'OUT'").join(lambda_results(nodes).withColumnRenamed("node_id", "result_id"), ["file_id", "lambda_id"])
    to_call = out.where("other is null").select("file_id", F.col("result_id").alias("src"), F.col("call_id").alias("dst"), "kind")
    to_side = out.join(side, ["file_id", "call_id", "other"]).select("file_id", F.col("result_id").alias("src"), F.col("other_id").alias("dst"), "kind")
    return into.unionByName(to_call).unionByName(to_side).distinct()


def model_edges(nodes: DataFrame, models: DataFrame, types: DataFrame | None = None, kinds: tuple[str, ...] = ("value", "taint")) -> DataFrame:
    """Every step that the models add to ``nodes``, by argument and by callback: a ``step`` for a flow specification."""
    args = call_arguments(nodes)
    used = models_in_use(used_methods(args), models, types)
    return step_edges(args.drop("kind"), model_steps(used), kinds).unionByName(callback_edges(nodes, args, model_callbacks(used).where(F.col("kind").isin(*kinds)))).distinct()


def declaration_of(used: DataFrame, declared: DataFrame) -> DataFrame:
    """``(method_type, declaration)``: the declared method of each call's, itself where none is known.

    ``declared(method_type, type_variables)``: one with the same type, name, flags and arity whose
    parameters are equal, or are type variables that each stand for one type.
    """
    u = used.select("method_type", F.col("method_type.declaring").alias("d"), F.col("method_type.name").alias("n"), F.size("method_type.params").alias("k")).distinct()
    v = declared.select(F.col("method_type").alias("declaration"), "type_variables", F.col("method_type.declaring").alias("d"), F.col("method_type.name").alias("n"), F.size("method_type.params").alias("k"))
    pairs = F.zip_with("method_type.params", "declaration.params", lambda a, b: F.struct(b.alias("want"), a.alias("got")))
    bound = F.filter("pairs", lambda x: F.array_contains("type_variables", x["want"]))
    ok = F.forall("pairs", lambda x: (x["want"] == x["got"]) | F.array_contains("type_variables", x["want"])) & (F.size(F.array_distinct(bound)) == F.size(F.array_distinct(F.transform(bound, lambda x: x["want"]))))
    same = F.array_sort("method_type.flags") == F.array_sort("declaration.flags")
    met = u.join(v, ["d", "n", "k"]).where(same).withColumn("pairs", pairs).where(ok).groupBy("method_type").agg(F.min("declaration").alias("declaration"))
    return u.select("method_type").join(met, "method_type", "left").select("method_type", F.coalesce("declaration", "method_type").alias("declaration"))
