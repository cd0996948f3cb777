"""The tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHOD_TYPE = "struct<declaring:string,name:string,params:array<string>,ret:string,flags:array<string>>"

#: One row a tree node.  pre and post are the opening and closing positions of a walk through the
#: tree: a is an ancestor of n when a.pre < n.pre and a.post > n.post within a file.
NODES = {
    "file_id": "string", "node_id": "bigint", "parent_id": "bigint", "role": "string", "ordinal": "int",
    "pre": "bigint", "post": "bigint", "depth": "int", "kind": "string", "name": "string", "operator": "string",
    "type": "string", "literal": "struct<type:string,value:string>", "method_type": METHOD_TYPE,
    "owner": "string", "flags": "array<string>", "text": "string",
}

FLOW_MODELS = "package string, type string, subtypes boolean, name string, signature string, ext string, input string, output string, kind string, provenance string"
SINK_MODELS = "package string, type string, subtypes boolean, name string, signature string, ext string, input string, kind string, provenance string"

#: Names of the kinds.
CALLS = ("MethodInvocation", "NewClass")
STATEMENTS = ("Assignment", "Block", "Break", "Continue", "DoWhile", "For", "ForEach", "If", "MethodInvocation", "NewClass", "Return", "Throw", "Try", "VariableDeclaration", "While", "Empty", "Assert", "ClassDeclaration", "Unary", "CompoundAssignment", "Synchronized", "Switch", "Label")
LOOPS = ("While", "DoWhile", "ForEach", "For")


def as_nodes(df: DataFrame) -> DataFrame:
    """``df`` with every column of :data:`NODES`, in order; what is missing is null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in NODES.items()])
