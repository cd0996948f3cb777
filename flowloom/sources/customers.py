"""Customers as statements of programs that have every construct."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import durable
from ..schema import as_nodes

#: Ids of a customer's nodes start at 64 times its key, those of a method at this plus 8 times its first customer's key.
METHOD_IDS, LIBRARY_IDS = 1 << 48, 1 << 49


def node(kind: str, role: str, *children: tuple, **columns) -> tuple:
    return kind, role, columns, children


def name(of: str, role: str) -> tuple:
    return node("Identifier", role, name=of, type="int")


def literal(value: str, role: str, type_: str = "int") -> tuple:
    return node("Literal", role, literal=(type_, value), type=type_)


def call(of: str, role: str = "statement", *children: tuple, owner: str = "shop.Shop", ret: str = "void", params: list[str] | None = None, flags: tuple[str, ...] = (), kind: str = "MethodInvocation") -> tuple:
    given = [c for c in children if c[1] == "argument"]
    return node(kind, role, *children, name=of, type=ret, method_type=(owner, of, ["int"] * len(given) if params is None else params, ret, list(flags)))


def test(of: str, role: str = "condition") -> tuple:
    return call(of, role, ret="boolean")


def block(role: str, *children: tuple) -> tuple:
    return node("Block", role, *children)


def uri(address: str) -> tuple:
    return call("create", "statement", literal(address, "argument", "java.lang.String"), owner="java.net.URI", params=["java.lang.String"], ret="java.net.URI")


def declared(of: str, role: str, *children: tuple) -> tuple:
    return node("VariableDeclaration", role, *children, name=of, type="int")


_A = "condition"
S, T, BREAK, CONTINUE = call("s"), call("t"), node("Break", "statement"), node("Continue", "statement")
_COPY = node("Ternary", "inner", test("a"), literal("1", "true_part"), literal("2", "false_part"), type="int")
_BOX = call("<constructor>", "select", literal("1", "argument"), owner="shop.Box", ret="shop.Box", kind="NewClass")
_ERROR = call("<constructor>", "expression", owner="shop.Error", ret="shop.Error", kind="NewClass")

#: What a customer is, by the key modulo the number of constructs; a call of ``line`` stands before it.
CONSTRUCTS = {
    "if_else": node("If", "statement", test("a"), block("true_part", S), block("false_part", T)),
    "if_and": node("If", "statement", node("Binary", _A, test("a", "left"), test("b", "right"), operator="And", type="boolean"), block("true_part", S)),
    "while": node("While", "statement", test("a"), block("body", S)),
    "do_while": node("DoWhile", "statement", block("body", S), test("a")),
    "for": node("For", "statement", declared("i", "init", literal("0", "initializer")), node("Binary", _A, name("i", "left"), literal("3", "right"), operator="LessThan", type="boolean"), node("Unary", "update", name("i", "operand"), operator="PostIncrement", type="int"), block("body", S)),
    "for_each": node("ForEach", "statement", declared("x", "control"), name("xs", "iterable"), block("body", S)),
    "switch": node("Switch", "statement", name("n", "selector"), node("Case", "case", S, BREAK, name="1"), node("Case", "case", T, BREAK, name="2"), node("Case", "case", S, name="default")),
    "try": node("Try", "statement", block("try_body", S), block("catch_body", T), block("finally", S)),
    "throw": node("If", "statement", node("Unary", _A, test("a", "operand"), operator="Not", type="boolean"), block("true_part", node("Throw", "statement", _ERROR))),
    "callback": call("forEach", "statement", name("xs", "select"), node("Lambda", "argument", declared("x", "parameter"), call("print", "lambda_body", name("x", "argument"), owner="shop.Lib")), owner="java.util.List", params=["java.util.function.Consumer"]),
    "expression": declared("z", "statement", node("Binary", "initializer", call("size", "left", _BOX, owner="shop.Box", ret="int"), node("Parentheses", "right", _COPY), operator="Addition", type="int")),
    "block": block("statement", node("Unary", "statement", name("i", "operand"), operator="PostIncrement", type="int"), node("CompoundAssignment", "statement", name("n", "variable"), literal("2", "assignment"), operator="Addition")),
    "jumps": node("While", "statement", test("a"), block("body", node("If", "statement", test("b"), block("true_part", BREAK)), node("If", "statement", test("a"), block("true_part", CONTINUE)), S)),
    "varargs": call("log", "statement", literal("x", "argument", "java.lang.String"), name("n", "argument"), literal("2", "argument"), params=["java.lang.Object[]"], flags=("Varargs",)),
    "return": node("If", "statement", test("a"), block("true_part", node("Return", "statement", name("n", "expression")))),
    "between": call("print", "statement", call("keep", "argument", call("take", "argument", owner="shop.Lib", ret="int"), owner="shop.Lib", ret="int"), owner="shop.Lib"),
    "between_other": call("print", "statement", call("keep", "argument", call("other", "argument", owner="shop.Lib", ret="int"), owner="shop.Lib", ret="int"), owner="shop.Lib"),
    "uri": uri("http://a"),
    "uri_guarded": node("If", "statement", call("replace", _A, literal("s", "select", "java.lang.String"), literal("a", "argument", "java.lang.String"), literal("b", "argument", "java.lang.String"), owner="java.lang.String", ret="java.lang.String", params=["java.lang.CharSequence"] * 2), block("true_part", uri("http://b"))),
    "uri_dead": node("If", "statement", literal("false", _A, "boolean"), block("true_part", uri("http://c"))),
}

X, RETURN = call("x"), node("Return", "statement", name("n", "expression"))


def branch(of: str, then: tuple, *other: tuple) -> tuple:
    return node("If", "statement", test(of), block("true_part", then), *[block("false_part", o) for o in other])


def guarded(*body: tuple, last: tuple) -> tuple:
    return node("Try", "statement", block("try_body", *body), block("catch_body", call("caught")), block("finally", last))


def action(role: str, *body: tuple) -> tuple:
    return node("Lambda", role, block("lambda_body", *body), type="shop.Action")


def made(*methods: tuple[str, tuple]) -> tuple:
    """A new object with methods of its own."""
    inner = [node("MethodDeclaration", "statement", block("body", *body), name=n) for n, *body in methods]
    return node("NewClass", "argument", node("ClassBody", "anonymous_body", *inner), name="<constructor>", method_type=("shop.Task", "<constructor>", [], "void", []))


def rule(of: str, *body: tuple, flags: tuple[str, ...] = ("Rule",)) -> tuple:
    return node("Case", "case", *body, name=of, flags=list(flags))


#: Constructs that control leaves in several ways or that run others inside, for a set of programs of their own.
FLOWS = {
    "try_return": guarded(branch("a", RETURN), S, last=T),
    "try_nested": guarded(guarded(branch("a", RETURN), S, last=T), last=branch("b", X)),
    "try_break": node("While", "statement", test("a"), block("body", guarded(branch("b", BREAK), branch("c", CONTINUE), S, last=T))),
    "try_inner": guarded(node("While", "statement", test("a"), block("body", branch("b", BREAK), S)), last=T),
    "lambda": call("run", "statement", action("argument", S, branch("a", RETURN), T), params=["java.lang.Runnable"]),
    "lambdas": call("run", "statement", action("argument", S), action("argument", call("go", "statement", action("argument", T))), params=["java.lang.Runnable"] * 2),
    "anonymous": call("run", "statement", made(("f", S, RETURN), ("g", branch("a", T))), params=["shop.Task"]),
    "for_each": node("ForEach", "statement", declared("x", "control"), name("xs", "iterable"), block("body", branch("a", BREAK), branch("b", CONTINUE), call("print", "statement", name("x", "argument"), owner="shop.Lib"))),
    "for": node("For", "statement", declared("i", "init", literal("0", "initializer")), test("a"), node("Unary", "update", name("i", "operand"), operator="PostIncrement", type="int"), block("body", branch("b", CONTINUE), S)),
    "do": node("DoWhile", "statement", block("body", S, branch("b", CONTINUE), T), test("a")),
    "else_if": branch("a", S, branch("b", T, X)),
    "or": node("If", "statement", node("Binary", _A, test("a", "left"), node("Unary", "right", test("b", "operand"), operator="Not"), operator="Or", type="boolean"), block("true_part", S)),
    "loops": node("While", "statement", test("a"), block("body", node("While", "statement", test("b"), block("body", S)), T)),
    "rules": node("Switch", "statement", name("n", "selector"), rule("1", S), rule("2", T), rule("default", X)),
    "falls": node("Switch", "statement", name("n", "selector"), rule("1", S, flags=()), rule("2", T, flags=()), rule("default", X, flags=())),
    "straight": block("statement", node("Synchronized", "statement", name("l", "lock"), block("body", S)), node("Assert", "statement", node("Binary", "assertion", test("a", "left"), test("b", "right"), operator="And")), node("ClassDeclaration", "statement", node("ClassBody", "class_body", declared("f", "statement")), name="C")),
    "order": node("Assignment", "statement", name("v", "variable"), node("Binary", "assignment", call("f", "left", name("q", "select"), call("g", "argument", literal("1", "argument"), ret="int"), literal("2", "argument"), ret="int"), node("Parentheses", "right", name("r", "inner")), operator="Addition")),
    "cast": declared("z", "statement", node("TypeCast", "initializer", node("ArrayAccess", "expression", name("xs", "indexed"), literal("4", "index")), type="int")),
    "itself": node("If", "statement", node("InstanceOf", _A, node("FieldAccess", "expression", node("Identifier", "target", name="this"), name="f"), type="boolean"), block("true_part", call("s", "statement", node("Identifier", "select", name="super")))),
}

_COLUMNS = {"name": "string", "operator": "string", "type": "string", "literal": "struct<type:string,value:string>", "method_type": "struct<declaring:string,name:string,params:array<string>,ret:string,flags:array<string>>", "flags": "array<string>"}
_SCHEMA = "c int, k int, up int, role string, ordinal int, tick int, tock int, down int, kind string, " + ", ".join(f"{n} {t}" for n, t in _COLUMNS.items())


def _flat(c: int, trees: list[tuple]) -> list[tuple]:
    """Rows of :data:`_SCHEMA`: numbered from 0, with places of opening and closing; ``up`` is null at the top."""
    rows, tick = [], 0

    def walk(tree: tuple, up: int | None, down: int, ordinal: int) -> None:
        nonlocal tick
        kind, role, columns, children = tree
        k = len(rows)
        rows.append(None)
        opened, tick = tick, tick + 1
        places: dict[str, int] = {}
        for child in children:
            walk(child, k, down + 1, places.setdefault(child[1], 0))
            places[child[1]] += 1
        rows[k] = (c, k, up, role, ordinal, opened, tick, down, kind, *[columns.get(n) for n in _COLUMNS])
        tick += 1

    for n, tree in enumerate(trees):
        walk(tree, None, 0, n)
    return rows


def numbered(tree: tuple, wanted: str) -> list[int]:
    """The numbers in a customer's rows of the nodes of a construct that have a name, or are literals, of the given text, or of such a kind (any block: ``block``)."""
    rows = _flat(0, [call("line"), tree])
    known = [c.split()[0] for c in re.split(r", (?=\w+ )", _SCHEMA)]
    told = [dict(zip(known, r, strict=True)) for r in rows]
    if wanted == "block":
        return [r["k"] for r in told if r["kind"] == "Block" and r["role"] in ("lambda_body", "body")]
    tests = (lambda r: r["name"] == wanted, lambda r: (r["literal"] or ("", ""))[1] == wanted, lambda r: r["kind"] == wanted)
    return next(filter(None, ([r["k"] for r in told if t(r)] for t in tests)))


def customer_nodes(spark: SparkSession, sf_dir: str, constructs: dict[str, tuple] = CONSTRUCTS) -> DataFrame:
    """``nodes``: each nation's file has a method ``segment`` for each market segment, whose customers, by key, are its
    statements, as ``constructs`` says; then it returns its parameter.  A method ``keep`` of the file returns its own.
    The constructs, a table of fixed size, are broadcast; what grows are the customers."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    firsts = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"))
    owner = F.concat_ws("-", "c_nationkey", "c_mktsegment")
    shapes = spark.createDataFrame([r for c, tree in enumerate(constructs.values()) for r in _flat(c, [call("line"), tree])], _SCHEMA)
    body = METHOD_IDS + F.col("first") * 8 + 1
    numbered = rows.join(firsts, ["c_nationkey", "c_mktsegment"]).withColumn("c", (F.col("c_custkey") % len(constructs)).cast("int"))
    tick = F.col("first") * (1 << 32) + F.expr("row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey)") * 256
    told = numbered.withColumn("at", tick).join(F.broadcast(shapes), "c").select(
        "c_nationkey", owner.alias("owner"), (F.col("c_custkey") * 64 + F.col("k")).alias("node_id"), F.coalesce(F.col("c_custkey") * 64 + F.col("up"), body).alias("parent_id"), "role",
        (F.when(F.col("up").isNull(), F.expr("cast((at % 4294967296) div 128 as int)")).otherwise(0) + F.col("ordinal")).alias("ordinal"), (F.col("at") + F.col("tick")).alias("pre"), (F.col("at") + F.col("tock")).alias("post"), (F.col("down") + 2).alias("depth"), "kind", *_COLUMNS,
    )
    last = 1 << 31

    def frame(of: DataFrame, first, who, base: int, called: str) -> DataFrame:
        """The nodes of a method around its statements: itself, its parameter, its body, and what it returns."""
        mine = _flat(0, [node("MethodDeclaration", "root", declared("n", "parameter"), block("body", node("Return", "statement", name("n", "expression"))), name=called, type="int", method_type=("shop.Lib", called, ["int"], "int", []))])
        order = {"MethodDeclaration": 0, "Block": 1, "VariableDeclaration": 2, "Return": 3, "Identifier": 4}
        place = F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("kind"))
        shape = spark.createDataFrame(mine, _SCHEMA)
        kinds = {r[1]: r[8] for r in mine}
        shape = shape.withColumn("up_kind", F.element_at(F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v)]), F.col("up")))
        up = F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("up_kind"))
        # statements lie between the opening of the body and what follows them
        late = F.when((F.col("kind").isin("Return", "Identifier")), last).otherwise(0)
        closing = F.when(F.col("kind").isin("MethodDeclaration", "Block"), last).otherwise(late)
        return of.withColumn("b", base + first * 8).withColumn("at", first * (1 << 32) + (base // LIBRARY_IDS) * (1 << 61)).withColumn("c", F.lit(0)).join(F.broadcast(shape), "c").select(
            "c_nationkey", who.alias("owner"), (F.col("b") + place).alias("node_id"), (F.col("b") + up).alias("parent_id"), "role",
            F.when(F.col("kind") == "Return", 1 << 30).otherwise(F.col("ordinal")).alias("ordinal"), (F.col("at") + late + F.col("tick")).alias("pre"), (F.col("at") + closing + F.col("tock")).alias("post"), F.col("down").alias("depth"), "kind", *_COLUMNS,
        )

    methods = frame(firsts, F.col("first"), owner, METHOD_IDS, "segment")
    library = frame(rows.select("c_nationkey").distinct(), F.col("c_nationkey").cast("long"), F.concat(F.lit("keep-"), "c_nationkey"), LIBRARY_IDS, "keep")
    every = told.unionByName(methods).unionByName(library)
    own = F.col("method_type").withField("declaring", F.concat(F.col("method_type.declaring"), "c_nationkey"))
    return durable(as_nodes(every.withColumn("file_id", F.concat(F.lit("f"), "c_nationkey")).withColumn("method_type", F.when(F.col("method_type.declaring") == "shop.Lib", own).otherwise(F.col("method_type")))))
