"""The flow engine on small programs lowered by hand, on random graphs, and against SQL."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.common import durable
from flowloom.functions import matching as m
from flowloom.operators import calls as matched
from flowloom.operators import cfg, flow, graph, models, scope, search, traits, tree
from flowloom.plans import registry
from flowloom.schema import NODES, as_nodes
from flowloom.sources import models as model_files

SF = "/root/testdata/sf0.001"


def lower(file_id, program, owner="m"):
    """Rows of ``nodes`` from nested (kind, role, attributes, children)."""
    rows, count = [], [0]

    def walk(n, parent, depth, places):
        kind, role, attrs, children = (*n, {}, [])[:4] if len(n) < 4 else n
        count[0] += 1
        me = dict.fromkeys(NODES) | {"file_id": file_id, "node_id": len(rows) + 1, "parent_id": parent, "role": role, "kind": kind, "pre": count[0], "depth": depth, "owner": owner, "ordinal": places.setdefault(role, -1) + 1, "flags": []} | attrs
        places[role] += 1
        rows.append(me)
        inner = {}
        for c in children:
            walk(c, me["node_id"], depth + 1, inner)
        count[0] += 1
        me["post"] = count[0]

    walk(program, None, 0, {})
    return rows


def frame(spark, *programs):
    schema = ", ".join(f"{c} {t}" for c, t in NODES.items())
    return spark.createDataFrame([tuple(r[c] for c in NODES) for p in programs for r in p], schema)


def method(*stmts):
    return ("MethodDeclaration", "root", {"name": "m"}, [("Block", "body", {}, list(stmts))])


def ident(name, role, **a):
    return ("Identifier", role, {"name": name} | a, [])


def lit(value, role, **a):
    return ("Literal", role, {"literal": ("int", str(value))} | a, [])


def call(name, role, *args, owner="a.B", **a):
    return ("MethodInvocation", role, {"method_type": (owner, name, ["int"] * len(args), "int", []), "name": name} | a, list(args))


def ret(value="2"):
    return ("Return", "statement", {}, [lit(value, "expression")])


def cond(x):
    return (x[0], "condition", x[2], x[3])


def op(operator, role, *sides):
    names = ("left", "right") if len(sides) > 1 else ("operand",)
    return ("Binary" if len(sides) > 1 else "Unary", role, {"operator": operator}, [(s[0], n, s[2], s[3]) for n, s in zip(names, sides)])


def if_(c, then, other=None):
    return ("If", "statement", {}, [cond(c), ("Block", "true_part", {}, then)] + ([("Block", "false_part", {}, other)] if other is not None else []))


def loop(kind, c, *body):
    parts = [cond(c), ("Block", "body", {}, list(body))]
    return (kind, "statement", {}, parts[::-1] if kind == "DoWhile" else parts)


def ternary(role, c, yes, no):
    return ("Ternary", role, {}, [cond(c), (yes[0], "true_part", *yes[2:]), (no[0], "false_part", *no[2:])])


A, B, C = (call(n, "x") for n in "abc")
S = [call(n, "statement") for n in ("s", "t", "u")]
PROGRAMS = {
    "single": (method(S[0], S[1]), (1, 0, 1)),
    "call": (method(if_(A, [ret()]), ret("5")), (3, 1, 2)),
    "and": (method(if_(("Parentheses", "x", {}, [op("And", "inner", A, B)]), [ret()]), ret("5")), (4, 2, 2)),
    "or_not": (method(if_(op("Not", "x", op("Or", "operand", A, op("Not", "x", B))), [S[0]], [S[1]]), S[2]), (5, 2, 1)),
    "while": (method(S[0], loop("While", A, S[1]), S[2]), (3, 1, 1)),
    "do": (method(loop("DoWhile", A, S[0]), S[1]), (3, 1, 1)),
    "break": (method(loop("While", A, if_(B, [("Break", "statement", {}, [])]), if_(C, [("Continue", "statement", {}, [])]), S[0]), S[1]), (7, 3, 1)),
    "for": (method(("For", "statement", {}, [call("i", "init"), cond(A), call("n", "update"), ("Block", "body", {}, [S[0]])]), S[1]), (4, 1, 1)),
    "each": (method(("ForEach", "statement", {}, [ident("xs", "iterable"), ("Block", "body", {}, [S[0]])]), S[1]), (3, 1, 1)),
    "dead": (method(ret(), S[0], loop("While", A, S[1])), (1, 0, 1)),
    "ternary": (method(S[0], ("VariableDeclaration", "statement", {"name": "z"}, [ternary("initializer", A, lit(1, "x"), lit(2, "x"))]), S[1]), (4, 1, 1)),
    "ternary_in_ternary": (method(("Return", "statement", {}, [ternary("expression", op("And", "x", A, C), ternary("x", B, lit(1, "x"), S[0]), lit(3, "x"))])), (8, 3, 1)),
    "ternaries": (method(call("run", "statement", ("Lambda", "argument", {}, [("Block", "lambda_body", {}, [S[1]])]), ternary("argument", A, lit(1, "x"), lit(2, "x")), ternary("argument", B, lit(1, "x"), lit(2, "x")))), (9, 2, 1)),
    "for_ever": (method(("For", "statement", {}, [call("i", "init"), ("Block", "body", {}, [S[0], if_(A, [("Break", "statement", {}, [])])])]), S[1]), (4, 2, 1)),
    "dead_loop": (method(S[0], ret(), ("For", "statement", {}, [("Block", "body", {}, [S[0], S[1], S[2]])])), (1, 0, 1)),
    "last_if": (method(if_(A, [S[0]])), (2, 1, 2)),
    "empty_then": (method(if_(A, []), S[0]), (2, 1, 1)),
    "try": (method(("Try", "statement", {}, [("Block", "try_body", {}, [S[0]]), ("Block", "catch_body", {}, [S[1]]), ("Block", "finally", {}, [S[2]])])), (1, 0, 1)),
    "try_more": (method(("Try", "statement", {}, [("Block", "try_body", {}, [S[0]]), ("Block", "catch_body", {}, [S[1]]), ("Block", "finally", {}, [S[2]])]), S[0]), (1, 0, 1)),
    "switch": (method(("Switch", "statement", {}, [("Case", "case", {"name": "1"}, [S[0]]), ("Case", "case", {"name": "2"}, [S[1], ("Break", "statement", {}, [])]), ("Case", "case", {"name": "default"}, [S[2]])]), ret()), (6, 2, 1)),
}


@pytest.fixture(scope="module")
def programs(spark):
    nodes = frame(spark, *[lower(k, p) for k, (p, _) in PROGRAMS.items()])
    return nodes, *cfg.control_flow(nodes)


def test_depth(spark):
    """Conditions and trees of any depth are whole; a bound that cuts is an error."""
    chain = call("a0", "x")
    for k in range(1, 20):
        chain = op("And", "left", chain, call(f"a{k}", "right"))
    total = lit(0, "left")
    for k in range(70):
        total = op("Plus", "left", total, lit(k, "right"))
    nodes = frame(spark, lower("and", method(if_(chain, [ret()]), ret("5"))), lower("sum", method(if_(op("Not", "x", op("Equals", "operand", total, lit(1, "right"))), [S[0]]))))
    parent = {(r["file_id"], r["node_id"]): r["parent_id"] for r in nodes.collect()}

    def climb(key):
        up, out = 0, set()
        while key in parent:
            out.add((*key, up))
            key, up = (key[0], parent[key]), up + 1
        return out

    got = tree.ancestors(nodes, include_self=True, columns=()).collect()
    want = {(f, n, a, up) for f, n in parent for _, a, up in climb((f, n))}
    assert len(got) == len(want) and {(r["file_id"], r["node_id"], r["anc_id"], r["up"]) for r in got} == want and max(w[3] for w in want) > 64
    with pytest.raises(ValueError):
        tree.ancestors(nodes, max_depth=64, columns=())
    small = nodes.where("file_id like '%and%'")
    assert small.count() > 0 and cfg.units(small).where("is_condition").count() == 20
    u, edges = cfg.build(small)
    taken = edges.where("branch is not null").groupBy("branch").agg(F.count("*"), F.countDistinct("dst")).collect()
    assert {r[0]: (r[1], r[2]) for r in taken} == {"true": (20, 20), "false": (20, 1)}


def test_cfg_counts(programs):
    nodes, cfg_nodes, cfg_edges, _ = programs
    body = 2  # of a method; a lambda's graph has another id
    found = cfg.counts(cfg_nodes, cfg_edges).collect()
    assert {r["file_id"]: (r["bb"], r["cn"], r["ex"]) for r in found if r["graph_id"] == body} == {k: want for k, (_, want) in PROGRAMS.items()}
    assert not [r for r in found if r["graph_id"] != body]  # a lambda's body is in its method's graph
    assert cfg.invalid(cfg_nodes, cfg_edges).count() == 0


def test_cfg_edges(programs):
    nodes, cfg_nodes, cfg_edges, units = programs
    names = {(r["file_id"], r["node_id"]): r["name"] or r["kind"] for r in nodes.collect()}

    def name(f, i):
        return {-1: "start", -2: "end"}.get(i) or names.get((f, i // 2), f"made {i // 2}") + "?" * (i % 2)

    def drawn(f):
        return {(name(f, r["src"]), name(f, r["dst"]), r["branch"]) for r in cfg_edges.where(F.col("file_id") == f).collect()}

    assert drawn("or_not") == {("start", "a", None), ("a", "a?", None), ("a?", "t", "true"), ("a?", "b", "false"), ("b", "b?", None), ("b?", "s", "true"), ("b?", "t", "false"), ("s", "u", None), ("t", "u", None), ("u", "end", None)}
    assert drawn("while") == {("start", "s", None), ("s", "a?", None), ("a?", "t", "true"), ("t", "a?", None), ("a?", "u", "false"), ("u", "end", None)}
    assert drawn("break") >= {("b?", "Break", "true"), ("Break", "t", None), ("b?", "c", "false"), ("Continue", "a?", None), ("c?", "s", "false"), ("s", "a?", None), ("a?", "t", "false")}
    assert drawn("for") == {("start", "i", None), ("i", "a?", None), ("a?", "s", "true"), ("s", "n", None), ("n", "a?", None), ("a?", "t", "false"), ("t", "end", None)}
    assert drawn("switch") >= {("1", "1?", None), ("1?", "s", "true"), ("1?", "2", "false"), ("2?", "t", "true"), ("2?", "u", "false")}
    labels = {(r["node_id"], r["label"]) for r in cfg.numbered(cfg_nodes, nodes).where("file_id = 'call'").collect()}
    assert {label for _, label in labels} == {"1L", "2L", "3L", "1C"}
    text = search.block_text(units, nodes).select("file_id", "cfg_id", "label")
    drawing = cfg.dot(cfg_nodes, cfg_edges, text).where("file_id = 'call'").first()["dot"]
    kept = cfg.keep_edges(cfg_edges, cfg_nodes, nodes, lambda n: (F.col("name") == "a", F.lit(False)))
    shut = {r["file_id"]: r["dot"].count("Unreachable") for r in cfg.dot(cfg_nodes, cfg_edges, text, kept=kept).collect()}
    # the loop that never ends by itself, and what a condition on a shuts
    assert (shut["for_ever"], shut["call"], shut["single"], shut["or_not"]) == (2, 1, 0, 1)
    assert drawing.startswith("digraph cfg {\n    0 [shape=circle") and drawing.count("->") == 6 and '[label="True", color="green"]' in drawing


def test_cfg_reach(programs):
    nodes, cfg_nodes, cfg_edges, units = programs
    kept = cfg.keep_edges(cfg_edges, cfg_nodes, nodes, lambda n: (F.col("name") == "a", F.lit(False)))
    live = cfg.reachable_members(cfg.reachable_blocks(kept), units, nodes).join(nodes, ["file_id", "node_id"])
    got = {(r["file_id"], r["name"]) for r in live.where("name is not null").collect()}
    assert ("call", "a") in got and ("while", "u") in got and ("while", "t") not in got and ("and", "b") not in got
    fixed = frame(spark_of(nodes), lower("t", method(if_(lit("true", "x", literal=("boolean", "true")), [S[0]], [S[1]]))))
    n, e, u = cfg.control_flow(fixed)
    assert cfg.reachable_blocks(cfg.keep_edges(e, n, fixed)).join(n.where("kind = 'block'"), ["file_id", "graph_id", "cfg_id"]).count() == 2
    assert cfg.all_nodes(e).count() == 6


def spark_of(df):
    return df.sparkSession


@pytest.mark.parametrize("doublings", [0, 2])
def test_reach(spark, doublings):
    rng = random.Random(doublings)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(20)]
    seeds = [(r, r) for r in (0, 1, 2, 100)]

    def brute(start):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    e = spark.createDataFrame(edges, "src long, dst long")
    got = {tuple(r) for r in graph.reach(e, spark.createDataFrame(seeds, "root long, node long"), doublings=doublings).collect()}
    assert got == {(r, x) for r, _ in seeds for x in brute(r)}


def test_shortest_paths(spark):
    rng = random.Random(31)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}
    sources, sinks = rng.sample(range(40), 3), rng.sample(range(40), 12)
    far = {s: 0 for s in sources}
    todo = list(sources)
    for x in todo:
        for a, b in sorted(edges):
            if a == x and b not in far:
                far[b] = far[x] + 1
                todo.append(b)
    nodes = lambda xs: spark.createDataFrame([(x,) for x in xs], "node long")
    got = {r["sink"]: (r["source"], r["path"]) for r in graph.shortest_paths(spark.createDataFrame(list(edges), "src long, dst long"), nodes(sources), nodes(sinks)).collect()}
    assert set(got) == {s for s in sinks if s in far}
    for sink, (source, path) in got.items():
        assert path[0] == source and source in sources and path[-1] == sink and len(path) == far[sink] + 1 and all(e in edges for e in zip(path, path[1:]))
    # a ladder has 2^30 paths
    ladder = [e for k in range(30) for e in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))]
    one = graph.shortest_paths(spark.createDataFrame(ladder, "src long, dst long"), nodes([0]), nodes([90])).collect()
    assert len(one) == 1 and len(one[0]["path"]) == 61


def test_callback_sinks(spark):
    """What a lambda returns is the sink, whether its body is an expression or a block."""
    schema = "package string, type string, subtypes boolean, name string, signature string, input string, kind string"
    known = model_files.compiled(spark.createDataFrame([("a", "B", True, "run", "", "Argument[0].ReturnValue", "sql-injection"), ("a", "B", True, "run", "", "Argument[1]", "sql-injection")], schema))
    block = ("Lambda", "argument", {}, [("Block", "lambda_body", {}, [if_(A, [ret("1")]), ret("2")])])
    short = ("Lambda", "argument", {}, [call("s", "lambda_body")])
    nodes = frame(spark, lower("f", method(call("run", "statement", block, lit(7, "argument")), call("run", "statement", short), call("run", "statement", ident("p", "argument")))))
    rows = {r["node_id"]: r for r in nodes.collect()}
    got = [rows[r["node_id"]] for r in models.model_sinks(nodes, known, "sql").collect()]
    assert sorted(r["name"] or r["literal"]["value"] for r in got) == ["1", "2", "7", "s"]


def test_types_tell_lambdas_and_fields(spark):
    types = spark.createDataFrame([("a.Low", "a.Mid"), ("a.Low", "a.Top"), ("a.Mid", "a.Top")], "sub string, super string")
    flags = "type string, name string, arity int, flags array<string>"
    known = spark.createDataFrame([("a.Top", "run", 0, []), ("a.Top", "stop", 0, []), ("a.Mid", "stop", 0, ["Default"]), ("a.Top", "two", 1, []), ("a.Low", "other", 1, [])], flags)
    lam = lambda type_, *given: ("Lambda", "argument", {"type": type_}, [("VariableDeclaration", "parameter", {"name": g}, []) for g in given] + [call("s", "lambda_body")])
    program = ("MethodDeclaration", "root", {"name": "m", "method_type": ("a.Low", "m", [], "void", [])}, [("Block", "body", {}, [call("go", "statement", lam("a.Low"), lam("a.Top"), lam("a.Low", "x"), lam("a.Top", "x"), ident("f", "argument"), ident("g", "argument"), ident("h", "argument"))])])
    nodes = frame(spark, lower("m", program))
    names = [r["method_name"] for r in traits.methods(nodes, known, types).where("kind = 'Lambda'").orderBy("node_id").collect()]
    assert names == ["run", "<lambda>", "<lambda>", "two"]  # two are open in a.Top; two of one parameter in a.Low
    assert {r["method_name"] for r in traits.methods(nodes).where("kind = 'Lambda'").collect()} == {"<lambda>"}
    fields = spark.createDataFrame([("a.Top", "f", "int"), ("a.Mid", "f", "int"), ("a.Top", "g", "long")], "type string, name string, field_type string")
    found = scope.resolve(traits.var_access(nodes), scope.declarations(nodes))
    rows = {r["node_id"]: r["name"] for r in nodes.collect()}
    got = {rows[r["node_id"]]: (r["owner"], r["field_id"]) for r in scope.resolve_fields(found, nodes, fields, types).collect()}
    assert {k: v[0] for k, v in got.items()} == {"f": "a.Mid", "g": "a.Top"}
    assert {rows[r["node_id"]] for r in scope.resolve_fields(found, nodes, fields).collect()} == set()


def test_condensed(spark, monkeypatch):
    """Random graphs, and long rows and ladders in few rounds."""
    monkeypatch.setattr(graph, "PATIENCE", 1)
    rng = random.Random(21)
    edges, seeds, want = [], [], set()
    for root in range(12):
        n = rng.randint(2, 25)
        mine = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))}
        starts = rng.sample(range(n), rng.randint(1, 2))
        seen, todo = set(starts), list(starts)
        while todo:
            x = todo.pop()
            for a, b in mine:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        edges += [(root, a, b) for a, b in mine]
        seeds += [(root, s) for s in starts]
        want |= {(root, x) for x in seen}
    df, start = spark.createDataFrame(edges, "root int, src long, dst long"), spark.createDataFrame(seeds, "root int, node long")
    got = [tuple(r) for r in graph.reach(df, start).collect()]
    assert sorted(got) == sorted(want)

    # rungs of a ladder, a long row, a loop inside a loop, and a row that closes on itself
    ladder = [e for k in range(300) for e in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))]
    row = [(900 + k, 901 + k) for k in range(600)] + [(1500, 1400), (1450, 1420)]
    away = [(5000, 5001), (5001, 5000), (5001, 100)]
    writes = []
    real = graph.durable
    monkeypatch.setattr(graph, "durable", lambda d: writes.append(1) or real(d))
    found = graph.reach(spark.createDataFrame([(0, a, b) for a, b in ladder + row + away], "root int, src long, dst long"), spark.createDataFrame([(0, 0)], "root int, node long"))
    assert {r["node"] for r in found.collect()} == set(range(1501)) and found.count() == 1501
    assert len(writes) < 80


def test_participants_and_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (6, 4)], "src long, dst long")
    a, z = spark.createDataFrame([(1,), (5,)], "node long"), spark.createDataFrame([(4,), (5,)], "node long")
    assert {r[0] for r in graph.participants(e, a, z).collect()} == {1, 2, 3, 4, 5}
    assert {(r["source"], tuple(r["path"]), r["sink"]) for r in graph.paths(e, a, z, 4).collect()} == {(1, (1, 2, 4), 4), (1, (1, 2, 4, 5), 5), (5, (5,), 5)}


PATHS = [
    ("Argument[0]", ("ARGUMENT", (0, 0), "NONE", None)),
    ("Argument[-1]", ("ARGUMENT", (-1, -1), "NONE", None)),
    ("Argument[this]", ("ARGUMENT", (-1, -1), "NONE", None)),
    ("Argument[0..2]", ("ARGUMENT", (0, 2), "NONE", None)),
    ("Argument[this].MapValue", ("ARGUMENT", (-1, -1), "NONE", None)),
    ("Argument[this,0]", ("ARGUMENT", (-1, 0), "NONE", None)),
    ("Argument[0,2]", None),
    ("Argument[2..0]", None),
    ("Argument[x]", None),
    ("ReturnValue", ("RETURN_VALUE", None, "NONE", None)),
    ("ReturnValue.Element", ("RETURN_VALUE", None, "NONE", None)),
    ("Argument[0].SyntheticField[a.b.C]", ("ARGUMENT", (0, 0), "NONE", None)),
    ("Argument[0].Parameter[1]", ("ARGUMENT", (0, 0), "PARAMETER", (1, 1))),
    ("Argument[0].Parameter[0].Element", ("ARGUMENT", (0, 0), "PARAMETER", (0, 0))),
    ("Argument[1].ReturnValue.Element", ("ARGUMENT", (1, 1), "RETURN_VALUE", None)),
    ("Argument[0].Unknown", None),
    ("ReturnValue.Parameter[0]", None),
    ("", None),
    ("Other", None),
    (None, None),
]


def test_access_paths(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PATHS)], "i int, p string").withColumn("a", m.access_path(F.col("p"))).orderBy("i")
    for r, (path, want) in zip(df.collect(), PATHS):
        got = None if r["a"] is None else (r["a"]["root"], r["a"]["range"] and tuple(r["a"]["range"]), r["a"]["callback"], r["a"]["callback_range"] and tuple(r["a"]["callback_range"]))
        assert got == want, path


def test_matching(spark):
    t = "struct<declaring:string,name:string,params:array<string>,ret:string,flags:array<string>>"
    rows = [(1, ("java.util.List", "add", ["int", "java.lang.Object"], "void", [])), (2, ("java.util.List", "<constructor>", [], "void", [])), (3, ("a.b.C", "getX", ["java.lang.String"], "int", [])), (4, None)]
    df = spark.createDataFrame(rows, f"i int, method_type {t}")

    def hits(p):
        return {r["i"] for r in df.where(m.method_matches(F.col("method_type"), p)).collect()}

    assert hits("java.util.List add(..)") == {1} and hits("java.util.* *(..)") == {1, 2} and hits("*..* get*(String)") == {3} and hits("*..* *()") == {2}
    assert hits("a..C getX(*)") == {3} and hits("List add(int, ..)") == {1} and hits("List add(int)") == set() and hits("java.util.List <constructor>()") == {2}
    with pytest.raises(ValueError):
        m.method_matches(F.col("method_type"), "nonsense")
    assert df.where(m.any_matches(F.col("method_type"), [])).count() == 0
    sig = [("", 1, 2, 3), ("()", 2), ("(int,Object)", 1), ("(String)", 3), ("(java.lang.String)", 3), ("(b.String)",), ("(Object,Object)",)]
    for s, *want in sig:
        assert {r["i"] for r in df.where("method_type is not null").where(m.signature_matches(F.col("method_type.params"), F.lit(s))).collect()} == set(want), s
    one = spark.range(1).select(m.flags_of(F.array(F.lit("Public"), F.lit("Sealed"), F.lit("Sealed"))).alias("f"), m.canonical_kinds(F.lit("xss")).alias("k"), m.canonical_kinds(F.lit("own")).alias("o"), m.type_name(F.lit("array"), F.lit("int")).alias("t"), m.model_name(F.lit("A$B"), F.lit("B")).alias("c")).first()
    assert (one["f"], one["k"], one["o"], one["t"], one["c"]) == (["Public", "PotentiallyAmbiguous"], ["html-injection", "js-injection"], ["own"], "int[]", "<constructor>")


def test_model_files(spark, tmp_path):
    head = "package,type,subtypes,name,signature,ext,input,output,kind,provenance\n"
    (tmp_path / "a.csv").write_text(head + 'java.lang,String,false,trim,,,Argument[-1],ReturnValue,taint,manual\njava.util,List,true,add,"(int,Object)",,Argument[0],Argument[this].Element,value,manual\n')
    (tmp_path / "b.csv").write_text(head + "java.lang,Iterable,true,forEach,,,Argument[-1].Element,Argument[0].Parameter[0],value,manual\njava.util,Map,true,computeIfAbsent,,,Argument[1].ReturnValue,ReturnValue,value,manual\n")
    (tmp_path / "c.csv").write_text(head + "a,B,false,c,,,Argument[0],ReturnValue,other,manual\n")
    both = model_files.flow_models(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert {(r["fqn"], r["lookup"], r["signature"]) for r in both.collect()} >= {("java.lang.String", "trim", None), ("java.util.List", "add", "(int,Object)")}
    with pytest.raises(Exception, match="unknown kind"):
        model_files.flow_models(spark, [str(tmp_path / "c.csv")]).collect()
    t = "struct<declaring:string,name:string,params:array<string>,ret:string,flags:array<string>>"
    used = spark.createDataFrame([(("java.util.ArrayList", "forEach", ["java.util.function.Consumer"], "void", []),), (("java.util.Map", "computeIfAbsent", ["a.K", "a.F"], "a.V", []),)], f"method_type {t}")
    types = spark.createDataFrame([("java.util.ArrayList", "java.lang.Iterable")], "sub string, super string")
    got = {(r["method_type"]["name"], r["direction"], r["callback_arg"], r["parameter"], r["other"]) for r in models.model_callbacks(models.models_in_use(used, both, types)).collect()}
    assert got == {("forEach", "INTO", 0, 0, -1), ("computeIfAbsent", "OUT", 1, None, None)}
    sinks = "package,type,subtypes,name,signature,ext,input,kind,provenance\na,P,true,password,,,Argument[0].ReturnValue,credentials-password,manual\n"
    (tmp_path / "s.csv").write_text(sinks)
    s = model_files.sink_models(spark, [str(tmp_path / "s.csv")])
    user = spark.createDataFrame([(("a.P", "password", ["a.F"], "void", []),)], f"method_type {t}")
    assert [(r["shape"], r["position"]) for r in models.sink_shapes(models.models_in_use(user, s)).collect()] == [("callback", 0)]


def assign(name, value):
    return ("Assignment", "statement", {}, [ident(name, "variable"), (value[0], "assignment", value[2], value[3])])


def declare(name, value):
    return ("VariableDeclaration", "statement", {"name": name}, [(value[0], "initializer", value[2], value[3])])


def test_local_flow(spark):
    src, use = call("source", "x"), lambda n: call("use", "statement", ident(n, "argument"))
    kill = method(declare("n", src), assign("n", lit(1, "x")), use("n"))
    branch = method(declare("n", src), if_(A, [assign("n", lit(1, "x")), use("n")]), use("n"))
    copy = method(declare("n", src), declare("o", ident("n", "x")), use("o"), ("VariableDeclaration", "statement", {"name": "p"}, [("TypeCast", "initializer", {}, [("Parentheses", "expression", {}, [ident("o", "expression")])])]), use("p"))
    text = method(declare("s", src), ("VariableDeclaration", "statement", {"name": "t"}, [("Binary", "initializer", {"operator": "Addition", "type": "java.lang.String"}, [ident("s", "left"), lit("x", "right")])]), use("t"))
    grown = method(declare("n", lit(0, "x")), ("CompoundAssignment", "statement", {"operator": "Addition"}, [ident("n", "variable"), (src[0], "assignment", src[2], src[3])]), use("n"))
    clean = method(declare("s", src), declare("t", call("sanitize", "x", ident("s", "argument"))), use("t"))
    nodes = frame(spark, *[lower(k, p) for k, p in {"kill": kill, "branch": branch, "copy": copy, "text": text, "clean": clean, "grown": grown}.items()])
    is_source, is_sink = (lambda n: F.coalesce(F.col("name") == "source", F.lit(False))), (lambda n: (F.col("role") == "argument") & (F.col("kind") == "Identifier"))
    live = durable(flow.live_code(nodes))
    found = {f: sum(r["is_sink"] for r in rows) for f, rows in by_file(flow.local_marks(nodes, flow.FlowSpec(is_source, is_sink), live)).items()}
    assert found == {"branch": 1, "copy": 2, "clean": 1, "grown": 1}
    ways = flow.local_paths(nodes, flow.FlowSpec(is_source, is_sink), 12, live).collect()
    assert {f: sum(r["file_id"] == f for r in ways) for f in found} == found and all(r["path"][0] == r["source_id"] and r["path"][-1] == r["sink_id"] for r in ways)
    taint = flow.TaintSpec(is_source, is_sink, through=("sanitize",))
    assert {f: sum(r["is_sink"] for r in rows) for f, rows in by_file(flow.local_marks(nodes, taint, live)).items()} == {"branch": 1, "copy": 2, "text": 1, "clean": 2, "grown": 1}
    shut = flow.TaintSpec(is_source, is_sink, through=("sanitize",), sanitizers=("sanitize",))
    marks = flow.local_marks(nodes, shut, live)
    assert {f: sum(r["is_sink"] for r in rows) for f, rows in by_file(marks).items()} == {"branch": 1, "copy": 2, "text": 1, "clean": 1, "grown": 1}
    assert {r[0] for r in flow.files_with_flow(nodes, marks, wanted=False).collect()} == {"kill"}


def test_model_flow(spark):
    """list.add(source()); use(list.get()); list.forEach(x -> use(x))."""
    t = lambda n, *p: ("java.util.List", n, list(p), "void", [])
    on = lambda name, role, *args: ("MethodInvocation", role, {"name": name, "method_type": t(name, *["java.lang.Object"] * len(args))}, [ident("l", "select"), *args])
    lam = ("Lambda", "argument", {}, [("VariableDeclaration", "parameter", {"name": "x"}, []), call("use", "lambda_body", ident("x", "argument"))])
    program = method(declare("l", lit(0, "x")), on("add", "statement", call("source", "argument")), call("use", "statement", on("get", "argument")), on("forEach", "statement", lam))
    nodes = frame(spark, lower("f", program))
    rows = [("java.util", "Collection", True, "add", "", "Argument[0]", "Argument[this].Element", "value"), ("java.util", "List", False, "get", "", "Argument[this].Element", "ReturnValue", "value"), ("java.lang", "Iterable", True, "forEach", "", "Argument[-1].Element", "Argument[0].Parameter[0]", "value")]
    known = model_files.compiled(spark.createDataFrame(rows, "package string, type string, subtypes boolean, name string, signature string, input string, output string, kind string"))
    types = spark.createDataFrame([("java.util.List", "java.util.Collection"), ("java.util.List", "java.lang.Iterable")], "sub string, super string")
    spec = flow.FlowSpec(lambda n: F.coalesce(F.col("name") == "source", F.lit(False)), lambda n: F.col("role") == "argument", step=lambda n: models.model_edges(n, known, types))
    marks = flow.local_marks(nodes, spec).where("is_sink").join(nodes, ["file_id", "node_id"])
    assert {(r["kind"], r["name"]) for r in marks.collect()} == {("MethodInvocation", "source"), ("MethodInvocation", "get"), ("Identifier", "x")}


def test_declarations_and_views(spark):
    t = "struct<declaring:string,name:string,params:array<string>,ret:string,flags:array<string>>"
    used = spark.createDataFrame([(("a.B", "put", ["java.lang.String", "int"], "int", []),), (("a.B", "two", ["int", "long"], "int", []),), (("a.B", "none", [], "int", []),)], f"method_type {t}")
    declared = spark.createDataFrame([(("a.B", "put", ["K", "V"], "V", []), ["K", "V"]), (("a.B", "two", ["T", "T"], "T", []), ["T"])], f"method_type {t}, type_variables array<string>")
    got = {r["method_type"]["name"]: r["declaration"]["params"] for r in models.declaration_of(used, declared).collect()}
    assert got == {"put": ["K", "V"], "two": ["int", "long"], "none": []}
    nodes = frame(spark, lower("f", method(S[0])))
    views = {r["view"]: r["errors"] for r in traits.views_or_errors(nodes, call=F.col("kind") == "MethodInvocation", block=F.col("kind") == "Block").collect()}
    assert views == {"call": [], "block": [], None: ["call expected, found MethodDeclaration", "block expected, found MethodDeclaration"]}
    counted = spark.createDataFrame([("f", 1, 4, 2, 2)], "file_id string, graph_id long, bb long, cn long, ex long")
    assert cfg.summary_text(counted).first()["text"] == "BB: 4 CN: 2 EX: 2"


def by_file(marks):
    out = {}
    for r in marks.collect():
        out.setdefault(r["file_id"], []).append(r)
    return out


def test_fold_and_search(spark):
    url = ("Literal", "x", {"literal": ("java.lang.String", "http://test")}, [])
    uri = lambda n: ("MethodInvocation", "statement", {"name": "create", "method_type": ("java.net.URI", "create", ["java.lang.String"], "java.net.URI", [])}, [ident(n, "argument")])
    web = method(declare("s", url), declare("t", ident("s", "x")), if_(A, [uri("t")], [uri("t")]))
    fold = method(declare("x", lit(7, "x")), declare("y", lit(1, "x")), assign("y", lit(2, "x")), call("use", "statement", ident("x", "argument"), ident("y", "argument")))
    nodes = frame(spark, lower("web", web), lower("fold", fold))
    assert [(r["file_id"], r["fixed"]) for r in search.insecure_uri_literals(nodes).collect()] == [("web", "https://test")]
    folded = scope.fold_constants(nodes)
    names = {(r["file_id"], r["node_id"]): r["name"] for r in nodes.collect()}
    assert {(names["fold", r["node_id"]], r["literal"]) for r in folded.where("file_id = 'fold'").collect()} == {("x", "7"), ("y", None)}
    assert [r["value"] for r in scope.literals_of(folded.where("file_id = 'fold'"), "int").collect()] == [7]
    assert search.find_methods(nodes, "java.net.URI create(..)").count() == 2
    assert search.find_methods(nodes, "a.B use(..)", follow="taint").count() == 1
    assert search.uses_all_invocations(nodes.where("kind = 'MethodInvocation'"), ["java.net.URI create(..)", "a.B a()"]).collect()[0][0] == "web"


def test_guards_and_dead_code(spark):
    url = lambda host: ("Literal", "x", {"literal": ("java.lang.String", f"http://{host}")}, [])
    uri = lambda v: ("MethodInvocation", "statement", {"name": "create", "method_type": ("java.net.URI", "create", ["java.lang.String"], "java.net.URI", [])}, [(v[0], "argument", v[2], v[3])])
    replaced = ("MethodInvocation", "x", {"name": "replace", "method_type": ("java.lang.String", "replace", ["java.lang.CharSequence"] * 2, "java.lang.String", [])}, [])
    off = lit("false", "x", literal=("boolean", "false"))
    in_lambda = ("MethodInvocation", "statement", {"name": "run", "method_type": ("a.B", "run", ["java.lang.Runnable"], "void", [])}, [("Lambda", "argument", {}, [("Block", "lambda_body", {}, [uri(url("lambda"))])])])
    shut = method(uri(url("before")), if_(replaced, [uri(url("guarded"))], [uri(url("else"))]), uri(url("after")))
    program = method(if_(off, [uri(url("dead"))]), if_(A, [uri(url("live"))]), in_lambda, ret(), uri(url("late")), ("MethodInvocation", "statement", {"name": "run"}, in_lambda[3]))
    field = ("ClassDeclaration", "root", {}, [("VariableDeclaration", "field", {"name": "f"}, [(uri(url("field"))[0], "initializer", *uri(url("field"))[2:])]), ("Block", "instance_init", {}, [uri(url("init"))])])
    nodes = frame(spark, lower("f", program), lower("s", shut), lower("c", field))
    assert sorted((r["file_id"], r["fixed"][8:]) for r in search.insecure_uri_literals(nodes).collect()) == [("c", "field"), ("c", "init"), ("f", "lambda"), ("f", "live"), ("s", "before")]
    rows = {(r["file_id"], r["node_id"]): r for r in nodes.collect()}
    assert {r["method_name"] for r in traits.methods(nodes).collect()} == {"m", "<lambda>", "<obinit>"}
    loop_ = frame(spark, lower("l", method(("For", "statement", {}, [declare("i", lit(0, "x"))[:1] + ("init",) + declare("i", lit(0, "x"))[2:], cond(A), ("Block", "body", {}, [S[0]])]))))
    assert [r["method_name"] for r in traits.methods(loop_).collect()] == ["m"]
    cfg_nodes, cfg_edges, _ = cfg.control_flow(nodes)
    assert sorted((r["file_id"], r["bb"]) for r in cfg.counts(cfg_nodes, cfg_edges).collect()) == [("c", 1), ("f", 7), ("s", 4)]  # an initialiser is a graph, a lambda's body is put in its method's
    cfg.check(cfg_nodes, cfg_edges)
    with pytest.raises(ValueError, match="two outcomes"):
        cfg.check(cfg_nodes, cfg_edges.where("branch is null or branch = 'true'"))


def test_global_flow(spark):
    """A value goes through a generic method of another file and comes back, varargs and returns of lambdas apart."""
    def declared(name, params, *body, flags=()):
        given = [("VariableDeclaration", "parameter", {"name": f"p{i}"}, []) for i in range(len(params))]
        return ("MethodDeclaration", "root", {"name": name, "method_type": ("a.B", name, list(params), "T", list(flags))}, [*given, ("Block", "body", {}, list(body))])

    back = lambda n: ("Return", "statement", {}, [ident(n, "expression")])
    same = declared("same", ["T"], back("p0"))
    last = declared("last", ["int", "int[]"], ("MethodInvocation", "statement", {"name": "run", "method_type": ("a.B", "run", ["F"], "void", [])}, [("Lambda", "argument", {}, [("Block", "lambda_body", {}, [back("p1")])])]), back("p0"), flags=["Varargs"])
    source = call("source", "argument", owner="s.S")
    many = lambda *args: ("MethodInvocation", "argument", {"name": "last", "method_type": ("a.B", "last", ["int", "int[]"], "T", ["Varargs"])}, list(args))
    use = lambda x: call("use", "statement", x, owner="s.S")
    main = method(use(call("same", "argument", source)), use(many(lit(1, "argument"), lit(2, "argument"), source)), use(many(source)))
    nodes = frame(spark, lower("same", same), lower("last", last), lower("main", main))
    types = spark.createDataFrame([(("a.B", "same", ["T"], "T", []), ["T"])], "method_type struct<declaring:string,name:string,params:array<string>,ret:string,flags:array<string>>, type_variables array<string>")
    is_source, is_sink = (lambda n: F.coalesce(F.col("name") == "source", F.lit(False))), (lambda n: (F.col("role") == "argument") & F.coalesce(F.col("name").isin("same", "last"), F.lit(False)))
    rows = {(r["file_id"], r["node_id"]): r["name"] or r["kind"] for r in nodes.collect()}
    got = sorted((r["file_id"], rows[r["file_id"], r["node_id"]], r["is_source"], r["is_sink"]) for r in flow.global_marks(nodes, flow.FlowSpec(is_source, is_sink), types).collect())
    # of the three sources the second fills the varargs parameter, which only the lambda returns; the third comes back to its own call alone
    assert [g for g in got if g[0] == "main"] == [("main", "last", False, True)] + [("main", "same", False, True)] + [("main", "source", True, False)] * 2
    assert {g[1] for g in got if g[0] == "last"} == {"p0"} and {g[1] for g in got if g[0] == "same"} == {"p0"}
    between = search.flow_between_methods(nodes.withColumn("name", F.when(F.col("name") == "same", "other").otherwise(F.col("name"))), "s.S source()", "s.S use(..)", "Arguments", "Taint")
    assert between.where("is_sink").count() == 1
    for wrong in ({"target": "None"}, {"kind": "x"}):
        with pytest.raises(ValueError):
            search.flow_between_methods(nodes, "s.S source()", "s.S use(..)", **wrong)


def test_page_elements():
    from flowloom.sources.dom import elements

    def told(html):
        return [(kind, parent, depth) for _, parent, _, depth, kind, _ in elements(html)]

    assert told("<P><b>x<br><p>y</p></B></i><ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == [("p", None, 0), ("b", 0, 1), ("br", 1, 2), ("p", None, 0), ("ul", None, 0), ("li", 7, 1), ("li", 7, 1), ("ul", 9, 2), ("li", 10, 3), ("li", 7, 1)]
    assert told("<div/><a><img src='x'/></a>") == [("div", None, 0), ("a", None, 0), ("img", 1, 1)] and told("") == [] and told("a < b </p>") == []
    deep = told("<div>" * 40)
    assert deep[-1] == ("div", 38, 39)
    assert [e[2] for e in elements("<a><b></a><c>")] == [2, 2, 4]


def test_trees(spark):
    lam = ("Lambda", "argument", {}, [("VariableDeclaration", "parameter", {"name": "x"}, []), ("Block", "lambda_body", {}, [("Return", "statement", {}, [ident("x", "expression")])])])
    expr = ("Lambda", "argument", {}, [("VariableDeclaration", "parameter", {"name": "y"}, []), ident("y", "lambda_body")])
    cls = ("ClassDeclaration", "root", {}, [("VariableDeclaration", "field", {"name": "f"}, [lam]), ("Block", "static_init", {}, [S[0]]), ("MethodDeclaration", "member", {"name": "m"}, [("VariableDeclaration", "parameter", {"name": "p", "flags": ["Varargs"]}, []), ("Block", "body", {}, [("Block", "statement", {}, [call("g", "statement", expr, ("Parentheses", "argument", {}, [("Parentheses", "inner", {}, [ident("p", "inner")])]))])])])])
    nodes = frame(spark, lower("c", cls))
    rows = {r["node_id"]: r for r in nodes.collect()}
    kinds = {(rows[r["node_id"]]["name"] or rows[r["node_id"]]["kind"]): (rows[r["block_id"]]["role"], r["graph_type"][:6]) for r in tree.callable_blocks(nodes).collect()}
    assert kinds["s"] == ("static_init", "callab") and kinds["g"] == ("body", "callab") and kinds["Return"] == ("lambda_body", "lambda")
    assert {rows[r["node_id"]]["name"] for r in tree.lambda_results(nodes).collect()} == {"x", "y"}
    p = next(r for r in tree.unparenthesised(nodes).collect() if rows[r["node_id"]]["name"] == "p" and rows[r["node_id"]]["kind"] == "Identifier")
    assert rows[p["outer_id"]]["role"] == "argument" and rows[p["parent_id"]]["name"] == "g"
    kinds = {r["name"]: (r["variable_kind"], r["position"]) for r in traits.variables(nodes).collect()}
    assert kinds == {"f": ("Field", None), "x": ("Parameter", 0), "y": ("Parameter", 0), "p": ("Parameter", 0)}
    assert {r["method_name"] for r in traits.methods(nodes).collect()} == {"m", "<lambda>", "<clinit>"}
    with pytest.raises(ValueError):
        traits.arguments(nodes, -1)
    sam = spark.createDataFrame([("F", "apply", 1, []), ("F", "andThen", 1, ["Default"]), ("G", "a", 1, []), ("G", "b", 1, [])], "type string, name string, arity int, flags array<string>")
    assert [tuple(r) for r in traits.single_abstract_methods(sam).select("type", "name").collect()] == [("F", "apply")]


def test_accesses(spark):
    p = method(("CompoundAssignment", "statement", {}, [ident("a", "variable"), ident("b", "assignment")]), ("Unary", "statement", {"operator": "PostIncrement"}, [ident("c", "operand")]), ("FieldAccess", "statement", {"name": "this"}, [ident("d", "name_of_member")]), assign("e", ident("this", "x")))
    got = {r["name"]: (r["is_lvalue"], r["is_rvalue"]) for r in traits.var_access(frame(spark, lower("f", p))).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (True, True), "e": (True, False)}
    nodes = frame(spark, lower("f", p))
    assert {r["name"] for r in flow.uses_of(nodes).collect()} == {"a", "b", "c"}
    pairs = nodes.alias("a").join(nodes.alias("n"), tree.is_ancestor("a.pre", "a.post", "n.pre", "n.post"))
    climbed = tree.ancestors(nodes, include_self=True, columns=())
    assert {(r[0], r[1]) for r in pairs.select("n.node_id", "a.node_id").collect()} == {(r["node_id"], r["anc_id"]) for r in climbed.collect()}
    keys = spark.createDataFrame([("A", "x", "int"), ("A", "x", "long"), ("A", "x", "int"), ("B", "x", "int")], "o string, n string, t string").select(traits.field_key(F.col("o"), F.col("n"), F.col("t")).alias("k"))
    assert keys.distinct().count() == 3


def test_matched_calls(spark):
    # two callers of an identity method: each flows back to itself alone
    arguments = spark.createDataFrame([("id", 0, 1, 10), ("id", 0, 2, 20)], "method string, position int, node long, call long")
    parameters = spark.createDataFrame([("id", 0, 5)], "method string, position int, node long")
    returns, calls = spark.createDataFrame([("id", 6)], "method string, node long"), spark.createDataFrame([("id", 10), ("id", 20)], "method string, call long")
    body = spark.createDataFrame([(5, 6, "local", None)], "src long, dst long, kind string, call long")
    edges = flow.argument_edges(arguments, parameters).unionByName(flow.return_edges(returns, calls)).unionByName(body)
    got = {tuple(r) for r in matched.matched_reach(edges, spark.createDataFrame([(1,), (6,)], "node long")).collect()}
    assert got == {(1, 1), (1, 5), (1, 6), (1, 10), (6, 6), (6, 10), (6, 20)}


def test_empty(spark):
    none = as_nodes(spark.createDataFrame([], "file_id string"))
    assert tree.ancestors(none).count() == 0 and traits.var_access(none).count() == 0 and flow.value_edges(none).count() == 0
    assert cfg.counts(*cfg.control_flow(none)[:2]).count() == 0


#: Half a minute each, of fixed costs; the driver compares them at a larger scale, and their parts are tested above and in test_graphs.
SLOW = {"customer_graphs", "customer_drawings", "customer_uris", "customer_callbacks", "customer_members", "customer_elements", "graph_nodes", "local_flow", "guarded_reach", "graph_labels", "star_summary_of_customers"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - SLOW))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.ORACLE_SQL[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream(spark, tmp_path):
    from flowloom.streaming import incremental

    folder = str(tmp_path / "in")
    frame(spark, lower("a", method(S[0]))).write.parquet(folder)
    nodes = incremental.arriving_nodes(spark, folder)
    for df, mode in ((incremental.arriving_calls(nodes, "a.B s*(..)"), "append"), (incremental.files_seen_using(nodes, ["a.B s*(..)"]), "update")):
        q = df.writeStream.format("memory").queryName(f"found_{mode}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / mode)).start()
        q.awaitTermination(120)
        assert spark.table(f"found_{mode}").count() == 1
