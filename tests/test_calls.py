"""Flow through calls, matched: against explicit stacks on random programs, and on small programs lowered by hand."""

import random

import pytest
from pyspark.sql import functions as F
from test_core import call, frame, ident, if_, lit, lower, method, ret

from flowloom.operators import calls, flow, search


def told(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, kind string, call long")


def by_stacks(edges, sources, sinks, depth):
    """(reached by source, participants): states are nodes with the stack of open calls, ``depth`` at most."""
    out = {}
    for s, d, kind, c in edges:
        out.setdefault(s, []).append((d, kind, c))

    def moves(state):
        node, stack = state
        for d, kind, c in out.get(node, ()):
            if kind == "argument":
                if len(stack) < depth:
                    yield d, (*stack, c)
            elif kind == "return":
                if not stack:
                    yield d, ()
                elif stack[-1] == c:
                    yield d, stack[:-1]
            else:
                yield d, stack

    reached, on = set(), set()
    for source in sources:
        seen, todo, into = {(source, ())}, [(source, ())], {}
        while todo:
            state = todo.pop()
            for nxt in moves(state):
                into.setdefault(nxt, []).append(state)
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        reached |= {(source, n) for n, _ in seen}
        back = [x for x in seen if x[0] in sinks]
        good = set(back)
        while back:
            for x in into.get(back.pop(), ()):
                if x not in good:
                    good.add(x)
                    back.append(x)
        on |= {n for n, _ in good}
    return reached, on


def random_program(rng, methods):
    """Edges of methods whose calls go to later methods alone, so that stacks are bounded."""
    edges, nodes, n, call_id = [], [], 0, 1000
    made = []
    for _ in range(methods):
        params = [n + i for i in range(rng.randint(1, 2))]
        body = [n + len(params) + i for i in range(rng.randint(1, 4))]
        results = rng.sample(params + body, rng.randint(1, 2))
        made.append((params, body, results))
        n += len(params) + len(body)
        inner = params + body
        edges += [(a, b, "local", None) for a in inner for b in inner if a != b and rng.random() < 0.25]
        nodes += inner
    for i, (params, body, _) in enumerate(made):
        for _ in range(rng.randint(0, 3)):
            later = range(i + 1, methods)
            if not later:
                continue
            callee = made[rng.choice(later)]
            call_id += 1
            edges += [(rng.choice(params + body), p, "argument", call_id) for p in callee[0] if rng.random() < 0.8]
            back = rng.choice(body)
            edges += [(r, back, "return", call_id) for r in callee[2]]
    return edges, nodes


@pytest.mark.parametrize("seed", range(3))
def test_against_stacks(spark, seed):
    rng = random.Random(seed)
    edges, sources, sinks, want_on, want_reach, shift = [], [], [], set(), set(), 0
    for _ in range(8):  # several programs side by side
        e, nodes = random_program(rng, rng.randint(2, 6))
        mine, ends = rng.sample(nodes, 2), rng.sample(nodes, 2)
        reached, on = by_stacks(e, mine, set(ends), 8)
        move = lambda x: None if x is None else x + shift
        edges += [(s + shift, d + shift, k, move(c)) for s, d, k, c in e]
        sources += [x + shift for x in mine]
        sinks += [x + shift for x in ends]
        want_on |= {x + shift for x in on}
        want_reach |= {(a + shift, b + shift) for a, b in reached}
        shift += 10_000
    nodes = lambda xs: spark.createDataFrame([(x,) for x in xs], "node long")
    df = told(spark, edges)
    assert {r["node"] for r in calls.matched_participants(df, nodes(sources), nodes(sinks)).collect()} == want_on
    assert {(r["source"], r["node"]) for r in calls.matched_reach(df, nodes(sources)).collect()} == want_reach


def test_recursion_ends(spark):
    # f(p): calls itself by call 7 from 2, and returns 3; main calls it by 8 from 10, which comes back at 11, and by 9 from 20 back at 21
    edges = [(1, 2, "local", None), (1, 3, "local", None), (2, 1, "argument", 7), (3, 4, "return", 7), (4, 3, "local", None), (10, 1, "argument", 8), (3, 11, "return", 8), (20, 1, "argument", 9), (3, 21, "return", 9)]
    nodes = lambda *xs: spark.createDataFrame([(x,) for x in xs], "node long")
    df = told(spark, edges)
    assert {r["node"] for r in calls.matched_participants(df, nodes(10), nodes(11, 21)).collect()} == {10, 1, 2, 3, 4, 11}
    assert {r["node"] for r in calls.matched_participants(df, nodes(4), nodes(21)).collect()} == {4, 3, 21}
    none = told(spark, [])
    assert calls.matched_participants(none, nodes(1), nodes(2)).count() == 0
    assert {tuple(r) for r in calls.matched_reach(none, nodes(1)).collect()} == {(1, 1)}


def typed(name, role, *args, params=("java.lang.String",), **more):
    return ("MethodInvocation", role, {"name": name, "method_type": ("Test", name, list(params), "java.lang.String", [])} | more, list(args))


def declared(name, param, *body, params=("java.lang.String",)):
    return ("MethodDeclaration", "root", {"name": name, "method_type": ("Test", name, list(params), "java.lang.String", [])}, [("VariableDeclaration", "parameter", {"name": param}, []), ("Block", "body", {}, list(body))])


def variable(name, value):
    return ("VariableDeclaration", "statement", {"name": name}, [value])


PRINT = lambda name: call("println", "statement", ident(name, "argument"), owner="java.io.PrintStream")
SOURCE = lambda n: F.coalesce((F.col("kind") == "Literal") & (F.col("literal.value") == "42"), F.lit(False))


def null_check(spark, apart, generic=False):
    """Of three calls of a method that returns what it is given, one is given what counts; the method in its file or another."""
    thrown = ("Throw", "statement", {}, [("NewClass", "expression", {"name": "NullPointerException", "method_type": ("java.lang.NullPointerException", "<constructor>", [], "void", [])}, [])])
    equal = ("Binary", "x", {"operator": "Equal", "type": "boolean"}, [ident("obj", "left"), lit("null", "right")])
    params = ("T",) if generic else ("java.lang.String",)
    checked = declared("requireNonNull", "obj", if_(equal, [thrown]), ("Return", "statement", {}, [ident("obj", "expression")]), params=params)
    main = method(*[x for v, n in (("s", "0"), ("t", "42"), ("u", "0")) for x in (variable(v, typed("requireNonNull", "initializer", lit(n, "argument"))), PRINT(v))])
    one = lower("util" if apart else "test", checked, owner="requireNonNull")
    two = lower("test", main)
    if not apart:  # one file with both
        for r in two:
            r["node_id"] += 100
            r["parent_id"] = r["parent_id"] and r["parent_id"] + 100
            r["pre"] += 1000
            r["post"] += 1000
    return frame(spark, one, two)


@pytest.mark.parametrize("apart,generic", [(False, False), (True, False), (True, True)])
def test_null_check_marks_one_call(spark, apart, generic):
    nodes = null_check(spark, apart, generic)
    printed = nodes.where("kind = 'MethodInvocation' and name = 'println'").select("file_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("prints"))
    nodes = nodes.join(printed, ["file_id", "parent_id"], "left")
    spec = flow.FlowSpec(SOURCE, lambda n: F.coalesce(F.col("prints") & (F.col("role") == "argument"), F.lit(False)))
    types = None if not generic else spark.createDataFrame([(("Test", "requireNonNull", ["T"], "java.lang.String", []), ["T"])], "method_type struct<declaring:string,name:string,params:array<string>,ret:string,flags:array<string>>, type_variables array<string>")
    rows = {(r["file_id"], r["node_id"]): r for r in nodes.collect()}
    got = {(r["file_id"], r["node_id"]): (r["is_source"], r["is_sink"]) for r in flow.global_marks(nodes, spec, types).collect()}
    name = lambda k: rows[k]["name"] or rows[k]["literal"]["value"]
    assert sorted((name(k), rows[k]["role"], *v) for k, v in got.items()) == [
        ("42", "argument", True, False), ("obj", "expression", False, False), ("obj", "left", False, False), ("obj", "parameter", False, False), ("requireNonNull", "initializer", False, False), ("t", "argument", False, True), ("t", "statement", False, False),
    ]


def test_flow_between_methods_tells_callers_apart(spark):
    keep = declared("id", "x", ("Return", "statement", {}, [ident("x", "expression")]))
    deep = declared("twice", "y", ("Return", "statement", {}, [typed("id", "expression", typed("id", "argument", ident("y", "argument")))]))
    of = lambda source, through: call("sink", "statement", typed(through, "argument", call(source, "argument", owner="s.S")), owner="s.S")
    main = method(of("source", "id"), of("other", "id"), of("other", "twice"), of("source", "twice"), ret())
    nodes = frame(spark, lower("id", keep, "id"), lower("twice", deep, "twice"), lower("main", main))
    marks = search.flow_between_methods(nodes, "s.S source()", "s.S sink(..)", "Arguments", "Data")
    rows = {(r["file_id"], r["node_id"]): r for r in nodes.collect()}
    parent = lambda k: rows[k[0], rows[k]["parent_id"]]
    got = [((r["file_id"], r["node_id"]), r) for r in marks.collect()]
    sinks = [rows[k] for k, r in got if r["is_sink"]]
    children = lambda k: [c["name"] for c in rows.values() if c["file_id"] == k["file_id"] and c["parent_id"] == k["node_id"]]
    assert sorted((s["name"], *children(s)) for s in sinks) == [("id", "source"), ("twice", "source")]
    assert {k for k, _ in got if k[0] in ("id", "twice")} == {(f, n) for (f, n), r in rows.items() if f != "main" and (r["kind"] in ("VariableDeclaration", "Identifier", "MethodInvocation"))}
    assert all(parent(k)["name"] != "other" for k, r in got if r["is_sink"])
