"""Control flow through finally blocks, nested bodies and for-each loops: edges by name, and members in the order of their evaluation."""

import pytest
from pyspark.sql import functions as F
from test_core import A, B, S, call, frame, ident, if_, lit, loop, lower, method, op, ret, ternary

from flowloom.operators import cfg, desugar

BREAK, CONTINUE = ("Break", "statement", {}, []), ("Continue", "statement", {}, [])
X, Y, Z = (call(n, "statement") for n in "xyz")
RETURN = ("Return", "statement", {}, [])


def block(role, *children):
    return ("Block", role, {}, list(children))


def try_(body, last=None, **more):
    return ("Try", "statement", {}, [block("try_body", *body), block("catch_body", call("caught", "statement"))] + ([block("finally", *last)] if last is not None else []))


def lam(role, *body):
    return ("Lambda", role, {}, [block("lambda_body", *body)])


def each(*body):
    return ("ForEach", "statement", {}, [("VariableDeclaration", "control", {"name": "x"}, []), ident("xs", "iterable"), block("body", *body)])


def anonymous(role, *methods):
    return ("NewClass", role, {"name": "new"}, [("ClassBody", "anonymous_body", {}, [("MethodDeclaration", "statement", {"name": n}, [block("body", *body)]) for n, body in methods])])


def switch(*cases):
    return ("Switch", "statement", {}, [("Case", "case", {"name": n, "flags": flags}, list(body)) for n, flags, *body in cases])


#: Program, and edges: "a b" leads on from block or start a to b, "a? b +" on true and "a? b -" on false; x' is in a copy of a finally block.
PROGRAMS = {
    # a return in a try passes its finally
    "return": (method(try_([if_(A, [RETURN]), S[0]], [S[1]]), S[2]), "start a, a a?, a? Return +, Return end, a? s -, s end"),
    "only_return": (method(try_([S[0], RETURN], [S[1]])), "start s, s end"),
    "throw_out": (method(try_([if_(A, [("Throw", "statement", {}, [])])], [S[1]]), S[2]), "start a, a a?, a? Throw +, Throw end, a? t -, t end"),
    # a finally that branches, once for each way out
    "branching": (method(try_([if_(A, [RETURN]), S[0]], [if_(B, [S[1]])]), S[2]), "start a, a a?, a? Return +, Return b'?, b'? t' +, t' end, b'? end -, a? s -, s b?, b? t +, t u, b? u -, u end"),
    # through both finally blocks
    "nested": (method(try_([try_([if_(A, [RETURN])], [X])], [Y]), Z), "start a, a a?, a? Return +, Return end, a? x -, x end"),
    "break": (method(loop("While", A, try_([if_(B, [BREAK]), S[0]], [S[1]])), S[2]), "start a, a a?, a? b +, b b?, b? Break +, Break u, b? s -, s a?, a? u -, u end"),
    "continue": (method(loop("While", A, try_([if_(B, [CONTINUE]), S[0]], [S[1]])), S[2]), "start a, a a?, a? b +, b b?, b? Continue +, Continue a?, b? s -, s a?, a? u -, u end"),
    # the loop is inside the try: its break goes through nothing
    "inner_loop": (method(try_([loop("While", A, if_(B, [BREAK]))], [S[1]]), S[2]), "start a, a a?, a? b +, b b?, b? Break +, Break t, b? a? -, a? t -, t end"),
    # a finally inside a finally is copied with it
    "copied_twice": (method(try_([if_(A, [RETURN]), S[0]], [try_([if_(B, [RETURN]), X], [Y])]), Z), "start a, a a?, a? Return +, Return b'?, b'? Return' +, Return' end, b'? x' -, x' end, a? s -, s b?, b? Return +, Return end, b? x -, x end"),
    "no_finally": (method(try_([if_(A, [RETURN]), S[0]]), S[2]), "start a, a a?, a? Return +, Return end, a? s -, s end"),
    # bodies inside expressions are put in
    "lambda": (method(S[0], call("run", "statement", lam("argument", X, if_(A, [RETURN]), Y)), S[1]), "start s, s in, in x, x a?, a? Return +, Return out, a? y -, y out, out run, run end"),
    "lambda_in_lambda": (method(call("run", "statement", lam("argument", call("go", "statement", lam("argument", X))))), "start Lambda, Lambda in, in Lambda, Lambda in, in x, x out, out go, go out, out run, run end"),
    "two_lambdas": (method(call("run", "statement", lam("argument", X), lam("argument", Y))), "start Lambda, Lambda in, in x, x out, out Lambda, Lambda in, in y, y out, out run, run end"),
    "lambda_in_condition": (method(if_(call("any", "x", lam("argument", X)), [S[0]]), S[1]), "start Lambda, Lambda in, in x, x out, out any, any any?, any? s +, s t, any? t -, t end"),
    "empty_lambda": (method(call("run", "statement", lam("argument"))), "start Lambda, Lambda in, in Block, Block out, out run, run end"),
    "anonymous": (method(call("run", "statement", anonymous("argument", ("f", [X, RETURN]), ("g", [Y]))), S[1]), "start new, new in, in f, f in, in x, x out, out g, g in, in y, y out, out out, out run, run end"),
    "endless_lambda": (method(call("run", "statement", lam("argument", ("For", "statement", {}, [block("body", X)])))), "start Lambda, Lambda in, in made, made made?, made? x +, x made?, made? out -, out run, run end"),
    # the iterator is made before the loop, and asked at each turn
    "each": (method(S[0], each(S[1]), S[2]), "start s, s made?, made? t +, t made?, made? u -, u end"),
    "each_jumps": (method(each(if_(A, [BREAK]), if_(B, [CONTINUE]), S[0]), S[1]), "start made, made made?, made? a +, a a?, a? Break +, Break t, a? b -, b b?, b? Continue +, Continue made?, b? s -, s made?, made? t -, t end"),
    "each_ternary": (method(("ForEach", "statement", {}, [("VariableDeclaration", "control", {"name": "x"}, []), ternary("iterable", A, lit(1, "x"), lit(2, "x")), block("body", S[0])]), S[1]), "start a, a a?, a? 1 +, a? 2 -, 1 made, 2 made, made made?, made? s +, s made?, made? t -, t end"),
    "for_continue": (method(("For", "statement", {}, [call("i", "init"), (A[0], "condition", *A[2:]), call("n", "update"), block("body", if_(B, [CONTINUE]), S[0])]), S[1]), "start i, i a?, a? b +, b b?, b? Continue +, Continue a?, b? s -, s n, n a?, a? t -, t end"),
    "do_first": (method(loop("DoWhile", A, S[0], if_(B, [CONTINUE]), S[1]), S[2]), "start DoWhile, DoWhile s, s b?, b? Continue +, Continue a?, b? t -, t a?, a? s +, a? u -, u end"),
    "else_if": (method(if_(A, [S[0]], [if_(B, [S[1]], [S[2]])]), X), "start a, a a?, a? s +, s x, a? b -, b b?, b? t +, t x, b? u -, u x, x end"),
    "nested_loops": (method(loop("While", A, loop("While", B, S[0]), S[1]), S[2]), "start a, a a?, a? b +, b b?, b? s +, s b?, b? t -, t a?, a? u -, u end"),
    # rule cases do not fall through
    "rules": (method(switch(("1", ["Rule"], S[0]), ("2", ["Rule"], S[1]), ("default", ["Rule"], S[2])), X), "start 1, 1 1?, 1? s +, s x, 1? 2 -, 2 2?, 2? t +, t x, 2? u -, u x, x end"),
    "falls": (method(switch(("1", [], S[0]), ("2", [], S[1]), ("default", [], S[2])), X), "start 1, 1 1?, 1? s +, s t, 1? 2 -, 2 2?, 2? t +, t u, 2? u -, u end"),
    # one unit each: a lock and an assertion do not branch, a local class is not entered
    "plain": (method(("Synchronized", "statement", {}, [ident("l", "lock"), block("body", S[0])]), ("Assert", "statement", {}, [op("And", "assertion", A, B)]), ("ClassDeclaration", "statement", {"name": "C"}, [("ClassBody", "class_body", {}, [])]), S[1]), "start s, s end"),
    "empty": (method(), "start Block, Block end"),
}


@pytest.fixture(scope="module")
def graphs(spark):
    nodes = frame(spark, *[lower(k, p) for k, (p, _) in PROGRAMS.items()])
    return nodes, *cfg.control_flow(nodes)


def drawn(nodes, cfg_edges):
    """The edges of each file, by the names of leaders; several nodes of one name are one."""
    names = {(r["file_id"], r["node_id"]): r["name"] or (r["literal"] or {"value": None})["value"] or r["kind"] for r in nodes.collect()}

    def name(f, i):
        if i in (cfg.START, cfg.END):
            return {cfg.START: "start", cfg.END: "end"}[i]
        unit, asks = i // 2, "?" * (i % 2)
        if unit >= 0:
            return names[f, unit] + asks
        what, copies, n = (-unit >> 6) % 16, -unit % 64, (-unit >> 10) - 1
        if what in (desugar.ENTER, desugar.LEAVE):
            return {desugar.ENTER: "in", desugar.LEAVE: "out"}[what]
        return ("made" if what else names[f, n]) + "'" * (copies > 0) + asks

    out = {}
    for r in cfg_edges.collect():
        out.setdefault(r["file_id"], set()).add(" ".join([name(r["file_id"], r["src"]), name(r["file_id"], r["dst"]), *{"true": "+", "false": "-"}.get(r["branch"], "")]))
    return out


def test_edges(graphs):
    nodes, cfg_nodes, cfg_edges, _ = graphs
    got = drawn(nodes, cfg_edges)
    for k, (_, want) in PROGRAMS.items():
        assert got[k] == set(want.split(", ")), k
    assert cfg.invalid(cfg_nodes, cfg_edges).count() == 0
    types = {(r["kind"], r["graph_type"]) for r in cfg_nodes.where("file_id = 'anonymous' and kind in ('start', 'end')").collect()}
    assert types == {(k, t) for k in ("start", "end") for t in cfg.GRAPH_TYPES}
    assert cfg_nodes.where("file_id = 'anonymous' and kind = 'end' and graph_type = 'LAMBDA'").count() == 3


def test_units_of_copies(graphs):
    nodes, _, _, units = graphs
    per = {r["file_id"]: r["n"] for r in units.join(nodes.where("name = 't'"), ["file_id", "node_id"]).groupBy("file_id").agg(F.count("*").alias("n")).collect()}
    assert (per["return"], per["only_return"], per["branching"], per["break"], per["inner_loop"], per.get("no_finally", 0)) == (2, 1, 2, 2, 1, 0)


def test_members(spark):
    """Receiver, arguments, call; an assignment before its right side and that before its variable; not inside a local class or an array access."""
    inner = call("g", "argument", lit(1, "argument"))
    value = ("Binary", "assignment", {"operator": "Addition"}, [call("f", "left", inner, lit(2, "argument"), ident("q", "select")), ("Parentheses", "right", {}, [ident("r", "inner")])])
    program = method(
        ("Assignment", "statement", {}, [ident("v", "variable"), value]),
        ("CompoundAssignment", "statement", {}, [ident("w", "variable"), lit(3, "assignment")]),
        ("VariableDeclaration", "statement", {"name": "z"}, [("ArrayAccess", "initializer", {}, [ident("xs", "indexed"), lit(4, "index")])]),
        ("ClassDeclaration", "statement", {"name": "C"}, [("ClassBody", "class_body", {}, [("VariableDeclaration", "statement", {"name": "in"}, [])])]),
        if_(op("And", "x", op("Not", "x", call("a", "x", ident("p", "argument"))), ("Binary", "x", {"operator": "LessThan"}, [lit(5, "left"), lit(6, "right")])), [ret("7")]),
        call("run", "statement", lam("argument", call("s", "statement", lit(8, "argument"))), ternary("argument", A, lit(9, "x"), lit(10, "x"))),
    )
    nodes = frame(spark, lower("m", program))
    names = {r["node_id"]: r["name"] or (r["literal"] or {"value": None})["value"] or r["kind"] for r in nodes.collect()}
    _, _, units = cfg.control_flow(nodes)
    rows = cfg.members(units, nodes).collect()
    blocks = {}
    for r in sorted(rows, key=lambda r: (r["cfg_id"], r["place"], r["pos"])):
        blocks.setdefault(r["cfg_id"], []).append(names[r["node_id"]])
    assert sorted(map(" ".join, blocks.values())) == sorted([
        "Assignment q 1 g 2 f Parentheses r Binary v w 3 ArrayAccess z C p a", "5 6 Binary", "7 Return", "Lambda", "8 s", "a", "9", "10", "run"
    ])
    assert all(sorted(r["pos"] for r in rows if (r["cfg_id"], r["place"]) == k) == list(range(n)) for k in {(r["cfg_id"], r["place"]) for r in rows} for n in [sum((r["cfg_id"], r["place"]) == k for r in rows)])
