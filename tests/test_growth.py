"""Steps whose work grows with their input: the same results without all pairs, and in fewer rows."""

import random
import re
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from flowloom.operators import calls, cfg, flow, graph, scope, tree
from flowloom.schema import as_nodes
from flowloom.sources import customers, dom


@dataclass(frozen=True)
class Given(flow.FlowSpec):
    """Fixed steps between nodes."""

    steps: list = field(default_factory=list)

    def edges(self, nodes):
        return nodes.sparkSession.createDataFrame([("f", a, b, "local") for a, b in self.steps], "file_id string, src bigint, dst bigint, kind string")


def _given(spark, n, steps, sources, sinks):
    nodes = as_nodes(spark.createDataFrame([("f", i) for i in range(n)], "file_id string, node_id bigint"))
    return nodes, Given(lambda _: F.col("node_id").isin(sources), lambda _: F.col("node_id").isin(sinks), steps=steps)


def _counted(steps, sources, sinks):
    after = {}
    for a, b in steps:
        after.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    out = {}
    for s in sources:
        on = [x for x in reach(s) if reach(x) & set(sinks)]
        if on:
            out[s] = (len(on), len(set(on) & set(sinks)))
    return out


def _summary(nodes, spec):
    return {r["source_id"]: (r["participants"], r["sinks"]) for r in flow.local_summary_counts(nodes, spec, nodes).collect()}


def test_a_row_of_sources_is_not_expanded_into_pairs(spark, monkeypatch):
    """Rows with branches: counted without a row for each pair of a source and what it reaches."""
    steps = [(i, i + 1) for i in range(40)] + [(i, 100 + i) for i in range(0, 40, 3)]
    sources, sinks = list(range(0, 40, 2)), [103, 118, 130]
    monkeypatch.setattr(flow, "_summary_pairs", None)
    assert _summary(*_given(spark, 150, steps, sources, sinks)) == _counted(steps, sources, sinks)


def test_summary_counts_where_flows_meet_and_go_round(spark):
    rnd = random.Random(3)
    trees = [(rnd.randrange(0, i), i) for i in range(1, 20)]
    knots = [(20, 21), (20, 22), (21, 23), (22, 23), (23, 24), (25, 26), (26, 25), (26, 27), (28, 28), (28, 29), (30, 20), (30, 31), (31, 32)]
    steps, sources, sinks = trees + knots, [0, 3, 7, 20, 22, 24, 26, 27, 28, 30, 31, 33], [5, 11, 17, 19, 24, 27, 29, 32, 33]
    assert _summary(*_given(spark, 40, steps, sources, sinks)) == _counted(steps, sources, sinks)


def test_ancestors_take_a_row_a_node(spark):
    """What is asked of ancestors is asked of one row a node, in which no node stands twice."""
    rows = [("f", 0, None, "MethodDeclaration"), ("f", 1, 0, "Block"), ("f", 2, 1, "If"), ("f", 3, 2, "Block"), ("f", 4, 3, "Identifier"), ("f", 9, 77, "Identifier"), ("g", 4, None, "If"), ("g", 5, 4, "Block")]
    nodes = as_nodes(spark.createDataFrame(rows, "file_id string, node_id bigint, parent_id bigint, kind string"))
    got = {(r["file_id"], r["node_id"]): [(a["anc_id"], a["up"], a["anc_kind"]) for a in r["chain"]] for r in tree.chains(nodes, include_self=True, columns=("kind",)).collect()}
    assert len(got) == len(rows) and got["f", 4] == [(4, 0, "Identifier"), (3, 1, "Block"), (2, 2, "If"), (1, 3, "Block"), (0, 4, "MethodDeclaration")]
    assert got["f", 9] == [(9, 0, "Identifier")] and got["g", 5] == [(5, 0, "Block"), (4, 1, "If")]
    found = lambda df: {(r["file_id"], r["node_id"]): r["found_id"] for r in df.collect()}
    chained = tree.chains(nodes, nodes.where("kind = 'Identifier'"), columns=("kind",))
    block = lambda a: a["anc_kind"] == "Block"
    assert found(tree.nearest_in(chained, block)) == {("f", 4): 3} and found(tree.outermost_in(chained, block)) == {("f", 4): 1}


def test_tags_leave_a_task_in_small_batches(spark, tmp_path, monkeypatch):
    """A task holds a bounded number of tags, not those of all the pages that it gets at once."""
    monkeypatch.setattr(dom, "TAGS_A_BATCH", 7)
    html = "<html><body>" + "<p><a>x</a>" * 5 + "</body></html>"
    spark.createDataFrame([(i, html) for i in range(20)], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    assert len(dom.elements(html)) == 12
    got = dom.page_nodes(spark, str(tmp_path)).groupBy("file_id").count().collect()
    assert len(got) == 20 and {r["count"] for r in got} == {12}


def test_layered_walks_write_only_what_they_meet(spark, monkeypatch):
    rows = []
    kept = graph.durable

    def durable(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "durable", durable)
    far = [(f"x{i}", f"y{i}") for i in range(500)]
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("b", "d"), ("e", "c")] + far, "src string, dst string")
    ends = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    got = {r["node"] for r in graph.participants(edges, ends("a"), ends("c"), depth=2).collect()}
    assert got == {"a", "b", "c"} and max(rows) < 10


def test_no_climb_without_lambdas(spark, monkeypatch):
    rows = [(0, None, "MethodDeclaration"), (1, 0, "Block"), (2, 1, "Return"), (3, 2, "Identifier")]
    nodes = as_nodes(spark.createDataFrame([("f", *r) for r in rows], "file_id string, node_id bigint, parent_id bigint, kind string"))
    monkeypatch.setattr(tree, "chains", None)
    assert tree.lambda_results(nodes).count() == 0


def test_short_walks_make_no_longer_steps(spark, monkeypatch):
    """Steps of two steps are made only for walks that are not done after a few rounds."""
    made = []
    twice = graph._twice
    monkeypatch.setattr(graph, "_twice", lambda steps, on: made.append(1) or twice(steps, on))
    edges = lambda n: spark.createDataFrame([(i, i + 1) for i in range(n)] * 2, "src long, dst long")
    seed = spark.createDataFrame([(0, 0)], "root long, node long")
    assert graph.reach(edges(2), seed, doublings=2).count() == 3 and not made
    assert graph.reach(edges(9), seed, doublings=2).count() == 10 and len(made) == 2


def test_only_doubted_nodes_are_walked(spark, monkeypatch):
    """Of a long program whose edges lead onward, only dead code and what is entered from behind is walked."""
    walked = []
    reach = graph.reach
    monkeypatch.setattr(graph, "reach", lambda edges, seeds, **kw: walked.append(edges.count()) or reach(edges, seeds, **kw))
    row = [(-1, 0, True)] + [(i, i + 1, True) for i in range(200)]
    behind = [(50, 300, False), (300, 40, True), (400, 401, True), (401, 120, True), (402, 403, False), (403, 402, True)]
    edges = spark.createDataFrame([(0, *e) for e in row + behind], "root int, src long, dst long, early boolean")
    got = {r["node"] for r in graph.unreached(edges, -1).collect()}
    assert got == {400, 401, 402, 403} and max(walked) <= 4


@pytest.mark.parametrize("seed", range(3))
def test_unreached_in_any_order(spark, seed):
    """Whatever the order, and where doubts do not end, what is not reached is the same."""
    rnd = random.Random(seed)
    steps = {(rnd.randrange(25), rnd.randrange(25)) for _ in range(24)} | {(i, i + 1) for i in range(30, 50)} | {(-1, 0), (-1, 3)}
    place = {i: rnd.randrange(12) if seed else i for i in range(60)}
    rows = [(0, a, b, a == -1 or place[a] < place[b]) for a, b in steps]
    seen, todo = {-1}, [-1]
    while todo:
        new = {b for a, b in steps if a == todo[-1]} - seen
        todo.pop()
        seen |= new
        todo += new
    got = {r["node"] for r in graph.unreached(spark.createDataFrame(rows, "root int, src long, dst long, early boolean"), -1).collect()}
    assert got == {x for e in steps for x in e} - seen


def _rows_of_units(edges):
    """The leader of each unit that some edge enters, and how far behind it the unit is, by walking back."""
    into = {}
    for src, dst, hard in edges:
        into.setdefault(dst, []).append((src, hard))
    out = {}
    for node in into:
        at, n = node, 0
        while len(into[at]) == 1 and not into[at][0][1] and n <= len(into):
            at, n = into[at][0][0], n + 1
        out[node] = (node, 0) if n > len(into) else (at, n)
    return out


@pytest.mark.parametrize("span", [18, 3])
def test_units_join_their_row_at_once(spark, monkeypatch, span):
    """A row in the order of evaluation is one run a stretch; units elsewhere, and loops that nothing enters, find theirs as before."""
    steps = [(cfg.START, 1, False), *[(n, n + 1, False) for n in range(1, 30)], (12, 40, True), (40, 35, False), (35, 41, False), (50, 51, False), (51, 52, False), (52, 50, False)]
    edges = spark.createDataFrame([("f", 0, a, b, "true" if hard else None, False, False, b) for a, b, hard in steps], "file_id string, graph_id bigint, src bigint, dst bigint, branch string, again boolean, apart boolean, dst_at bigint")
    written = []
    keep = cfg.durable
    monkeypatch.setattr(cfg, "SPAN", span, raising=False)
    monkeypatch.setattr(cfg, "durable", lambda df: written.append(1) or keep(df))
    got = {r["node_id"]: (r["head"], r["place"]) for r in cfg.heads(edges).collect()}
    assert got == _rows_of_units([(a, b, hard or a == cfg.START) for a, b, hard in steps])
    straight = edges.where("src < 12")
    written.clear()
    assert {(r["head"], r["place"]) for r in cfg.heads(straight).collect()} == {(1, n) for n in range(12)}
    assert span < 18 or len(written) == 2  # no doubling


def test_only_what_holds_the_wanted_climbs(spark, monkeypatch):
    """Statements that hold other nodes than those asked for have no chain of their own to be doubled."""
    rows = [("f", 0, None, "Method"), ("f", 1, 0, "Block")] + [("f", 10 * n, 1, "Statement") for n in range(1, 21)] + [("f", 10 * n + 1, 10 * n, "Name") for n in range(1, 21)]
    nodes = as_nodes(spark.createDataFrame(rows, "file_id string, node_id bigint, parent_id bigint, kind string"))
    written = []
    keep = tree.durable
    monkeypatch.setattr(tree, "durable", lambda df: written.append(df.count()) or keep(df))
    wanted = nodes.where("kind = 'Statement'")
    got = {r["node_id"]: [a["anc_id"] for a in r["chain"]] for r in tree.chains(nodes, wanted, columns=("kind",)).collect()}
    assert got == {10 * n: [1, 0] for n in range(1, 21)} and set(written) == {2}
    kept = tree.chains(nodes, wanted, include_self=True, columns=("kind",), keep=("kind",), only=F.col("kind") == "Method").collect()
    assert {(r["kind"], tuple((a["anc_id"], a["up"]) for a in r["chain"])) for r in kept} == {("Statement", ((0, 2),))} and len(kept) == 20


def test_lookups_climb_with_blocks_alone(spark, monkeypatch):
    """What is visible is asked of blocks: the expressions around a read are in no chain that is written."""
    rows = [("f", 0, None, "MethodDeclaration", "root", 0, 99), ("f", 1, 0, "Block", "body", 1, 98), ("f", 2, 1, "VariableDeclaration", "statement", 2, 4), ("f", 3, 1, "Return", "statement", 5, 97)]
    rows += [("f", n, n - 1, "Parentheses", "inner", n + 10, 90 - n) for n in range(4, 12)] + [("f", 12, 11, "Identifier", "inner", 22, 23)]
    nodes = as_nodes(spark.createDataFrame(rows, "file_id string, node_id bigint, parent_id bigint, kind string, role string, pre bigint, post bigint").withColumn("name", F.when(F.col("node_id").isin(2, 12), "x")).withColumn("owner", F.lit("m")))
    written = set()
    keep = tree.durable
    monkeypatch.setattr(tree, "durable", lambda df: written.update(a["anc_kind"] for r in df.collect() for a in r["chain"]) or keep(df))
    assert [(r["node_id"], r["seen_id"]) for r in scope.flow_before(nodes).collect()] == [(12, 2)]
    assert written == {"Block", "MethodDeclaration"}


def test_members_take_a_row_a_node(spark, monkeypatch):
    """What a unit evaluates is told by each node's chain, not by a row for each ancestor."""
    rows = [("f", 0, None, "MethodDeclaration", "root", 0, 99), ("f", 1, 0, "Block", "body", 1, 98), ("f", 2, 1, "Return", "statement", 2, 97)]
    rows += [("f", n, n - 1, "Parentheses", "inner", n, 97 - n) for n in range(3, 20)] + [("f", 20, 19, "Identifier", "inner", 20, 21)]
    nodes = as_nodes(spark.createDataFrame(rows, "file_id string, node_id bigint, parent_id bigint, kind string, role string, pre bigint, post bigint").withColumn("ordinal", F.lit(0)))
    blocks = spark.createDataFrame([("f", 1, 4, 0, 2)], "file_id string, graph_id bigint, cfg_id bigint, place bigint, node_id bigint")
    written = []
    keep = cfg.durable
    monkeypatch.setattr(cfg, "durable", lambda df: written.append(df.count()) or keep(df))
    assert [r["node_id"] for r in cfg.members(blocks, nodes).orderBy("pos").collect()] == [*range(3, 21), 2]
    assert max(written) <= 21


def _program(spark, *statements):
    """A method of ``(kind, name, value)`` statements; an if holds a call."""
    rows, at = [(0, None, "MethodDeclaration", "root", 0, 9999, None, None), (1, 0, "Block", "body", 1, 9998, None, None)], 2
    for n, (kind, name, value) in enumerate(statements):
        k = 10 * (n + 1)
        if kind == "If":
            rows += [(k, 1, "If", "statement", at, at + 9, None, None), (k + 1, k, "Literal" if value else "Identifier", "condition", at + 1, at + 2, name, value), (k + 2, k, "Block", "true_part", at + 3, at + 8, None, None), (k + 3, k + 2, "MethodInvocation", "statement", at + 4, at + 7, "f", None), (k + 4, k + 3, "Identifier", "argument", at + 5, at + 6, "x", None)]
        else:
            rows += [(k, 1, kind, "statement", at, at + 9, name, None), (k + 1, k, "Literal" if kind == "VariableDeclaration" else "Identifier", "initializer" if kind == "VariableDeclaration" else "argument", at + 1, at + 2, None if kind == "VariableDeclaration" else "x", "1" if kind == "VariableDeclaration" else None)]
        at += 10
    told = [("f", i, up, kind, role, pre, post, name, ("boolean", value) if value else None, "m") for i, up, kind, role, pre, post, name, value in rows]
    return as_nodes(spark.createDataFrame(told, "file_id string, node_id bigint, parent_id bigint, kind string, role string, pre bigint, post bigint, name string, literal struct<type:string,value:string>, owner string"))


FROM_X = flow.FlowSpec(lambda n: (F.col("kind") == "VariableDeclaration") & (F.col("name") == "x"), lambda n: F.col("role") == "argument")


def test_what_a_shut_guard_leaves_behind_is_not_walked(spark, monkeypatch):
    """behind a condition that lets nothing through, nothing is doubted step by step, nor walked."""
    walked = []
    extend = graph.extend
    monkeypatch.setattr(graph, "extend", lambda edges, *a, **kw: walked.append(edges.count()) or extend(edges, *a, **kw))
    nodes = _program(spark, ("VariableDeclaration", "x", None), ("If", "a", None), ("If", "shut", None), *[("If", f"b{n}", None) for n in range(12)], ("MethodInvocation", "f", None))
    is_shut = F.coalesce(F.col("name") == "shut", F.lit(False))
    dead = {r["node_id"] for r in flow.dead_code(nodes, nodes, lambda n: (is_shut, is_shut)).collect()}
    inside = {33, 34} | {k for n in range(4, 16) for k in (10 * n + 1, 10 * n + 3, 10 * n + 4)} | {160, 161}
    assert dead == inside and max(walked, default=0) <= 2


def test_control_flow_is_asked_of_flows_alone(spark, monkeypatch):
    """F8: where nothing can stop control flow no graph is built; else only what lies on a flow climbs."""
    plain = _program(spark, ("VariableDeclaration", "x", None), ("If", "a", None), ("MethodInvocation", "f", None))
    build, made, climbed = cfg._prepared, [], []
    monkeypatch.setattr(cfg, "_prepared", lambda nodes: made.append(1) or build(nodes))
    marks = lambda nodes: {(r["node_id"], r["is_source"], r["is_sink"]) for r in flow.local_marks(nodes, FROM_X).collect()}
    assert marks(plain) == {(10, True, False), (24, False, True), (31, False, True)} and not made
    chains = flow.chains
    monkeypatch.setattr(flow, "chains", lambda nodes, of, **kw: climbed.append(of.count()) or chains(nodes, of, **kw))
    fixed = _program(spark, ("VariableDeclaration", "x", None), ("If", None, "false"), ("VariableDeclaration", "y", None), ("MethodInvocation", "f", None))
    assert marks(fixed) == {(10, True, False), (41, False, True)} and made and climbed == [3]


def test_matched_calls_write_a_call_once(spark, monkeypatch):
    """Of many callers of one method, few are asked: the steps are not written for each phase and each round of summaries."""
    n, rows = 60, []
    given = [(i, 1000, "argument", i) for i in range(n)] + [(1000, 1001, "local", None)] + [(1001, 2000 + i, "return", i) for i in range(n)]
    for module in (calls, graph):
        monkeypatch.setattr(module, "durable", lambda df, write=module.durable: (rows.append((out := write(df)).count()), out)[1])
    edges = spark.createDataFrame(given, "src long, dst long, kind string, call long")
    got = {tuple(r) for r in calls.matched_reach(edges, spark.createDataFrame([(0,), (7,)], "node long")).collect()}
    assert got == {(s, x) for s in (0, 7) for x in (s, 1000, 1001, 2000 + s)}
    assert sum(rows) < 4 * n  # the edges, and a summary for each call


def test_what_follows_is_found_in_one_pass(spark, monkeypatch):
    """A window from a row to the end of its partition is gone through anew for each row: quadratic in the statements of a body."""
    plans = []
    monkeypatch.setattr(cfg, "durable", lambda df, write=cfg.durable: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    cfg.build(customers.customer_nodes(spark, "/root/testdata/sf0.001", customers.FLOWS))
    assert any("rowframe, unboundedpreceding" in p.lower() for p in plans)
    assert not [p for p in plans if re.search(r"rowframe, [^u][^,]*, unboundedfollowing", p.lower())]
