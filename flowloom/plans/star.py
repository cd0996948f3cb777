"""Queries over the star schema as a flow graph, and over its parts as call sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import access_path
from ..operators import calls as matched
from ..operators import flow, graph, models, search
from ..sources import programs
from ..sources.models import compiled

SEGMENT, BRAND = "BUILDING", "Brand#12"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges without returned lines, customers of a segment, parts of a brand."""
    orders = t(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("orders").alias("kind"))
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # what names a line: all rows of that name stay or go
    line = t(spark, sf_dir, "lineitem").groupBy(*key).agg(F.max(F.coalesce(F.col("l_returnflag") == "R", F.lit(False))).alias("returned")).where("not returned")
    l, o, p = programs.line_name(), F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey")
    steps = F.array(F.struct(o.alias("src"), l.alias("dst"), F.lit("has").alias("kind")), F.struct(l.alias("src"), p.alias("dst"), F.lit("of").alias("kind")))
    edges = orders.unionByName(line.select(F.inline(steps)))
    sources = t(spark, sf_dir, "customer").where(F.col("c_mktsegment") == SEGMENT).select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    sinks = t(spark, sf_dir, "part").where(F.col("p_brand") == BRAND).select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return edges, sources, sinks


def star_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between the customers of a segment and the parts of a brand, past returned lines."""
    return graph.participants(*_ends(spark, sf_dir), depth=3)


def star_flow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, sources, sinks = _ends(spark, sf_dir)
    marked = search.flow_between(edges, sources, sinks, 3)
    return flow.labels(marked).select("node", F.array_join("labels", ",").alias("labels"))


def star_summary_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, told whether it is a source that takes part."""
    edges, sources, sinks = _ends(spark, sf_dir)
    return flow.summary(search.flow_between(edges, sources, sinks, 3), t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node")))


def star_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.paths(*_ends(spark, sf_dir), depth=3).select("source", F.array_join("path", ">").alias("path"), "sink")


def region_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each region reaches: nations, then customers and suppliers."""
    nation, customer, supplier = (t(spark, sf_dir, n) for n in ("nation", "customer", "supplier"))
    edges = (
        nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
        .union(customer.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))
        .union(supplier.select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey")))
    )
    seeds = t(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node")).select(F.col("node").alias("root"), "node")
    return graph.reach(edges, seeds)


def _global(spark: SparkSession, sf_dir: str):
    """Lines as calls: the part is the method, the order the argument; the part returns to its lines."""
    line = t(spark, sf_dir, "lineitem").select("l_partkey", F.concat(F.lit("o"), "l_orderkey").alias("o"), F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey").alias("l"), "l_discount").distinct()
    arguments = line.select(F.col("l_partkey").alias("method"), F.lit(0).alias("position"), F.col("o").alias("node"), F.col("l").alias("call"))
    part = t(spark, sf_dir, "part")
    parameters = part.select(F.col("p_partkey").alias("method"), F.lit(0).alias("position"), F.concat(F.lit("p"), "p_partkey").alias("node"))
    body = part.select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat(F.lit("v"), "p_partkey").alias("dst"), F.lit("local").alias("kind"), F.lit(None).cast("string").alias("call"))
    returns = part.select(F.col("p_partkey").alias("method"), F.concat(F.lit("v"), "p_partkey").alias("node"))
    calls = line.select(F.col("l_partkey").alias("method"), F.col("l").alias("call"))
    return line, arguments, parameters, body, returns, calls


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument, return and pruned shortcut edges of every call; discounted lines pass their argument on themselves."""
    line, arguments, parameters, _, returns, calls = _global(spark, sf_dir)
    edges = flow.argument_edges(arguments, parameters).unionByName(flow.return_edges(returns, calls)).unionByName(flow.shortcut_edges(arguments))
    return flow.prune_shortcuts(edges, line.where("l_discount > 0.05").select(F.col("o").alias("src"), F.col("l").alias("dst"))).select("src", "dst", "kind")


def matched_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where urgent orders flow through the parts' methods, each back to its own line alone."""
    _, arguments, parameters, body, returns, calls = _global(spark, sf_dir)
    edges = flow.argument_edges(arguments, parameters).unionByName(flow.return_edges(returns, calls)).unionByName(body)
    sources = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return matched.matched_reach(edges, sources)


# --- parts as call sites ----------------------------------------------------------------------------------

PATTERN = "shop.Brand1* economy*(java.lang.String, ..)"
OVERRIDE = "shop.Line2 *(..)"
ALL = ["*..* economy(..)", "*..* standard(..)", "*..* promo(java.lang.String, ..)"]

#: Model rows like those of a model file: package, type, subtypes, name, signature, input, output, kind.
FLOW_ROWS = [
    ("shop", "Item", True, "economy", "", "Argument[0]", "ReturnValue", "taint"),
    ("shop", "Line2", True, "standard", "(String)", "Argument[this,0]", "ReturnValue", "value"),
    ("shop", "Brand12", False, "promo", "(Object,int)", "Argument[0..1]", "Argument[this].Element", "taint"),
    ("shop", "Line1", False, "economy", "", "Argument[0]", "ReturnValue", "value"),
    ("shop", "Line3", True, "small", "()", "Argument[this]", "ReturnValue", "value"),
    ("shop", "Item", True, "medium", "", "Argument[0].MapValue", "Argument[1]", "value"),
]
SINK_ROWS = [("shop", "Item", True, "economy", "", "Argument[0]", "sql-injection"), ("shop", "Line2", True, "standard", "", "ReturnValue", "sql-injection"), ("shop", "Brand7", False, "promo", "", "Argument[this]", "log-injection")]


def _flow_models(spark: SparkSession) -> DataFrame:
    return compiled(spark.createDataFrame(FLOW_ROWS, "package string, type string, subtypes boolean, name string, signature string, input string, output string, kind string"))


def _arguments(calls: DataFrame) -> DataFrame:
    """Receiver and arguments of each call as nodes: ten numbers a call."""
    at = F.explode(F.sequence(F.lit(-1), F.size("method_type.params") - 1)).alias("position")
    return calls.select("file_id", F.col("node_id").alias("call_id"), "method_type", at).withColumn("node_id", F.col("call_id") * 10 + F.col("position") + 2)


def _method(c: str = "method_type"):
    return F.concat(F.col(f"{c}.declaring"), F.lit("."), F.col(f"{c}.name"), F.lit("("), F.array_join(f"{c}.params", ","), F.lit(")")).alias("method")


def find_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.call_table(programs.part_calls(spark, sf_dir), F.col("file_id"), PATTERN)


def find_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = models.hierarchy(programs.brand_types(spark, sf_dir))
    from ..functions.matching import matching_calls

    return matching_calls(programs.part_calls(spark, sf_dir), OVERRIDE, types).select("file_id", "node_id")


def files_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.uses_invocation(programs.part_calls(spark, sf_dir), [PATTERN, ALL[2]])


def files_using_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.uses_all_invocations(programs.part_calls(spark, sf_dir), ALL)


def type_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.hierarchy(programs.brand_types(spark, sf_dir))


def _used(spark: SparkSession, sf_dir: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    calls = programs.part_calls(spark, sf_dir)
    return calls, models.models_in_use(models.used_methods(calls), rows, models.hierarchy(programs.brand_types(spark, sf_dir)))


def models_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, used = _used(spark, sf_dir, _flow_models(spark))
    return used.select(_method(), "fqn", F.col("name").alias("model_name"), "signature", "kind")


def model_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, used = _used(spark, sf_dir, _flow_models(spark))
    return models.step_edges(_arguments(calls), models.model_steps(used), ("value", "taint"))


def sql_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks of the kind that was once called 'sql'."""
    rows = compiled(spark.createDataFrame(SINK_ROWS, "package string, type string, subtypes boolean, name string, signature string, input string, kind string"))
    calls, used = _used(spark, sf_dir, rows)
    return models.sink_nodes(_arguments(calls), models.sink_shapes(used), "sql")


def secure_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").where(F.col("url").startswith("http://")).select("page_id", search.secure_scheme(F.col("url")).alias("url"))


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's number in its address as an access path's range, read back."""
    n = F.regexp_extract("url", r"/(\d+)", 1).try_cast("int")
    path = F.concat(F.lit("Argument["), n, F.lit(".."), n + F.col("page_id").cast("int") % 3 - 1, F.lit("].Element.Parameter["), n % 4, F.lit("]"))
    p = access_path(path)
    return t(spark, sf_dir, "pages").select("page_id", p["root"].alias("root"), p["range"]["start"].alias("low"), p["range"]["end"].alias("high"), p["callback"].alias("callback"), p["callback_range"]["start"].alias("callback_at"))


_CLEAN = f"""
line AS (SELECT DISTINCT l_orderkey, l_partkey, concat('l', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS l, l_discount, l_returnflag FROM lineitem),
bad AS (SELECT l FROM line WHERE l_returnflag = 'R'),
hit AS (SELECT DISTINCT concat('c', c_custkey) AS c, concat('o', o_orderkey) AS o, l, concat('p', p_partkey) AS p
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN line ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
        WHERE c_mktsegment = '{SEGMENT}' AND p_brand = '{BRAND}' AND l NOT IN (SELECT l FROM bad))"""
_TYPES = """
b AS (SELECT DISTINCT replace(p_brand, '#', '') AS b FROM part),
te AS (SELECT concat('shop.', b) AS fqn, concat('shop.Line', CAST(regexp_extract(b, '[0-9]+') AS INT) % 5) AS sup FROM b),
h AS (SELECT fqn AS sub, sup AS super FROM te UNION SELECT sup, 'shop.Item' FROM te UNION SELECT fqn, 'shop.Item' FROM te)"""
_CALLS = """
calls AS (SELECT concat('f', p_partkey % 50) AS file_id, p_partkey AS node_id, concat('shop.', replace(p_brand, '#', '')) AS d, lower(p_type) AS name,
          CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'java.lang.String' ELSE 'java.lang.String,int' END AS ps, p_size % 3 AS n FROM part)"""
_USED = """
used AS (SELECT DISTINCT d, name, ps, n FROM calls),
m(fqn, subtypes, mname, sig, kind) AS (VALUES ('shop.Item', true, 'economy', '', 'taint'), ('shop.Line2', true, 'standard', '(String)', 'value'), ('shop.Brand12', false, 'promo', '(Object,int)', 'taint'),
   ('shop.Line1', false, 'economy', '', 'value'), ('shop.Line3', true, 'small', '()', 'value'), ('shop.Item', true, 'medium', '', 'value')),
iu AS (SELECT DISTINCT d, name, ps, n, fqn, mname, sig, kind FROM used JOIN m ON name = mname
       AND (d = fqn OR (subtypes AND EXISTS (SELECT 1 FROM h WHERE sub = d AND super = fqn)))
       AND (sig = '' OR (sig = '()' AND n = 0) OR (sig = '(String)' AND n = 1) OR (sig = '(Object,int)' AND n = 2)))"""

SQL = {
    "star_participants": f"WITH {_CLEAN} SELECT c AS node FROM hit UNION SELECT o FROM hit UNION SELECT l FROM hit UNION SELECT p FROM hit",
    "star_flow_summary": f"WITH {_CLEAN} SELECT c AS node, 'source' AS labels FROM hit UNION SELECT o, '' FROM hit UNION SELECT l, '' FROM hit UNION SELECT p, 'sink' FROM hit",
    "star_summary_of_customers": f"WITH {_CLEAN} SELECT concat('c', c_custkey) AS node, concat('c', c_custkey) IN (SELECT c FROM hit) AS is_source, false AS is_sink, concat('c', c_custkey) IN (SELECT c FROM hit) AS is_participant FROM customer",
    "star_paths": f"WITH {_CLEAN} SELECT c AS source, concat(c, '>', o, '>', l, '>', p) AS path, p AS sink FROM hit",
    "region_closure": """WITH RECURSIVE e AS (SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM nation
        UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey) FROM supplier),
        r AS (SELECT concat('r', r_regionkey) AS root, concat('r', r_regionkey) AS node FROM region UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node)
        SELECT root, node FROM r""",
    "call_edges": f"""WITH {_CLEAN.split("bad AS")[0].strip().rstrip(",")}
        SELECT concat('o', l_orderkey) AS src, concat('p', l_partkey) AS dst, 'argument' AS kind FROM line JOIN part ON p_partkey = l_partkey
        UNION ALL SELECT concat('v', l_partkey), l, 'return' FROM line JOIN part ON p_partkey = l_partkey
        UNION ALL SELECT concat('o', l_orderkey), l, 'shortcut' FROM line WHERE (l_orderkey, l) IN (SELECT l_orderkey, l FROM line WHERE l_discount > 0.05)""",
    "matched_calls": f"""WITH {_CLEAN.split("bad AS")[0].strip().rstrip(",")},
        u AS (SELECT concat('o', o_orderkey) AS o, l, l_partkey FROM orders JOIN line ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT')
        SELECT concat('o', o_orderkey) AS source, concat('o', o_orderkey) AS node FROM orders WHERE o_orderpriority = '1-URGENT'
        UNION SELECT o, concat('p', l_partkey) FROM u UNION SELECT o, concat('v', l_partkey) FROM u UNION SELECT o, l FROM u""",
    "find_calls": f"""WITH {_CALLS} SELECT file_id AS sourceFile, concat(d, ' ', name, '(', replace(ps, ',', ', '), ')') AS method, d AS className, name AS methodName, replace(ps, ',', ', ') AS argumentTypes
        FROM calls WHERE regexp_full_match(d, 'shop\\.Brand1[^.]*') AND name LIKE 'economy%' AND n >= 1""",
    "find_overrides": f"WITH {_TYPES}, {_CALLS} SELECT file_id, node_id FROM calls WHERE d = 'shop.Line2' OR d IN (SELECT sub FROM h WHERE super = 'shop.Line2')",
    "files_using": f"WITH {_CALLS} SELECT DISTINCT file_id FROM calls WHERE (regexp_full_match(d, 'shop\\.Brand1[^.]*') AND name LIKE 'economy%' AND n >= 1) OR (name = 'promo' AND n >= 1)",
    "files_using_all": f"WITH {_CALLS} SELECT file_id FROM calls GROUP BY 1 HAVING bool_or(name = 'economy') AND bool_or(name = 'standard') AND bool_or(name = 'promo' AND n >= 1)",
    "type_hierarchy": f"WITH {_TYPES} SELECT sub, super FROM h",
    "models_in_use": f"WITH {_TYPES}, {_CALLS}, {_USED} SELECT concat(d, '.', name, '(', ps, ')') AS method, fqn, mname AS model_name, sig AS signature, kind FROM iu",
    "model_steps": f"""WITH {_TYPES}, {_CALLS}, {_USED},
        c AS (SELECT DISTINCT calls.file_id, calls.node_id, iu.fqn, iu.mname, iu.kind, calls.n FROM calls JOIN iu USING (d, name, ps)),
        s AS (SELECT file_id, node_id * 10 + 2 AS src, node_id AS dst, kind FROM c WHERE mname = 'economy' AND n > 0
          UNION ALL SELECT file_id, node_id * 10 + 1, node_id, kind FROM c WHERE mname IN ('standard', 'small')
          UNION ALL SELECT file_id, node_id * 10 + 2, node_id, kind FROM c WHERE mname = 'standard' AND n > 0
          UNION ALL SELECT file_id, node_id * 10 + 2 + unnest([0, 1]), node_id * 10 + 1, kind FROM c WHERE mname = 'promo'
          UNION ALL SELECT file_id, node_id * 10 + 2, node_id * 10 + 3, kind FROM c WHERE mname = 'medium' AND n > 1)
        SELECT DISTINCT file_id, src, dst, kind FROM s""",
    "sql_sinks": f"""WITH {_TYPES}, {_CALLS}
        SELECT file_id, node_id * 10 + 2 AS node_id FROM calls WHERE name = 'economy' AND n > 0 AND d IN (SELECT sub FROM h WHERE super = 'shop.Item')
        UNION SELECT file_id, node_id FROM calls WHERE name = 'standard' AND d IN (SELECT sub FROM h WHERE super = 'shop.Line2')""",
    "secure_urls": "SELECT page_id, concat('https://', substr(url, 8)) AS url FROM pages WHERE starts_with(url, 'http://')",
    "url_paths": """WITH p AS (SELECT page_id, TRY_CAST(regexp_extract(url, '/(\\d+)', 1) AS INT) AS n, page_id % 3 - 1 AS d FROM pages), o AS (SELECT *, n IS NOT NULL AND d >= 0 AS ok FROM p)
        SELECT page_id, CASE WHEN ok THEN 'ARGUMENT' END AS root, CASE WHEN ok THEN n END AS low, CASE WHEN ok THEN n + d END AS high, CASE WHEN ok THEN 'PARAMETER' END AS callback, CASE WHEN ok THEN n % 4 END AS callback_at FROM o""",
}
QUERIES = {f.__name__: f for f in (star_participants, star_flow_summary, star_summary_of_customers, star_paths, region_closure, call_edges, matched_calls, find_calls, find_overrides, files_using, files_using_all, type_hierarchy, models_in_use, model_steps, sql_sinks, secure_urls, url_paths)}
