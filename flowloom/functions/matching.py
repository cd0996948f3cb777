"""Columns that match methods, types, access paths and kinds."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modifiers that are flags of the same name; any other is ambiguous.
FLAGS = ("Default", "Public", "Protected", "Private", "Abstract", "Static", "Final", "Transient", "Volatile", "Synchronized", "Native", "Strictfp")

#: Former kinds of sinks and what they are called now.
KIND_ALIASES = {
    "create-file": ["path-injection"],
    "read-file": ["path-injection[read]"],
    "write-file": ["file-content-store"],
    "logging": ["log-injection"],
    "sql": ["sql-injection"],
    "xss": ["html-injection", "js-injection"],
    "open-url": ["request-forgery"],
    "url-open-stream": ["request-forgery"],
    "jdbc-url": ["request-forgery"],
    "url-redirect": ["url-redirection"],
    "ldap": ["ldap-injection"],
    "xpath": ["xpath-injection"],
    "xslt": ["xslt-injection"],
    "groovy": ["groovy-injection"],
    "jexl": ["jexl-injection"],
    "mvel": ["mvel-injection"],
    "ssti": ["template-injection"],
    "header-splitting": ["response-splitting"],
    "set-hostname-verifier": ["hostname-verification"],
    "intent-start": ["intent-redirection"],
    "pending-intent-sent": ["pending-intents"],
}

#: The parts of a container in an access path; they stand for the container.
CONTENT = r"^(Element|ArrayElement|MapKey|MapValue|Field\[.*|SyntheticField\[.*)$"

RANGE = "struct<start:int,end:int>"


def flags_of(modifiers: Column) -> Column:
    """Distinct flags of an array of modifiers."""
    return F.array_distinct(F.transform(modifiers, lambda m: F.when(m.isin(*FLAGS), m).otherwise("PotentiallyAmbiguous")))


def canonical_kinds(kind: Column) -> Column:
    """The current names of a kind of sink; itself when it is no former name."""
    table = F.create_map(*[x for k, v in KIND_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, kind), F.array(kind))


# --- method patterns ------------------------------------------------------------------------------------


def _type_regex(pattern: str) -> str:
    """'..' spans packages, '*' stands within one name; a bare name matches in any package."""
    out = "".join(r"(?:.*\.)?" if p == ".." else "[^.]*" if p == "*" else re.escape(p) for p in re.findall(r"\.\.|\*|[^.*]+|\.", pattern))
    return out if "." in pattern or "*" in pattern else rf"(?:.*\.)?{out}"


def method_matches(method: Column, pattern: str) -> Column:
    """Whether a method_type matches ``'<type> <name>(<parameters>)'``; false for a null one.

    In the parameters '..' is any number and '*' is one of any type.  ``<constructor>`` is a name like any other.
    """
    m = re.fullmatch(r"\s*(\S+)\s+(\S+?)\s*\(([^)]*)\)\s*", pattern)
    if not m:
        raise ValueError(f"not a method pattern: {pattern}")
    owner, name, given = m.groups()
    args = [a.strip() for a in given.split(",") if a.strip()]
    regex = "^"
    for a in args:
        regex += "(?:[^,]*,)*" if a == ".." else "[^,]*," if a == "*" else f"(?:{_type_regex(a)}),"
    params = F.array_join(F.transform(method["params"], lambda p: F.concat(p, F.lit(","))), "")
    ok = method["declaring"].rlike(f"^{_type_regex(owner)}$") & method["name"].rlike("^" + re.escape(name).replace(r"\*", ".*") + "$") & params.rlike(regex + "$")
    return F.coalesce(ok, F.lit(False))


def any_matches(method: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches; false for none at all."""
    return reduce(or_, [method_matches(method, p) for p in patterns], F.lit(False))


def matching_calls(calls: DataFrame, pattern: str, hierarchy: DataFrame | None = None) -> DataFrame:
    """``calls`` whose method_type matches; with ``hierarchy(sub, super)`` also those declared by a
    subtype of a type that the pattern names (an override)."""
    if hierarchy is None:
        return calls.where(method_matches(F.col("method_type"), pattern))
    supers = calls.select(F.col("method_type.declaring").alias("sub")).distinct().join(hierarchy, "sub").select("sub", F.col("super"))
    either = supers.unionByName(calls.select(F.col("method_type.declaring").alias("sub")).distinct().select("sub", F.col("sub").alias("super"))).distinct()
    owner = re.fullmatch(r"\s*(\S+)\s+.*", pattern)[1]
    ok = either.where(F.col("super").rlike(f"^{_type_regex(owner)}$")).select("sub").distinct()
    rest = re.sub(r"^\s*\S+", "*..*", pattern)
    return calls.where(method_matches(F.col("method_type"), rest)).join(ok, F.col("method_type.declaring") == F.col("sub"), "left_semi")


def type_name(kind: Column, name: Column) -> Column:
    """How a type is written: arrays as elem[], unknown as *, a primitive or class by its name (String as its class), else null."""
    return F.when(kind == "array", F.concat(name, F.lit("[]"))).when(kind == "unknown", F.lit("*")).when((kind == "primitive") & (name == "String"), F.lit("java.lang.String")).when(kind.isin("primitive", "class"), name)


#: Names of the primitive types.
PRIMITIVES = ("boolean", "byte", "char", "short", "int", "long", "float", "double", "void")


def parameter_matches(actual: Column, wanted: Column) -> Column:
    """Object takes any reference type; a dotted name is compared whole, a bare one by the last part."""
    reference = ~actual.isin(*PRIMITIVES)
    return F.when(wanted.isin("Object", "java.lang.Object"), reference).when(F.contains(wanted, F.lit(".")), actual == wanted).otherwise(F.substring_index(actual, ".", -1) == wanted)


def signature_matches(params: Column, signature: Column) -> Column:
    """An empty signature takes any parameters, '()' none, else as many as it has and each matching."""
    inner = F.regexp_replace(F.coalesce(signature, F.lit("")), r"[()\s]", "")
    wanted = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))
    same = (F.size(params) == F.size(wanted)) & F.forall(F.zip_with(params, wanted, parameter_matches), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(F.coalesce(signature, F.lit("")) == "", F.lit(True)).otherwise(same)


def model_name(type_: Column, name: Column) -> Column:
    """The name that calls are looked up by: a model whose name is its type's is a constructor."""
    return F.when(F.substring_index(F.regexp_replace(type_, r"\$", "."), ".", -1) == name, F.lit("<constructor>")).otherwise(name)


# --- access paths ---------------------------------------------------------------------------------------


def _with(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def argument_range(selectors: Column) -> Column:
    """``struct<start, end>`` of what stands in the brackets, -1 for 'this'; a union must be without gap or overlap, else null."""

    def span(lo: Column, hi: Column) -> Column:
        return F.when(lo <= hi, F.sequence(lo, hi))

    def one(s: Column) -> Column:
        single = s.rlike(r"^-?\d+$")
        pair = s.rlike(r"^-?\d+\.\.-?\d+$")
        return F.when(single, F.array(s.try_cast("int"))).when(pair, span(F.substring_index(s, "..", 1).try_cast("int"), F.substring_index(s, "..", -1).try_cast("int")))

    def union(parts: Column) -> Column:
        return F.when(F.forall(parts, lambda p: p.isNotNull()), _with(F.flatten(parts), range_of))

    def range_of(flat: Column) -> Column:
        whole = (F.size(F.array_distinct(flat)) == F.size(flat)) & (F.array_max(flat) - F.array_min(flat) + 1 == F.size(flat))
        return F.when(whole, F.struct(F.array_min(flat).alias("start"), F.array_max(flat).alias("end")))

    return _with(F.transform(F.transform(F.split(selectors, ","), lambda s: F.regexp_replace(F.trim(s), "^this$", "-1")), one), union)


def access_path(path: Column) -> Column:
    """``struct<root, range, callback, callback_range>`` of an access path; null when it can't be read.

    Components are split at dots outside brackets; those that name content stand
    for their container; the first callback ends the path.
    """
    none = F.lit(None).cast(RANGE)

    def of_parts(parts: Column) -> Column:
        head = F.get(parts, 0)
        back = F.get(F.filter(F.slice(parts, 2, 1000), lambda c: ~c.rlike(CONTENT)), 0)
        inside = F.when(head.rlike(r"^Argument\[.*\]$"), argument_range(F.regexp_extract(head, r"^Argument\[(.*)\]$", 1)))
        params = F.when(back.rlike(r"^Parameter\[.*\]$"), argument_range(F.regexp_extract(back, r"^Parameter\[(.*)\]$", 1)))
        return F.when(F.array_join(parts, ".") == path, _with(F.struct(head.alias("head"), back.alias("back"), inside.alias("inside"), params.alias("params")), of_pieces))

    def of_pieces(x: Column) -> Column:
        argument, value = x["inside"].isNotNull(), x["head"] == "ReturnValue"
        kind = F.when(x["back"].isNull(), "NONE").when(argument & (x["back"] == "ReturnValue"), "RETURN_VALUE").when(argument & x["params"].isNotNull(), "PARAMETER")
        made = F.struct(F.when(value, "RETURN_VALUE").otherwise("ARGUMENT").alias("root"), x["inside"].alias("range"), kind.alias("callback"), F.coalesce(x["params"], none).alias("callback_range"))
        return F.when((value | argument) & kind.isNotNull(), made)

    return _with(F.regexp_extract_all(path, F.lit(r"([A-Za-z]+(?:\[[^\]]*\])?)(?:\.|$)"), 1), of_parts)


def positions(range_: Column) -> Column:
    """Every position of a range."""
    return F.sequence(range_["start"], range_["end"])
