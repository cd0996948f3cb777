"""License scans by an exact set-similarity join, in DataFrame and SQL functions only."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Notices that public licenses ask authors to attach, their labels, and the words without
#: which a text of such words is another license's.
TEMPLATES = [
    ("licensed under the gnu general public license version", "gpl", "gnu"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", "gnu program"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", "gnu lesser"),
    ("licensed under the apache license version 2 0", "apache", "apache"),
    ("you may not use this file except in compliance with the license", "apache", "compliance"),
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "permission"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "redistribution"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl", "mozilla"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", "attribution"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc sa"),
]


class Template(NamedTuple):
    """A template's distinct words, how many a block must hold, which ones in any case, and how many words a block has."""

    label: str
    words: list[str]
    need: int
    required: list[str]
    length: int


def prepared(templates: list[tuple[str, str, str]], threshold: float) -> list[Template]:
    """A block is as long as the template with the words that ``1 - threshold`` of it may be strewn with."""
    out = []
    for text, label, required in templates:
        words = sorted(set(text.split()))
        out.append(Template(label, words, max(1, math.ceil(threshold * len(words) - 1e-9)), sorted(set(required.split())), math.ceil(len(text.split()) / threshold - 1e-9)))
    return out


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)


def _places(words: Column, joined: Column, phrase: str) -> Column:
    """Starts of the phrase in the word array; the array is only walked where the phrase occurs."""
    first, *rest = phrase.split()
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    if rest:
        starts = F.filter(starts, lambda i: reduce(and_, [F.get(words, i + k) == word for k, word in enumerate(rest, 1)]))
    return F.when(joined.contains(f" {phrase} "), starts).otherwise(F.array().cast("array<int>"))


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def document_facts(docs: DataFrame, id_col: str, text_col: str, phrases: list[tuple[str, str]], templates: list[Template]) -> DataFrame:
    """One row a document, from one pass over the texts: word count, places and labels of the phrases, the template
    words in it (``tokens``), and all its ``words`` where it has enough of some template's (length filter), else null."""
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words_of(ascii_lower(text_of(text_col))).alias("words"))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).withColumn("tokens", F.array_intersect("words", _literals(vocabulary)))
    enough = reduce(or_, [(F.size(F.array_intersect("tokens", _literals(t.words))) >= t.need) & reduce(and_, [F.array_contains("tokens", w) for w in t.required]) for t in templates])
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "tokens", F.when(enough, F.col("words")).alias("possible"), *[_places(F.col("words"), F.col("joined"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)])
    places = F.concat(*[f"p{i}" for i in range(len(phrases))])
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())))
    return rows.select(
        F.monotonically_increasing_id().alias("key"),
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        labels.alias("base"),
        "tokens",
        F.col("possible").alias("words"),
    )


def template_matches(facts: DataFrame, templates: list[Template]) -> DataFrame:
    """``(key, label, score)``: templates that some block of consecutive words holds, with the words they require.

    A block is any ``length`` consecutive words of the whole text, over line ends
    too.  Exact.  The text is cut into pieces of twice the longest block at strides of one, so that every
    block lies whole in a piece.  Tokens are ordered from the rarest to the most
    frequent over all documents.  A pair that shares enough tokens shares one
    within the prefix of both (prefix filter); the piece has enough template words
    at all (length filter); and from the first token they share on, enough
    are left on both sides (positional filter).  What is left is verified block by
    block.  Words outside every template can't add to an overlap and leave the
    pieces first.  The templates are a parameter of fixed size; they alone are broadcast.
    """
    spark = facts.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words})
    counts = {r["w"]: r["n"] for r in facts.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each template word at most
    order = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rows = []
    for t in templates:
        words = sorted(t.words, key=order.get)
        rows += [(w, t.label, words, t.required, at, t.need, t.length) for at, w in enumerate(words[: len(words) - t.need + 1])]
    prefixes = spark.createDataFrame(rows, "token string, label string, of array<string>, required array<string>, at int, need int, length int")
    stride, least = max(t.length for t in templates), min(t.need for t in templates)
    ranked = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])
    cuts = F.transform(F.expr(f"sequence(0, size(words) - 1, {stride})"), lambda i: F.slice("words", i + 1, 2 * stride - 1))
    pieces = facts.where("size(words) > 0").select("key", F.explode(cuts).alias("piece")).withColumn("tokens", F.array_intersect("piece", _literals(vocabulary)))
    fit = pieces.where(F.size("tokens") >= least).withColumn("tokens", F.transform(F.array_sort(F.transform("tokens", lambda w: F.struct(F.element_at(ranked, w).alias("rank"), w.alias("token")))), lambda x: x["token"]))
    probes = fit.select("key", "piece", "tokens", F.size("tokens").alias("n"), F.posexplode(F.slice("tokens", 1, F.size("tokens") - least + 1)).alias("j", "token"))
    met = probes.join(F.broadcast(prefixes), "token").where("n >= need and least(size(of) - at, n - j) >= need")
    shared = F.array_intersect("tokens", "of")
    met = met.where((F.get(shared, 0) == F.col("token")) & (F.size(shared) >= F.col("need")))  # each pair once
    blocks = F.expr("transform(filter(sequence(1, size(piece)), i -> array_contains(of, piece[i - 1])), i -> slice(piece, i, length))")
    overlaps = F.transform(F.filter(blocks, lambda b: F.forall("required", lambda w: F.array_contains(b, w))), lambda b: F.size(F.array_intersect(b, F.col("of"))))
    return met.select("key", "label", (F.array_max(overlaps) / F.size("of")).alias("score"), F.array_max(overlaps).alias("most"), "need").where("most >= need").select("key", "label", "score")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the best containment of a template in a block of consecutive words, 0 where none
    reaches the threshold, 1 where a whole phrase stands.  A null text is empty: no
    words, no labels, null places.  Repeated rows, and rows that share an id, have
    results of their own, as each row has a key from when its facts were written; an
    empty table gives no rows.  Only rows with a match meet a join's small
    side, one row each; texts don't move.
    """
    known = prepared(templates, threshold)
    facts = durable(document_facts(docs, id_col, text_col, phrases, known), "license-facts")
    found = durable(template_matches(facts, known).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best")), "licenses")
    out = facts.drop("words", "tokens").join(found, "key", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _quoted(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def oracle(phrases=PHRASES, templates=TEMPLATES, threshold=0.8) -> str:
    """Every block of words against every template, for a comparison on small tables."""
    known = prepared(templates, threshold)
    phrase_rows = ", ".join(f"({_quoted(p.split())}, '{label}')" for p, label in phrases)
    template_rows = ", ".join(f"({_quoted(t.words)}, '{t.label}', {t.need}, {_quoted(t.required)}, {t.length})" for t in known)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    WITH p(ph, label) AS (VALUES {phrase_rows}), t(ws, label, need, req, len) AS (VALUES {template_rows}),
    d AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS low FROM documents),
    w AS (SELECT r, regexp_extract_all(low, '{WORD}') AS ws FROM d),
    v AS (SELECT r, unnest(range(len(ws))) AS i, unnest(list_transform(range(len(ws)), lambda i: ws[i + 1 : i + {max(t.length for t in known)}])) AS ws FROM w),
    found AS (SELECT r, label, i FROM v, p WHERE v.ws[1 : len(ph)] = ph),
    b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM found GROUP BY r),
    m AS (SELECT r, label, len(list_intersect(v.ws[1 : t.len], t.ws)) / len(t.ws) AS score FROM v, t
          WHERE list_contains(t.ws, v.ws[1]) AND len(list_intersect(v.ws[1 : t.len], t.ws)) >= need AND list_has_all(v.ws[1 : t.len], req)),
    g AS (SELECT r, list(DISTINCT label) AS more, max(score) AS best FROM m GROUP BY r)
    SELECT d.doc_id, len(w.ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(array_to_string(base, ','), '') AS base_labels,
           array_to_string(list_sort(list_distinct(coalesce(base, []) || coalesce(more, []))), ',') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
    FROM d JOIN w USING (r) LEFT JOIN b USING (r) LEFT JOIN g USING (r)"""
