"""Registered queries of the flow engine and the SQL that says the same."""

from __future__ import annotations

from . import customers, events, pages, star

MODULES = [star, events, pages, customers]
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    return star.star_participants(spark, sf_dir)
