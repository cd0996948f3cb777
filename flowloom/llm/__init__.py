"""Operators for preparing large training corpora on Spark.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the ``QUERIES`` and ``ORACLE_SQL`` of :mod:`flowloom.llm.registry`
apply them to whole tables.
"""
