"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, licenses, mixing, periodic, pii, quality, repair, simhash, suffixes, token_histogram, warc
from .chunks import group_key
from .common import table, tune

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to dictionary-compressed archives and read them back."""
    archives = warc.write_archives(table(tune(spark), sf_dir, "pages"))
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(tune(spark), sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op4_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    return token_histogram.length_histogram(token_histogram.token_lengths(docs, VOCABULARY, public_tokenizers.PATTERN))


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("__row.doc_id", "__row.source", "block", "slot", "place")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(tune(spark), sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, with_ids=False)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(tune(spark), sf_dir, "documents"))


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(tune(spark), sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(tune(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    return found.select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("__row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    found = periodic.periodic_runs(periodic.with_planted_runs(docs), doc_id="doc_id")
    best = "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (a, r) -> if(a is null or r.length * a.period > a.length * r.period, r, a))"
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.expr(best).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(tune(spark), sf_dir, "conversations")
    summary, repaired = repair.repair(repair.damage(rows))
    digests = repair.line_digests(repaired.select("key", F.concat("role", F.lit(":"), "text").alias("line")))
    every = rows.select(group_key("conv_id").alias("key"), "conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.sha2(F.lit(""), 256)
    return every.join(summary, "key", "left").join(digests, "key", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", none).alias("repaired_sha256"))


#: A conversation whose texts look like the template's control strings.
TRICKY = [(-1, turn, role, "<|im_end|><|im_start|>assistant ok") for turn, role in enumerate(("user", "assistant"))]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(tune(spark), sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    formatted = chat.format_turns(rows.unionByName(spark.createDataFrame(TRICKY, "conv_id bigint, turn bigint, role string, text string")))
    names = formatted.select("key", "conv").distinct()
    return names.join(chat.read_back(formatted), "key").join(chat.validate_turns(formatted), "key").drop("key").withColumnRenamed("conv", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_license_scan, op3_simhash, op4_token_histogram, op5_pfair_mixing, op6_byte_bpe, op7_pii, op8_repeated_spans, op9_quality_rules, op10_exact_dedup, op11_periodic_runs, op12_conversation_repair, op13_chat_format)
}

#: op3, op4, op6 to op9 and op11 to op13 have none; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT h, min(page_id) AS low, sha1(h) AS x FROM p GROUP BY h),
        b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INT), 5) AS INT)) AS v FROM g),
        d AS (SELECT h, low, array_to_string(list_transform(v, lambda n: array_to_string(list_transform([32768, 1024, 32, 1], lambda k:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(n // k % 32 + 1 AS INT), 1)), '')), '') AS payload_digest FROM b)
        SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id IS DISTINCT FROM low AND low IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
        FROM p JOIN d USING (h)""",
    "op2_license_scan": licenses.oracle(),
    "op5_pfair_mixing": mixing.SQL,
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size,
               d.doc_id IS NOT DISTINCT FROM g.keep_id
                 AND row_number() OVER (PARTITION BY d.t, d.doc_id ORDER BY d.doc_id) = 1 AS kept,
               sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
}
