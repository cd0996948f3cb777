"""Exact deduplication by a log-structured merge index of content digests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, packed, text_of

RUN = "digest binary, high long, n long, ties long"
#: Probes of a filter, each of 8 of a digest's 32 bytes, and bits for each digest in it.
PROBES, BITS = 4, 16


def _merged(t: pd.DataFrame) -> pd.DataFrame:
    """One row a digest, in digest order, of ``t(digest, high, n, ties)``: the largest identifier, the rows, the rows with it."""
    low = t["high"].isna()
    top = t.assign(high=t["high"].fillna(np.iinfo(np.int64).min).astype("int64"), known=~low)
    best = top.groupby("digest")[["high", "known"]].transform("max")
    top["ties"] = top["ties"].where((top["high"] == best["high"]) & (top["known"] == best["known"]), 0)
    run = top.groupby("digest", sort=True, as_index=False).agg(high=("high", "max"), known=("known", "max"), n=("n", "sum"), ties=("ties", "sum"))
    run["high"] = run["high"].astype("Int64").where(run["known"], pd.NA)
    return run.drop(columns="known")


def _memtables(rows_each: int):
    """Fill a memtable with digests; when full, flush it as a run in digest order, one row a digest."""

    def go(batches):
        held, n = [], 0
        for b in batches:
            held.append(pd.DataFrame({"digest": b["digest"].to_numpy(dtype=object), "high": b["id"].astype("Int64"), "n": np.int64(1), "ties": np.int64(1)}))
            n += len(b)
            if n >= rows_each:
                yield _merged(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield _merged(pd.concat(held, ignore_index=True))

    return go


def _words(digests) -> np.ndarray:
    """Digests of 32 bytes as rows of four numbers that sort as they do."""
    return np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, PROBES).astype(np.uint64)


def _filter(digests: list[bytes]) -> bytes:
    """Bloom filter of ``BITS`` bits a digest, as little-endian words of 64 bits."""
    bits = np.zeros(64 * max(1, len(digests) * BITS // 64), dtype=np.uint8)
    if digests:
        bits[(_words(digests) % np.uint64(len(bits))).ravel().astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _compact(batches):
    """Merge a range of digests, which arrive in order from all runs, to one run; last comes its filter of the digests held twice or more."""
    last, first, twice = None, None, []

    def flushed(t):
        twice.extend(t.loc[t["n"] > 1, "digest"])
        return t.assign(filter=None)

    for b in batches:
        if not len(b):
            continue
        first = b["digest"].iloc[0] if first is None else first
        t = _merged(b[["digest", "high", "n", "ties"]] if last is None else pd.concat([last, b[["digest", "high", "n", "ties"]]], ignore_index=True))
        last = t.iloc[-1:]  # the next batch may go on with it
        if len(t) > 1:
            yield flushed(t.iloc[:-1])
    if last is not None:
        yield flushed(last)
        yield pd.DataFrame({"digest": [first], "high": pd.array([None], dtype="Int64"), "n": [np.int64(0)], "ties": [np.int64(0)], "filter": [_filter(twice)]})


def merge_index(rows: DataFrame, memtable_rows: int = 200_000) -> DataFrame:
    """The compacted index ``(digest, high, n, ties, filter)`` of ``rows(digest, id)``.

    Each task fills bounded memtables and flushes each as one run in digest order,
    where a digest has one row (so a digest held by a third of all rows leaves a task
    once a memtable).  The runs are written to the shared folder.  Compaction deals them
    out by ranges of digests, merges each range in order to one run, keeping the largest identifier, the row count and how
    many rows have that identifier, and ends it with a row of its first digest and its
    filter (n = 0), whose size follows the digests that the run holds twice or more.
    """
    runs = durable(rows.mapInPandas(_memtables(memtable_rows), RUN), "runs")
    ranged = runs.repartitionByRange(F.substring("digest", 1, 8)).sortWithinPartitions("digest")
    return durable(ranged.mapInPandas(_compact, RUN + ", filter binary"), "index")


def may_repeat(index: DataFrame, filter_bytes: int = 1 << 26) -> Callable[[Column], Column]:
    """A test whether the index may hold a digest twice or more: the filter of its range of digests says.

    The filters grow with the repeated digests, 2 bytes each.  Their sum is checked: beyond
    ``filter_bytes`` none is sent, every row passes, and the join with the index decides alone.
    """
    filters = index.where("n = 0").select("digest", "filter")
    if (filters.agg(F.sum(F.length("filter"))).first()[0] or 0) > filter_bytes:
        return lambda digest: F.lit(True)
    got = sorted((bytes(r["digest"]), bytes(r["filter"])) for r in filters.collect())  # a row a range, filter_bytes at most
    if not got:
        return lambda digest: F.lit(False)
    lows = _words([d for d, _ in got])[:, 0]
    sizes = np.array([len(f) * 8 for _, f in got], dtype=np.uint64)
    offsets = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes)[:-1]]).astype(np.uint64)
    bits = np.frombuffer(b"".join(f for _, f in got), dtype="<u8")

    @F.pandas_udf("boolean")
    def test(digest: pd.Series) -> pd.Series:
        if not len(digest):
            return pd.Series([], dtype=bool)
        w = _words(digest)
        at = np.maximum(np.searchsorted(lows, w[:, 0], side="right") - 1, 0)
        ok = np.ones(len(digest), dtype=bool)
        for k in range(PROBES):
            v = w[:, k] % sizes[at] + offsets[at]
            ok &= (bits[(v >> np.uint64(6)).astype(np.int64)] >> (v & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(ok)

    return test


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 200_000, filter_bytes: int = 1 << 26, digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256)) -> DataFrame:
    """Every row of ``docs`` as struct ``__row`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when their bytes are; null counts as empty.  The row with the
    largest identifier stays.  keep_id and group_size are read from the index.  A digest that
    the filters say it holds once never moves; the rest are hits, which join the index on the digest.
    Hits are verified byte by byte: one copy of a text a task meets the others of its
    digest, and only where a digest has several texts does each of these take the
    largest identifier and the count of its own rows instead.
    Rows with a null identifier lose to any other; of rows that tie in text and
    identifier exactly one stays.  Empty input gives no rows; other columns are
    carried in ``__row`` untouched.  ``digest`` gives 64 hex digits.
    """
    rows = packed(docs, __id=F.col(f"`{id_col}`").cast("long"), __text=text_of(text_col)).withColumn("__hex", F.sha2("__text", 256)).withColumn("__sha", F.unhex(digest(F.col("__text"))))
    index = merge_index(rows.select(F.col("__sha").alias("digest"), F.col("__id").alias("id")), memtable_rows)
    twice = durable(index.where("n > 1").select(F.col("digest").alias("__sha"), "high", "n", "ties"), "twice")
    flagged = rows.withColumn("__maybe", may_repeat(index, filter_bytes)(F.col("__sha")))
    out = ("__row", "keep_id", "group_size", "kept", F.col("__hex").alias("text_sha256"))
    single = flagged.where("not __maybe").select("__row", "__hex", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")).select(*out)

    hits = flagged.where("__maybe").drop("__maybe")
    known = F.struct(F.col("__id").isNotNull(), "__id")  # null is the smallest
    texts = hits.groupBy("__sha", "__text").agg(F.max(known)["__id"].alias("high"), F.count("*").alias("n"))
    several = texts.groupBy("__sha").agg(F.count("*").alias("texts")).where("texts > 1").select("__sha")
    clashes = durable(several, "clashes")
    met = hits.join(twice, "__sha", "left")
    if not clashes.isEmpty():
        own = texts.join(clashes, "__sha", "left_semi").withColumn("ties", F.lit(None).cast("long"))
        met = hits.join(clashes, "__sha", "left_anti").join(twice, "__sha", "left").unionByName(hits.join(own, ["__sha", "__text"]))
    met = met.select("__row", "__id", "__sha", "__hex", F.when(F.col("n").isNull(), F.col("__id")).otherwise(F.col("high")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.when(F.col("n").isNull(), 1).otherwise(F.col("ties")).alias("ties"))
    top = F.col("__id").eqNullSafe(F.col("keep_id"))
    alone = met.where(~top | F.coalesce(F.col("ties") == 1, F.lit(False))).withColumn("kept", top).select(*out)
    tied = met.where(top & ~F.coalesce(F.col("ties") == 1, F.lit(False))).withColumn("kept", F.expr("row_number() over (partition by __sha, __hex, __id order by __id) = 1")).select(*out)
    return single.unionByName(alone).unionByName(tied)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` does not keep; same columns."""
    return exact_dedup(docs, id_col, text_col).where("kept").select("__row.*")
