"""Periodic runs of words in a text: seeds on diagonals, extended to maximal stretches.

A run of period q has ``length - q`` words that equal those q places on.  Periods are taken in octaves; for each, the shortest such overlap that a
run can have is the length k of its k-grams.  As k is no less than q, the first k-gram of a run comes next exactly q places on: if it came
earlier, the run would have a smaller period (Fine and Wilf).  So neighbouring occurrences of each k-gram are all pairs that matter, n at
most an octave.  Each pair lies on the diagonal of its lag, where a table of what has been covered keeps a stretch from being extended twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, text_of

#: Words of the texts that are looked at together; a longer text is by itself.
BATCH_WORDS = 200_000


def octaves(min_length: int, exponent: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """``(low, high, k)``: periods above low up to high, of which a run overlaps itself by k words at least."""
    low, high = 0, min_length // exponent
    while low * exponent < longest:
        yield low, high, max(min_length - high if low == 0 else 0, (exponent - 1) * (low + 1))
        low, high = high, 2 * high


def names(grams: dict[int, np.ndarray], k: int) -> np.ndarray:
    """A number for every k-gram, equal where all words are; from those of the half as long, which overlap where k is no power of two."""
    if k not in grams:
        half = 1 << (k - 1).bit_length() - 1
        short = names(grams, half)
        pairs = short[: len(short) - (k - half)].astype(np.int64) * (len(short) + 1) + short[k - half :]
        grams[k] = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    return grams[k]


def neighbours(named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each k-gram that comes again stands, and how far on it comes next."""
    order = np.argsort(named, kind="stable")
    same = named[order[1:]] == named[order[:-1]]
    at = order[:-1][same]
    return at, order[1:][same] - at


def agree(w: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from ``i`` on, forwards or backwards, equal those ``lag`` places behind them."""
    n, size = 0, 64
    while True:
        if step > 0:
            a = w[i + n : min(i + n + size, len(w) - lag)]
            b = w[i + n + lag : i + n + lag + len(a)]
        else:
            low = max(i - n - size + 1, 0)
            a, b = w[low : i - n + 1][::-1], w[low + lag : i - n + lag + 1][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return n + int(differ[0])
        n += len(a)
        if len(a) < size:
            return n
        size *= 4


def runs_of(w: np.ndarray, min_length: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbered words ``w``, by start and then period."""
    grams, found = {1: w}, []
    for low, high, k in octaves(min_length, exponent, len(w)):
        if k >= len(w):
            break
        at, lag = neighbours(names(grams, k))
        if not len(at):
            break  # nor does any longer one come again
        near = (lag > low) & (lag <= high)
        at, lag = at[near], lag[near]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        edges = np.flatnonzero(np.diff(lag, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            places, q, n = at[a:b], int(lag[a]), 0
            while n < len(places):
                i = int(places[n])
                start, end = i - agree(w, i - 1, q, -1) if i else 0, i + agree(w, i, q, 1)
                if end - start + q >= max(min_length, exponent * q):
                    found.append((start, end - start + q, q))
                n = int(np.searchsorted(places, end))  # covered as far as the stretch goes
    return sorted(found, key=lambda r: (r[0], r[2]))


def in_texts(texts: list[str], min_length: int, exponent: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """For each text the number of its words, its runs, and the text without what repeats a run's first period."""
    words = [t.encode().split() for t in texts]
    known: dict[bytes, int] = {}
    # texts are told apart by words that none has, so no gram spans two
    w = np.fromiter((x for n, ws in enumerate(words) for x in (*[known.setdefault(y, len(known)) for y in ws], -1 - n)), np.int64, sum(map(len, words)) + len(words))
    w = np.where(w < 0, len(known) - 1 - w, w)
    starts = np.cumsum([0, *[len(ws) + 1 for ws in words]])
    found = runs_of(w, min_length, exponent)
    places = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
    mine: list[list] = [[] for _ in texts]
    for place, (s, length, q) in zip(places, found, strict=True):
        mine[place].append((s - int(starts[place]), length, q))
    for ws, runs in zip(words, mine, strict=True):
        if runs:
            change = np.zeros(len(ws) + 1, np.int64)
            for s, length, q in runs:
                change[s + q] += 1
                change[s + length] -= 1
            ws_kept = [x for x, covered in zip(ws, np.cumsum(change)[:-1], strict=True) if not covered]
        else:
            ws_kept = ws
        yield len(ws), runs, b" ".join(ws_kept).decode()


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 24, exponent: int = 3, **keep: str | Column) -> DataFrame:
    """``(*keep, n_words, runs, collapsed)`` of every row of ``docs``: its runs ``(start, length, period)`` by start and period, in words from 0,
    and its words, joined by spaces, without those that repeat a run's first period.

    Words are what stands between ASCII white space.  A run is a maximal stretch of ``min_length`` words, and ``exponent`` times its smallest
    period, at least; ``exponent`` is 3 or more.  A null, empty or blank text has no words and no runs; repeated rows have a result each;
    other columns are not looked at; an empty table gives no rows.  A text is one row and one task's; long ones take n log n steps.
    """
    if exponent < 3 or min_length < exponent:
        raise ValueError("runs need an exponent of 3 or more, and no less words than that")
    rows = packed(docs, __text=text_of(text_col), **keep).drop("__row")
    schema = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name in keep]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, low = b.column("__text").to_pylist(), 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) // 4 <= BATCH_WORDS):
                    size += len(texts[high]) // 4
                    high += 1
                found = list(in_texts(texts[low:high], min_length, exponent))
                part = b.slice(low, high - low)
                runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in rs] for _, rs, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c, _ in schema], pa.array([n for n, _, _ in found], pa.int64()), runs, pa.array([t for _, _, t in found], pa.string())], names=[*[c for c, _ in schema], "n_words", "runs", "collapsed"])
                low = high

    told = ", ".join(f"`{c}` {t}" for c, t in schema)
    return rows.mapInArrow(go, f"{told}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic end in the texts of a tenth of the ids, as the CRC-32 of the decimal id says; a null id has none.

    Let h be that number and g = h div 10; if h % 10 = 0, each word from a = g % n on is the word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    planted = F.expr(f"""
        transform(array(filter(split(coalesce(cast(`{text_col}` as string), ''), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')), w ->
          transform(array(named_struct('g', __h div 10, 'n', cast(size(w) as bigint))), c ->
            transform(array(named_struct('a', c.g % c.n, 'p', 1 + (c.n - c.g % c.n) div (3 + c.g % 8))), s ->
              array_join(transform(w, (x, i) -> if(i >= s.a, w[cast(s.a + (i - s.a) % s.p as int)], x)), ' '))[0])[0])[0]""")
    blank = F.col(f"`{text_col}`").isNull() | (F.rtrim(F.col(f"`{text_col}`").cast("string"), F.lit(" \t\n\x0b\x0c\r")) == "")
    return docs.withColumn("__h", h).withColumn(text_col, F.when((F.col("__h") % 10 == 0) & ~blank, planted).otherwise(F.col(f"`{text_col}`"))).drop("__h")
