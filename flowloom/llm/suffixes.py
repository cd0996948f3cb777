"""Passages that repeat across documents, from a sparse suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, packed, text_of
from .quality import word_hashes

#: Odd multiplier of the rolling hash.
ROLL = np.uint64(0xD6E8FEB86659FD93)
#: Stands for a null id, which sorts last.
NO_ID = (1 << 63) - 1


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of words times powers, and the inverse powers, so that any run has a hash of its own."""
    with np.errstate(over="ignore"):
        p = np.full(len(words), ROLL, dtype=np.uint64)
        inv = np.full(len(words) + 1, np.uint64(pow(int(ROLL), -1, 1 << 64)), dtype=np.uint64)
        p[:1] = inv[:1] = 1
        g = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.multiply.accumulate(p), dtype=np.uint64)])
        return g, np.multiply.accumulate(inv)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    g, inv = _sums(words)
    with np.errstate(over="ignore"):
        h = (g[n:] - g[:-n]) * inv[: len(words) - n + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def minimisers(words: np.ndarray, k: int, window: int) -> np.ndarray:
    """For each ``window`` consecutive k-word runs, where the one with the least hash starts, the first on a tie.

    That depends on the content of the window alone, so every passage of
    ``k + window - 1`` words has its suffix at the same place wherever it stands.
    """
    h = runs(words, k)
    out = [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(h) - window + 1, 100_000):
        part = h[at : at + 100_000 + window - 1]
        out.append(np.lib.stride_tricks.sliding_window_view(part, window).argmin(axis=1) + np.arange(at, at + len(part) - window + 1))
    return np.concatenate(out)


class Text:
    """The words of a text, joined by single spaces, with their places there and hashes for choosing suffixes."""

    def __init__(self, text: str):
        self.joined = b" ".join(text.encode("utf-8").split())
        self.start, self.end, self.hashes = word_hashes(np.frombuffer(self.joined, dtype=np.uint8))

    def passages(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Two numbers a passage of ``n`` words: the 128-bit BLAKE2b digest of its words."""
        digest = hashlib.blake2b
        low, high = self.start[starts].tolist(), self.end[starts + n - 1].tolist()
        return np.frombuffer(b"".join([digest(self.joined[a:b], digest_size=16).digest() for a, b in zip(low, high)]), dtype="<i8").reshape(-1, 2)


#: A key to sort by, whose place it is, whether the same task has another of that key, and places that need no sorting.
KEYED = "h long, more long, id long, doc long, at int, met boolean, local array<int>"
PLACE = "id long, doc long, at int, copy boolean"


def _keyed(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Of the keys of some documents ``(id, doc, keys, at)``: the first place of each key, to be sorted with other
    tasks' ones, and for each document, in one row, its places whose key stands at an earlier place among these documents."""
    sizes = [len(at) for _, _, _, at in found]
    owner = np.repeat(np.arange(len(found)), sizes)
    keys, at = np.concatenate([k for _, _, k, _ in found]), np.concatenate([x for _, _, _, x in found])
    ids, docs = np.array([i for i, _, _, _ in found], dtype=np.int64), np.array([d for _, d, _, _ in found], dtype=np.int64)
    order = np.lexsort((at, docs[owner], ids[owner], keys[:, 1], keys[:, 0]))
    same = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
    first = np.concatenate([[True], ~same])
    met = first & np.concatenate([same, [False]])
    sent, rest = order[first], np.sort(order[~first])
    cuts = np.flatnonzero(np.diff(owner[rest], prepend=-1))  # rest is by document again
    local = np.split(at[rest], cuts[1:]) if len(rest) else []
    holders = owner[rest][cuts] if len(rest) else np.zeros(0, dtype=np.int64)
    n, m = len(sent), len(holders)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([keys[sent, 0], docs[holders]])),
            pa.array(np.concatenate([keys[sent, 1], np.zeros(m, np.int64)])),
            pa.array(np.concatenate([ids[owner[sent]], ids[holders]])),
            pa.array(np.concatenate([docs[owner[sent]], docs[holders]])),
            pa.array(np.concatenate([at[sent], np.full(m, -1)]).astype(np.int32)),
            pa.array(np.concatenate([met[first], np.zeros(m, bool)])),
            pa.array([None] * n + [x.astype(np.int32) for x in local], pa.list_(pa.int32())),
        ],
        names=["h", "more", "id", "doc", "at", "met", "local"],
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys in order, the places whose key equals a neighbour's; ``copy`` where an earlier place has it."""
    names = ("h", "more", "id", "doc", "at", "met")
    last, last_copy = None, False

    def told(v, copy, live):
        return pa.RecordBatch.from_arrays([pa.array(v["id"][live]), pa.array(v["doc"][live]), pa.array(v["at"][live].astype(np.int32)), pa.array(copy[live])], names=["id", "doc", "at", "copy"])

    for b in batches:
        v = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
        held = v["at"] < 0
        if held.any():
            local = b.column("local").filter(pa.array(held))
            n = np.diff(local.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(v["id"][held], n)), pa.array(np.repeat(v["doc"][held], n)), local.flatten(), pa.array(np.ones(n.sum(), bool))], names=["id", "doc", "at", "copy"])
            v = {c: x[~held] for c, x in v.items()}
        if last is not None:
            v = {c: np.concatenate([last[c], x]) for c, x in v.items()}
        n = len(v["h"])
        if not n:
            continue
        same = (v["h"][1:] == v["h"][:-1]) & (v["more"][1:] == v["more"][:-1])
        copy = np.concatenate([[last_copy], same])
        live = copy | np.concatenate([same, [False]]) | v["met"]
        live[-1] = False  # not before its next neighbour is seen
        if live.any():
            yield told(v, copy, live)
        last, last_copy = {c: x[-1:] for c, x in v.items()}, bool(copy[-1])
    if last is not None and (last_copy or last["met"][0]):
        yield told(last, np.array([last_copy]), np.array([True]))


def repeats(rows: DataFrame, keys_of: Callable[..., tuple[np.ndarray, np.ndarray]], *more: str) -> DataFrame:
    """``(id, doc, at, copy)``: the places in ``rows(__id, __doc, __text, <more>)`` whose key stands at another place too.

    ``keys_of(text, *more)`` gives keys (two numbers each) and their places.  Keys
    are sorted and compared with their neighbours.  Of a key that several places in one
    batch have, one place is sent to the sort and the rest are known to repeat it, so that a hot key is as many
    rows there as batches hold it; equal keys share a partition, so no border parts them.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i, d, t, *x in zip(*(b.column(c).to_pylist() for c in ("__id", "__doc", "__text", *more))):
                keys, at = keys_of(Text(t), *x)
                if len(at):
                    found.append((i, d, keys, at))
            if found:
                yield _keyed(found)

    keyed = rows.select("__id", "__doc", "__text", *more).mapInArrow(go, KEYED)
    return keyed.repartition("h").sortWithinPartitions("h", "more", "id", "doc", "at").mapInArrow(_neighbours, PLACE)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = packed(docs, __id=F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), __text=text_of(text_col))
    return rows.withColumn("__doc", F.xxhash64(F.col(f"__row.`{id_col}`").cast("long"), "__text"))


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, k: int = 16) -> tuple[DataFrame, DataFrame]:
    """The texts that repeat anything, ``(__id, __doc, __text)``, and where: ``(id, doc, starts, firsts)``.

    ``starts`` are the words from which on ``min_words`` words stand at another place
    too, ``firsts`` those of them that no other place precedes, by id and then by start.

    The sparse suffix array has a suffix at each minimiser.  Suffixes are sorted
    by a hash of their first k words and one that differs from both neighbours is out; a
    passage of ``min_words`` has a suffix in its first ``min_words - k + 1`` words,
    so the rest hold every repeat.  From each survivor the match is extended left
    and right over the words of its text, to the passages of ``min_words`` whose suffix it is; those are
    sorted in turn by the digest of all their words, and neighbours of one digest are repeats.
    No list of partners is made, and no pair.
    """
    window = min_words - k + 1
    rows = _numbered(docs, id_col, text_col).drop("__row")

    def suffixes(text: Text) -> tuple[np.ndarray, np.ndarray]:
        pos = np.unique(minimisers(text.hashes, k, window))
        first = runs(text.hashes, k)[pos].view(np.int64) if len(pos) else np.zeros(0, np.int64)
        return np.stack([first, np.zeros_like(first)], axis=1), pos

    def extended(text: Text, live: list[int]) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.isin(minimisers(text.hashes, k, window), np.asarray(live)))
        return text.passages(starts, min_words), starts

    alive = durable(repeats(rows, suffixes).groupBy("id", "doc").agg(F.collect_set("at").alias("alive")), "suffixes")  # as many as the text has
    texts = durable(rows.join(alive, (F.col("__id") == F.col("id")) & (F.col("__doc") == F.col("doc"))).select("__id", "__doc", "__text", "alive"), "texts")
    places = repeats(texts, extended, "alive")
    firsts = F.collect_set(F.when(~F.col("copy"), F.col("at")))
    found = durable(places.groupBy("id", "doc").agg(F.collect_set("at").alias("starts"), firsts.alias("firsts")), "places")  # as many as the text has
    return texts.drop("alive"), found


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, k: int = 16) -> DataFrame:
    """Every span of words that passages of ``min_words`` cover which stand elsewhere too; passages that overlap or touch are one span.

    Returns ``(doc_id, start_word, end_word, span_chars)``, end exclusive; words are what ASCII
    white space leaves and are compared as they are, in whole texts, by :func:`repeated_places`.

    A repeat within one document counts.  Null, empty and short texts have no
    spans; rows with a null id take part under a null id; rows that share an id
    are told apart by a hash of their text, and repeated rows repeat each other.  An empty table gives no rows.
    """
    texts, found = repeated_places(docs, id_col, text_col, min_words, k)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, t, at in zip(*(b.column(c).to_pylist() for c in ("__id", "__text", "starts"))):
                start, end, _ = word_hashes(np.frombuffer(raw := t.encode("utf-8"), dtype=np.uint8))
                s = np.sort(np.asarray(at, dtype=np.int64))
                cut = np.flatnonzero(np.diff(s) > min_words)
                for first, last in zip(s[np.concatenate([[0], cut + 1])], s[np.concatenate([cut, [len(s) - 1]])]):
                    out.append((None if i == NO_ID else i, int(first), int(last) + min_words, len(raw[start[first] : end[last + min_words - 1]].decode("utf-8"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start_word", "end_word", "span_chars"])

    met = texts.join(found, (F.col("__id") == F.col("id")) & (F.col("__doc") == F.col("doc"))).select("__id", "__text", "starts")
    return met.mapInArrow(spans, "doc_id long, start_word long, end_word long, span_chars long")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, k: int = 16) -> DataFrame:
    """``docs`` with each repeated passage left at its first place only; same rows, same columns.

    The first place is the one with the smallest id, then start.  Words that only
    passages with an earlier place cover go, with the white space after them; every
    passage still stands whole somewhere.  Texts without such passages, null
    ones included, stay as they are; of rows equal in id and text, all count as one first place.
    """
    _, found = repeated_places(docs, id_col, text_col, min_words, k)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, firsts: pd.Series) -> pd.Series:
        out = []
        for t, at, kept in zip(texts, starts, firsts):
            if t is None or at is None:
                out.append(t)
                continue
            start, _, words = word_hashes(np.frombuffer(raw := t.encode("utf-8"), dtype=np.uint8))
            gone, stay = np.zeros(len(words) + 1, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64)
            for marks, which in ((gone, np.setdiff1d(at, kept)), (stay, np.asarray(kept, dtype=np.int64))):
                np.add.at(marks, which.astype(np.int64), 1)
                np.add.at(marks, which.astype(np.int64) + min_words, -1)
            drop = (np.cumsum(gone)[:-1] > 0) & (np.cumsum(stay)[:-1] == 0)
            edge = np.concatenate([start, [len(raw)]])
            out.append((raw[: edge[0]] + b"".join([raw[edge[n] : edge[n + 1]] for n in np.flatnonzero(~drop)])).decode("utf-8"))
        return pd.Series(out, dtype=object)

    rows = _numbered(docs, id_col, text_col)
    met = rows.join(found, (F.col("__id") == F.col("id")) & (F.col("__doc") == F.col("doc")), "left")
    text = F.when(F.col("starts").isNotNull(), cut(F.col("__text"), F.col("starts"), F.col("firsts"))).otherwise(F.col(f"__row.`{text_col}`").cast("string"))

    def column(c: str) -> Column:
        return (text if c == text_col else F.col(f"__row.`{c}`")).alias(c)

    return met.select(*[column(c) for c in docs.columns])
