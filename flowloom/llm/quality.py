"""Quality rules: exact text statistics and a hashed n-gram logistic regression with calibrated probabilities."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, packed, text_of

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
DIMENSIONS = 1 << 16


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse() -> np.uint64:
    return np.uint64(pow(int(BASE), -1, 1 << 64))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of UTF-8 bytes, split at ASCII white space."""
    gap = SPACE[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, end, np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        p = _powers(len(raw))
        g = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * MIX * p, dtype=np.uint64)])
        inv = np.full(len(raw), _inverse(), dtype=np.uint64)
        inv[:1] = 1
        h = (g[end] - g[start]) * np.multiply.accumulate(inv)[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return start, end, h


@dataclass
class Facts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def facts(text: str, raw: np.ndarray, words: np.ndarray) -> Facts:
    inside = ~SPACE[raw]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    n, repeated = len(words), 0
    if n >= 3:
        with np.errstate(over="ignore"):
            three = (words[:-2] * MIX + words[1:-1]) * BASE + words[2:] * np.uint64(0x94D049BB133111EB)
        order = np.sort(three)
        same = order[1:] == order[:-1]
        if same.any():
            found = np.isin(three, np.unique(order[1:][same]))
            at, spelt = np.flatnonzero(found), raw.tobytes().split()
            windows = [(spelt[i], spelt[i + 1], spelt[i + 2]) for i in at.tolist()]  # hashes choose, words decide
            times = Counter(windows)
            found[at] = [times[w] > 1 for w in windows]
            marks = np.zeros(n, dtype=bool)
            for k in range(3):
                marks[k : n - 2 + k] |= found
            repeated = int(marks.sum())
    return Facts(n, int((inside & ((raw & 0xC0) != 0x80)).sum()), int(SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated)


def features(text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of words, word pairs and runs of 2 to 4 characters (code points), each kind of length one."""
    ids, values = [], []

    def add(h: np.ndarray, kind: int) -> None:
        if len(h):
            with np.errstate(over="ignore"):
                x = (h + np.uint64(kind)) * MIX
            at, n = np.unique((x >> np.uint64(48)).astype(np.int64), return_counts=True)
            v = np.sqrt(n.astype(np.float64))
            ids.append(at)
            values.append(v / np.sqrt((v * v).sum()))

    with np.errstate(over="ignore"):
        add(words, 1)
        add(words[:-1] * BASE + words[1:], 2)
        c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        h = c * MIX
        for n in (2, 3, 4):
            if len(c) >= n:
                h = h[:-1] * BASE + c[n - 1 :] * MIX
                add(h, 2 + n)
    return (np.concatenate(ids), np.concatenate(values)) if ids else (np.zeros(0, np.int64), np.zeros(0))


@dataclass
class Model:
    """Weights, bias and the two numbers that turn a margin into a calibrated probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margin) + self.offset, -30, 30)))


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins probabilities: Newton's steps on smoothed targets, each halved until it
    lowers the loss, so that held-out rows that separate cleanly give finite numbers too."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(ab):
        z = ab[0] * x + ab[1]
        return (np.logaddexp(0, z) - t * z).sum()

    ab = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * x + ab[1], -500, 500)))
        h = p * (1 - p)
        g = np.array([((p - t) * x).sum(), (p - t).sum()])
        step = np.linalg.solve(np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]]), g)
        now, size = loss(ab), 1.0
        while loss(ab - size * step) > now and size > 1e-10:
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 150, held_out: int = 5) -> Model | None:
    """Logistic regression by Adagrad on all but every ``held_out``-th row, calibrated (Platt) on those.

    None when the labels are of one kind only.
    """
    y = np.asarray(labels, dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return None
    calibrate = np.arange(len(y)) % held_out == 0
    if len(set(y[calibrate])) < 2 or len(set(y[~calibrate])) < 2:
        calibrate = np.zeros(len(y), dtype=bool)
    at = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * (~calibrate)
    balance /= balance.sum()
    w, b = np.zeros(DIMENSIONS), 0.0
    gw, gb = np.full(DIMENSIONS, 1e-8), 1e-8

    pieces = [slice(i, i + (1 << 19)) for i in range(0, max(1, len(at)), 1 << 19)]  # so that a step's temporaries stay small

    def margins():
        return sum(np.bincount(row[p], weights=val[p] * w[at[p]], minlength=len(rows)) for p in pieces) + b

    for _ in range(rounds):
        d = (1 / (1 + np.exp(-np.clip(margins(), -30, 30))) - y) * balance
        g = sum(np.bincount(at[p], weights=val[p] * d[row[p]], minlength=DIMENSIONS) for p in pieces) + 1e-6 * w
        gw, gb = gw + g * g, gb + d.sum() ** 2
        w, b = w - 0.3 * g / np.sqrt(gw), b - 0.3 * d.sum() / np.sqrt(gb)
    m, slope, offset = margins(), 1.0, 0.0
    if calibrate.any():
        slope, offset = platt(m[calibrate], y[calibrate])
        if slope <= 0:  # held-out rows too few to tell
            slope, offset = 1.0, 0.0
    return Model(w, float(b), float(slope), float(offset))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8"), dtype=np.uint8)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1000, max_bytes: int = 1 << 27) -> Model | None:
    """Fit on ``per_class`` labelled rows of each kind at most, those with the smallest hashed ids.

    The features of these texts, made on the executors from whole texts, are what reaches the driver:
    of each kind's rows, in that order, as many as begin within half of ``max_bytes``.
    These two bounds make the only sample in this module.  Labels other than 0 and 1, null
    ids and labels without a document are ignored.
    """
    usable = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("y in (0, 1) and id is not null")
    chosen = None
    for kind in (0, 1):
        part = usable.where(F.col("y") == kind).distinct().orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column("text").to_pylist():
                raw = _bytes(t)
                at, v = features(t, word_hashes(raw)[2])
                found.append((at.astype("<u2").tobytes(), v.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["id", "y", "at", "v"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text")).where("id is not null")
    made = durable(src.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(go, "id long, y int, at binary, v binary"), "features")  # 2 * per_class documents
    before = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = made.groupBy("id", "y").agg(F.sum(F.length("at") + F.length("v")).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    got = made.join(F.broadcast(sizes.where(F.col("before") < max_bytes // 2).select("id", "y")), ["id", "y"]).toPandas()
    if not len(got):
        return None
    got["key"] = [hash(x) for x in zip(got["id"], got["at"].map(len))]
    got = got.sort_values(["id", "key"])
    rows = [(np.frombuffer(a, "<u2"), np.frombuffer(v, "<f4")) for a, v in zip(got["at"], got["v"])]  # views, not copies
    return fit(rows, got["y"].to_numpy())


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as struct ``__row`` with its statistics, probability of quality 1 and verdict.

    base_failed: under 50 words, or over half of the words in repeated 3-word
    windows.  kept: not base_failed and a probability of at least ``threshold``;
    without a model (no usable labels) the probability is null and the base rule
    decides.  A null text has no words and fails.  Rows are scored one by one in
    Arrow batches, so repeated rows, ties and sources need no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def verdict(text: str):
        m, raw = shared.value, _bytes(text)
        start, end, words = word_hashes(raw)
        f = facts(text, raw, words)
        failed, p = f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words, None
        if m is not None:
            at, v = features(text, words)
            p = float(m.probability((v * m.weights[at]).sum() + m.bias))
        return {"n_words": f.n_words, "word_chars": f.word_chars, "n_symbols": f.n_symbols, "n_dup_lines": f.n_dup_lines, "n_repeat_words": f.n_repeat_words, "base_failed": failed, "probability": p, "kept": not failed and (p is None or p >= threshold)}

    @F.pandas_udf(SCORED)
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verdict(t) for t in texts], columns=[x.split()[0] for x in SCORED.split(", ")])

    # marked nondeterministic so that a later filter on the verdict does not score every row twice
    return packed(docs, __s=scored.asNondeterministic()(text_of(text_col))).select("__row", "__s.*")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that :func:`score` rejects; same columns."""
    return score(docs, train(docs, labels), threshold).where("kept").select("__row.*")
