"""Conversation structure repair: the cheapest edits to a legal order of roles, by a Viterbi that runs in chunks.

A legal conversation is empty or an optional system turn and pairs of user and assistant turns.  What it costs to
finish one from each state of that grammar is passed backwards over the turns.  Every chunk of a conversation
starts from a guess of the costs behind it; passes mend the chunks whose guess was wrong by more than a constant, until none was.
The costs then lead the trace of the edits forwards, chunk by chunk for every state that a chunk may begin in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_ROWS, chunk_strings, entry_states, group_key, in_order
from .common import durable

#: What edits cost: a change of role, a deletion, an insertion, and leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, and behind a system, user or assistant turn.  NEXT is where an inserted or changed turn leads, ROLE what it is.
STATES, NEXT, ROLE = range(4), (2, 2, 3, 2), ("user", "user", "assistant", "user")
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"


def finish() -> tuple[int, ...]:
    """What it costs to end in each state: insertions until the conversation is whole."""
    return (0, 2 * INSERT, INSERT, 0)


def options(symbol: str, state: int, behind: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """(initial, cost to the end, next state) of the edits of a turn, without insertions before it.

    ``symbol`` is b or d for a turn that must go, else its role's initial (o for any other), in upper case where it is truncated.
    """
    out = [("D", DELETE + behind[state], state)]
    if symbol not in "bd":
        rest = TRUNCATED if symbol.isupper() else 0
        to = {"s": 1, "u": 2, "a": 3}.get(symbol.lower())
        if to is not None and (to == NEXT[state] or (to == 1 and state == 0)):
            out.append(("K", rest + behind[to], to))
        out.append(("R", REROLE + rest + behind[NEXT[state]], NEXT[state]))
    return out


class Viterbi:
    """Backward steps and forward traces, remembered by symbol and cost vector: few vectors differ once their least cost is 0."""

    def __init__(self) -> None:
        self.steps: dict[tuple, tuple] = {}
        self.traced: dict[tuple, tuple] = {}

    def step(self, symbol: str, behind: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        """The costs before a turn, less their least, and that least."""
        found = self.steps.get((symbol, behind))
        if found is None:
            plain = [min(c for _, c, _ in options(symbol, s, behind)) for s in STATES]
            full = [min(plain[s], INSERT + plain[NEXT[s]], 2 * INSERT + plain[NEXT[NEXT[s]]]) for s in STATES]
            found = self.steps[symbol, behind] = (tuple(c - min(full) for c in full), min(full))
        return found

    def back(self, symbols: str, behind: tuple[int, ...], vectors: list | None = None) -> tuple[tuple[int, ...], int]:
        """The costs before all ``symbols``, and what has been taken off them; ``vectors`` gets the costs behind each, last first."""
        lift = 0
        for symbol in reversed(symbols):
            if vectors is not None:
                vectors.append(behind)
            behind, least = self.step(symbol, behind)
            lift += least
        return behind, lift

    def move(self, symbol: str, behind: tuple[int, ...], state: int) -> tuple[str, int]:
        """The least initials of the edits up to and with a turn, of those that cost least to the end; and the state behind it."""
        found = self.traced.get((symbol, behind, state))
        if found is None:
            before, lift = self.step(symbol, behind)
            edits, at = "", state
            while True:
                ways = [w for w in options(symbol, at, behind) if w[1] == before[at] + lift]
                if before[NEXT[at]] + INSERT == before[at]:
                    ways.append(("I", 0, NEXT[at]))
                initial, _, at = min(ways)
                edits += initial
                if initial != "I":
                    break
            found = self.traced[symbol, behind, state] = (edits, at)
        return found

    def trace(self, symbols: str, vectors: list, state: int, last: bool) -> tuple[str, int]:
        out = []
        for symbol, behind in zip(symbols, reversed(vectors), strict=True):
            edits, state = self.move(symbol, behind, state)
            out.append(edits)
        if last:
            out.append("I" * (finish()[state] // INSERT))
        return "".join(out), state


def mapped(df: DataFrame, schema: str, row, *columns: str) -> DataFrame:
    """``row(machine, *values)`` of every row, in Arrow batches; one machine a task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Viterbi()
        for b in batches:
            found = [row(machine, *values) for values in zip(*[b.column(c).to_pylist() for c in columns], strict=True)]
            yield pa.RecordBatch.from_pydict({n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return df.select(*columns).mapInArrow(go, schema)


def converged(chunks: DataFrame) -> DataFrame:
    """``(key, chunk, used, out, lift)``: for each chunk the costs behind it, right but for a constant, and those before it.

    Chunks that end a conversation know what is behind them; the others begin from equal costs.
    A pass hands each chunk's costs to the one before it, and reruns the chunks that had used others.
    """

    def guess(v: Viterbi, key, chunk, symbols, last):
        used = finish() if last else (0,) * len(STATES)
        return (key, chunk, list(used), *map(lambda x: list(x) if isinstance(x, tuple) else x, v.back(symbols, used)))

    def again(v: Viterbi, key, chunk, symbols, given):
        out, lift = v.back(symbols, tuple(given))
        return key, chunk, given, list(out), lift

    schema = "key string, chunk bigint, used array<int>, out array<int>, lift bigint"
    found = durable(mapped(chunks, schema, guess, "key", "chunk", "symbols", "last"), "guessed")
    parts = found.join(chunks.where("not (first and last)").select("key", "chunk"), ["key", "chunk"], "left_semi")
    if parts.isEmpty():
        return found
    whole, parts = found.join(parts.select("key", "chunk"), ["key", "chunk"], "left_anti"), durable(parts, "parts")
    while True:
        behind = parts.select("key", (F.col("chunk") - 1).alias("chunk"), F.col("out").alias("given"))
        wrong = durable(parts.join(behind, ["key", "chunk"]).where("given <> used").select("key", "chunk", "given"), "wrong")
        if wrong.isEmpty():
            return whole.unionByName(parts)
        rerun = mapped(chunks.join(wrong, ["key", "chunk"]), schema, again, "key", "chunk", "symbols", "given")
        parts = durable(parts.join(wrong, ["key", "chunk"], "left_anti").unionByName(rerun), "parts")


def cheapest_edits(chunks: DataFrame) -> DataFrame:
    """``(key, cost, audit)`` of ``chunks(key, chunk, first, last, symbols)``: the least cost, and of the edits that cost it the least initials."""

    def trace(v: Viterbi, key, chunk, symbols, first, last, used):
        vectors: list = []
        v.back(symbols, tuple(used), vectors)
        every = [v.trace(symbols, vectors, s, last) if s == 0 or not first else ("", 0) for s in STATES]
        return key, chunk, first, last, [a for a, _ in every], [e for _, e in every]

    costs = converged(chunks)
    told = chunks.join(costs.select("key", "chunk", "used"), ["key", "chunk"])
    traces = durable(mapped(told, "key string, chunk bigint, first boolean, last boolean, audits array<string>, exits array<int>", trace, "key", "chunk", "symbols", "first", "last", "used"), "traces")
    audit = traces.join(entry_states(traces), ["key", "chunk"]).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("chunk", F.col("audits")[F.col("entry")].alias("a")))).a, "").alias("audit"))
    ends = costs.join(chunks.where("first").select("key", "chunk", "first"), ["key", "chunk"], "left")
    # costs before the first turn are those of the chunks, each less its constant, put together
    total = ends.groupBy("key").agg((F.sum("lift") + F.sum(F.when(F.col("first"), F.col("out")[0]).otherwise(0))).alias("cost"))
    return total.join(audit, "key")


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.  Nulls count as one space, but stay null in ``turn``."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    at = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), at.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), "times"))).select("conv_id", "turn", "role", "text")


def turns_of(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(key, conv, turn, role, text, digest)``; a null role or text counts as empty."""
    string = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return rows.select(group_key(conv_col).alias("key"), F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), string(role_col).alias("role"), string(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


#: The order of the turns of a conversation: those without a number first, turns of one number by role and the digest of the text.
ORDER = ("key", "turn", "role", "digest")


def examine(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(chunks, counts)``: the conversations as strings of symbols, and their gaps, faults and illegal neighbours.

    A turn's first fault counts: blank, duplicate of an earlier role and text, truncated.  Texts travel as
    digests; the earliest of equal turns is found by a minimum that is summed before the shuffle and joined, so a text that fills the table does not meet in one task.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    light = turns.select(*ORDER, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    placed = in_order(light, *ORDER)
    again = placed.where("not blank").groupBy("key", "role", "digest").agg(F.min("position").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = placed.join(again, ["key", "role", "digest"], "left")
    first = F.left("role", F.lit(1))
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    symbol = F.when(F.col("blank"), "b").when(F.col("position") > F.col("earliest"), "d").when(F.col("cut"), F.upper(initial)).otherwise(initial)
    chunks = durable(chunk_strings(told.select("key", "position", symbol.alias("symbol"), initial.alias("initial")), chunk_rows, symbols="symbol", initials="initial"), "symbols")
    number = lambda pattern: F.sum(F.regexp_count("symbols", F.lit(pattern))).cast("bigint")
    legal = F.regexp_count("initials", F.lit("(?=su|ua|au)"))
    behind = chunks.select("key", (F.col("chunk") - 1).alias("chunk"), F.left("initials", F.lit(1)).alias("next"))
    between = chunks.where("not last").join(behind, ["key", "chunk"]).groupBy("key").agg(F.count_if(~F.concat(F.right("initials", F.lit(1)), "next").isin(*LEGAL)).alias("seams"))
    faults = chunks.groupBy("key").agg(number("b").alias("blank"), number("d").alias("duplicate"), number("[SUAO]").alias("truncated"), F.sum(F.length("initials") - 1 - legal).cast("bigint").alias("inner"))
    gaps = placed.groupBy("key", "turn").count().groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = gaps.join(faults, "key").join(between, "key", "left")
    return chunks, counts.select("key", "gaps", "blank", "duplicate", "truncated", (F.col("inner") + F.coalesce("seams", F.lit(0))).alias("illegal"))


def apply_edits(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """``(key, n, role, text)``: the repaired turns, numbered from 0; those of a conversation stand in one partition in order.

    A conversation's edits come first and its turns follow, a batch at a time, so however long it is, only its edits are held.
    """
    edits = audits.select("key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.col("audit").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"))
    both = edits.unionByName(turns.select("key", F.lit(1).alias("kind"), "turn", "role", "text", "digest"))
    dealt = both.repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "digest").select("key", "kind", "role", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, n = None, "", 0, 0, 0
        out: list[tuple] = []

        def insertions() -> None:
            nonlocal at, state, n
            while at < len(audit) and audit[at] == "I":
                out.append((key, n, ROLE[state], ""))
                at, state, n = at + 1, NEXT[state], n + 1

        for b in batches:
            for k, kind, role, text in zip(*[b.column(c).to_pylist() for c in ("key", "kind", "role", "text")], strict=True):
                if kind == 0:
                    insertions()
                    key, audit, at, state, n = k, role, 0, 0, 0
                    continue
                insertions()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, state = ROLE[state], NEXT[state]
                else:
                    state = {"s": 1, "u": 2, "a": 3}[role[:1]]
                out.append((key, n, role, text))
                n += 1
            yield batch(out)
            out.clear()
        insertions()
        yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("key", pa.string()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string())))})

    return dealt.mapInArrow(go, "key string, n bigint, role string, text string")


def line_digests(lines: DataFrame) -> DataFrame:
    """``(key, sha256)`` of ``lines(key, line)`` joined by newlines, as they stand in order in their partitions.

    A digest of a whole conversation is sequential by its nature; the lines run through it a batch at a time.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            done = []
            for k, line in zip(b.column("key").to_pylist(), b.column("line").to_pylist(), strict=True):
                if k != key:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array([d[0] for d in done], pa.string()), "sha256": pa.array([d[1] for d in done], pa.string())})
        if sha is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "sha256": [sha.hexdigest()]})

    return lines.select("key", "line").mapInArrow(go, "key string, sha256 string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(summary, repaired)``: ``(key, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation, and
    ``(key, n, role, text)`` of its turns after the cheapest edits.

    ``key`` is :func:`chunks.group_key` of the conversation.  A null conversation is one of its own, a null role or text is empty, turns
    without a number come first, and repeated rows are duplicates.  Other columns are not looked at; an empty table gives no rows.
    """
    turns = turns_of(rows, conv_col, turn_col, role_col, text_col)
    chunks, counts = examine(turns, chunk_rows)
    edits = durable(cheapest_edits(chunks), "edits")
    return counts.join(edits, "key"), apply_edits(turns, edits)
