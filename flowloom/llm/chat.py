"""Chat formatting: a declarative template, a finite-state machine over its roles, segments with loss flags, and the way back.

The template says what stands around a turn, which roles are trained on, and which may follow which.  Formatting looks at a row alone,
so it needs no shuffle; the machine runs over chunks of each conversation, whose maps from state to state are composed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_ROWS, chunk_strings, entry_states, group_key, in_order
from .common import durable


@dataclass(frozen=True)
class Template:
    """What a formatted turn looks like: ``opening role \\n text closing \\n``.

    Both control strings begin with the two characters that :meth:`escaped` never leaves together in a role or text.
    ``follows`` gives, for a role or ``start``, the roles that may come next; ``ends`` is where a conversation may end.
    Texts of the roles in ``trained`` count for the loss.
    """

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("start", "assistant")

    def __post_init__(self) -> None:
        mark = self.opening[:2]
        if len(mark) < 2 or mark != self.closing[:2] or mark[0] == mark[1] or "\\" in mark or "\n" in mark or self.opening == self.closing:
            raise ValueError("control strings must differ and begin with the same two characters, which differ and are no backslash or newline")

    def escaped(self, c: Column) -> Column:
        """Backslashes doubled, and one put inside every pair of characters that begins a control string."""
        mark = self.opening[:2]
        return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(mark), F.lit(f"{mark[0]}\\{mark[1]}"))

    def header(self, role: Column) -> Column:
        return F.concat(F.lit(self.opening), F.replace(self.escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))

    def unescaped(self, s: str) -> str:
        if "\\" not in s:
            return s
        out, at = [], 0
        while (found := s.find("\\", at)) >= 0:
            out.append(s[at:found])
            out.append("\n" if s[found + 1] == "n" else s[found + 1])
            at = found + 2
        return "".join(out) + s[at:]

    @property
    def states(self) -> list[str]:
        """``start``, the roles, and one state for any role that the template does not know."""
        return ["start", *sorted({r for rs in self.follows.values() for r in rs} | set(self.follows) - {"start"}), "other"]


def turns_of(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    string = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    told = rows.select(group_key(conv_col).alias("key"), F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), string(role_col).alias("role"), string(text_col).alias("text"))
    return told.withColumn("digest", F.unhex(F.sha2("text", 256)))


ORDER = ("key", "turn", "role", "digest")


def format_turns(rows: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(key, conv, turn, role, digest, segments)``: each turn as array of ``(text, loss)``: its header, its text, and its end.

    A null role or text is empty, a null conversation one of its own.  Joined in the order of ``key, turn, role, digest``, nulls first, the
    segments are the formatted conversation; rows that tie in all of these are equal.  An empty table gives no rows.
    """
    turns = turns_of(rows, conv_col, turn_col, role_col, text_col)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.array(piece(template.header(F.col("role")), F.lit(False)), piece(template.escaped(F.col("text")), F.col("role").isin(*template.trained)), piece(F.lit(f"{template.closing}\n"), F.lit(False)))
    return turns.select("key", "conv", "turn", "role", "digest", segments.alias("segments"))


def validate_turns(turns: DataFrame, template: Template = Template(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, n_illegal, first_illegal, well_ended)``: turns that may not follow what is before them, the first one's number from 0 in
    its conversation (null: none), and whether the conversation ends where it may.  ``turns`` has :data:`ORDER` without texts.

    The machine's state is the role that was read last, or ``other``, behind which nothing is legal but what may open a conversation.  Chunks run
    from every state at once.
    """
    states = template.states
    letter = {s: chr(ord("a") + i) for i, s in enumerate(states)}
    legal = {(states.index(a), letter[b]) for a, bs in {**template.follows, "other": template.follows["start"]}.items() for b in bs}
    symbol = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s, c in letter.items() if s not in ("start", "other") for x in (s, c)]), F.col("role")), F.lit(letter["other"]))
    placed = in_order(turns.select(*ORDER), *ORDER).select("key", "position", symbol.alias("symbol"))
    chunks = durable(chunk_strings(placed, chunk_rows, symbols="symbol"), "roles")

    def run(symbols: str, state: int) -> tuple[int, int | None, int]:
        """How many turns are illegal, which is the first, and the state behind them all, from a state on."""
        n, first = 0, None
        for i, c in enumerate(symbols):
            if (state, c) not in legal:
                n, first = n + 1, i if first is None else first
            state = ord(c) - ord("a")
        return n, first, state

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[run(s, state) for state in range(len(states))] for s in b.column("symbols").to_pylist()]
            made = [pa.array([[r[i] for r in rs] for rs in found], pa.list_(pa.int32())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("key", "chunk", "first", "last", "size")], *made], names=["key", "chunk", "first", "last", "size", "illegal", "at", "exits"])

    maps = chunks.withColumn("size", F.length("symbols")).select("key", "chunk", "first", "last", "size", "symbols").mapInArrow(go, "key string, chunk bigint, first boolean, last boolean, size int, illegal array<int>, at array<int>, exits array<int>")
    maps = durable(maps, "machine")
    # a chunk but the first and last of a conversation is full
    opened = maps.where("first").select("key", F.col("chunk").alias("low"), F.col("size").alias("head"))
    run_ = maps.join(entry_states(maps), ["key", "chunk"]).join(opened, "key")
    number = F.when(F.col("first"), 0).otherwise(F.col("head") + (F.col("chunk") - F.col("low") - 1) * chunk_rows) + F.col("at")[F.col("entry")]
    ends = F.col("exits")[F.col("entry")].isin(*[states.index(e) for e in template.ends])
    return run_.groupBy("key").agg(F.sum(F.col("illegal")[F.col("entry")]).alias("n_illegal"), F.min(number).cast("bigint").alias("first_illegal"), F.max(F.when(F.col("last"), ends)).alias("well_ended"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of every formatted conversation, from its segments alone.

    The joined text is cut at the control strings, without regard to where segments end, and unescaped; what the loss flags cover is
    unescaped by itself.  A digest over a conversation is sequential by its nature: its turns are sorted outside of memory and stream through it, a batch at a time.
    """
    dealt = formatted.select(*ORDER, F.transform("segments", lambda s: s["text"]).alias("texts"), F.transform("segments", lambda s: s["loss"]).alias("losses")).repartition("key").sortWithinPartitions(*ORDER).select("key", "texts", "losses")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, None
        for b in batches:
            done = []
            for k, texts, losses in zip(*[b.column(c).to_pylist() for c in ("key", "texts", "losses")], strict=True):
                if found is None or k != key:
                    if found is not None:
                        done.append((key, *found.result()))
                    key, found = k, Reader(template)
                found.feed(texts, losses)
            yield table(done)
        if found is not None:
            yield table([(key, *found.result())])

    columns = (("key", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(columns)})

    return dealt.mapInArrow(go, "key string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


class Reader:
    """Reads one formatted conversation piece by piece."""

    def __init__(self, template: Template) -> None:
        self.template, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.rest, self.n, self.loss_chars, self.chars = "", 0, 0, 0

    def feed(self, texts: list[str], losses: list[bool]) -> None:
        t = self.template
        for text, loss in zip(texts, losses, strict=True):
            self.chars += len(text)
            if loss:
                plain = t.unescaped(text)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
        whole, at, end = self.rest + "".join(texts), 0, f"{t.closing}\n"
        while (close := whole.find(end, at)) >= 0:
            if not whole.startswith(t.opening, at):
                raise ValueError("a formatted turn does not begin with its control string")
            line = whole.index("\n", at)
            role, text = t.unescaped(whole[at + len(t.opening) : line]), t.unescaped(whole[line + 1 : close])
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n, at = self.n + 1, close + len(end)
        self.rest = whole[at:]

    def result(self) -> tuple[int, str, int, str, int]:
        if self.rest:
            raise ValueError("a formatted conversation ends inside a turn")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
