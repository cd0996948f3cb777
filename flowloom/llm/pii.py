"""Personal data: exact base patterns, and contextual extraction bootstrapped from what they find."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, packed, text_of

KINDS = ("email", "ip", "card", "phone")
#: The kinds of base patterns, and one that only the method adds.
ALL_KINDS = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a later start in a run of digits can't match where its first one doesn't
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Seeds of the added kind: what stands after a word for a credential and a sign of assignment; a token of another name, a page's say, is none.
SECRET = re.compile(r"(?i)(?:(?<![A-Za-z_.-])|(?<=auth[_-])|(?<=access[_-])|(?<=refresh[_-])|(?<=bearer[_-])|(?<=session[_-])|(?<=api[_-]))(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_.=-]{16,})")
#: What is no identifier though it has many digits: dates and times, and numbers with marks between thousands.
PLAIN = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9:.]+Z?)?|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}|[0-9]{1,3}(?:[,.'][0-9]{3})+(?:[.,][0-9]+)?")
MARKED = re.compile(r"[0-9@]")
TOKENS = re.compile(r"\S+")
GROUPS = re.compile(r"\+?\(?[0-9](?:[().-]*[0-9])*")  # a run of digit groups goes on over the characters of PHONE


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: from each @ back over the local part, then on over the domain.

    Looking from the @ keeps it linear in texts with long runs of such characters.
    """
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns, by kind and then start, in code points."""
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def refused(s: str) -> bool:
    """Whether a candidate is known to be none: its whole is a card number or an address that fails its test, or :data:`PLAIN`."""
    if PLAIN.fullmatch(s):
        return True
    if CARD.fullmatch(s) and len(s) >= 13:
        return 13 <= len(d := _digits(s)) <= 19 and not luhn(d)
    return IP.fullmatch(s) is not None


def secrets(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Values of at least 16 characters, letters and digits, that a word before them calls a credential, outside the base spans."""
    out = []
    for m in SECRET.finditer(text):
        s, e = m.span(1)
        value = m[1].rstrip(".")
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and not any(a < e and s < b for _, a, b in taken):
            out.append((len(KINDS), s, s + len(value)))
    return out


def spans_text(spans) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e in spans)


def looks(s: str) -> str:
    """What an identifier looks like at most: with an @, of digits alone, or mixed."""
    return "@" if "@" in s else "a9" if any(c.isalpha() for c in s) else "9"


def tokens(text: str) -> tuple[list[int], list[int]]:
    """Where the runs without white space start and end."""
    found = [m.span() for m in TOKENS.finditer(text)]
    return [s for s, _ in found], [e for _, e in found]


def contexts(text: str, start: int, end: int, at: tuple[list[int], list[int]] | None = None) -> list[str]:
    """Lexical patterns around a span: the words on either side (digits masked, lower-cased).

    Two words on the left stand alone; a single one also tells by :func:`looks`.  A word on the
    left goes on over the signs after it.  Words are whole; a digest stands for a long one.
    The span's own form is a pattern too: every digit a 0, every letter an a.
    """
    starts, ends = tokens(text) if at is None else at

    def plain(w: str) -> str:
        return instance(re.sub(r"[0-9]+", "0", w))

    left, signs, i = [], "", bisect_left(starts, start)
    while i > 0 and len(left) < 2:
        i -= 1
        w = text[starts[i] : min(ends[i], start)]
        if any(c.isalnum() for c in w) or len(signs) > 8:
            left.insert(0, plain(w + signs))
            signs = ""
        else:
            signs = f" {w}{signs}"
    j = bisect_right(ends, end)
    right = plain(text[max(starts[j], end) : ends[j]]) if j < len(ends) else None
    form = looks(text[start:end])
    out = [f"f|{instance(re.sub('[^\\W_]', 'a', re.sub('[0-9]', '0', text[start:end])))}"]
    if left:
        out.append(f"l1|{left[-1]}|{form}")
        if right is not None:
            out.append(f"lr|{left[-1]}|{right}|{form}")
    if len(left) > 1:
        out.append(f"l2|{left[0]} {left[1]}")
    return out


def instance(s: str) -> str:
    """The string itself, lower-cased, or a digest that stands for a long one."""
    s = s.lower()
    return s if len(s) <= 64 else hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest()


def _number_runs(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """From every digit group on, as many groups as PHONE would join, up to the 19 digits of the longest base pattern."""
    found = [(m.start(), m.end()) for m in GROUPS.finditer(text, low, high)]
    runs: list[list[tuple[int, int]]] = []
    for s, e in found:
        if (s > 0 and (text[s - 1].isalnum() or text[s - 1] == "_")) or (e < len(text) and (text[e].isalpha() or text[e] == "_")):
            runs.append([])  # part of a token with letters
        elif runs and runs[-1] and text[s] != "+" and not text[runs[-1][-1][1] : s].strip(" ().-"):
            runs[-1].append((s, e))
        else:
            runs.append([(s, e)])
    for run in runs:
        sizes, last, total = [len(_digits(text[s:e])) for s, e in run], 0, 0
        for i, (s, _) in enumerate(run):
            while last < len(run) and (last == i or total + sizes[last] <= 19):
                total += sizes[last]
                last += 1
            if total >= 6:
                yield s, run[last - 1][1]
            total -= sizes[i]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What may be an identifier outside the base spans: tokens with six digits or more or an @ inside, and
    runs of digit groups with six digits or more; at full length, the longest from each start."""
    held: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if held and s < held[-1][1]:
            held[-1][1] = max(held[-1][1], e)
        else:
            held.append([s, e])
    starts, out = [s for s, _ in held], {}
    for m in TOKENS.finditer(text):
        a, b = m.span()
        while a < b and not text[a].isalnum() and text[a] not in "+(":
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b and text[a] == "(" and not (a + 1 < b and "0" <= text[a + 1] <= "9"):
            while a < b and not text[a].isalnum() and text[a] != "+":
                a += 1
        at = bisect_right(starts, b - 1) - 1
        token = text[a:b]
        if (len(_digits(token)) >= 6 or 0 < token.find("@") < len(token) - 1) and (at < 0 or held[at][1] <= a):
            out[a] = b
    for low, high in zip([0, *[e for _, e in held]], [*starts, len(text)], strict=True):
        for s, e in _number_runs(text, low, high):
            out[s] = max(e, out.get(s, 0))
    return sorted(out.items())


def occurrences(rows: DataFrame) -> DataFrame:
    """One row a document: its base spans, and every seed and candidate with its patterns."""
    kinds = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, seen = [], []
            for t in b.column("__text").to_pylist():
                if MARKED.search(t) is None:  # nor is there a secret: it has digits
                    base.append([])
                    seen.append([])
                    continue
                found = base_spans(t)
                base.append([list(x) for x in found])
                seeds = found + secrets(t, found)
                at = seeds + [(-2 if refused(t[s:e]) else -1, s, e) for s, e in candidates(t, seeds)]
                where = tokens(t) if at else None
                seen.append([{"kind": k, "start": s, "end": e, "instance": instance(t[s:e]), "patterns": contexts(t, s, e, where)} for k, s, e in at])
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__key"), pa.array(base, pa.list_(pa.list_(pa.int32()))), pa.array(seen, pa.list_(kinds))], names=["__id", "__key", "base", "seen"])

    return rows.select("__id", "__key", "__text").mapInArrow(go, "__id long, __key string, base array<array<int>>, seen array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>>")


def bootstrap(seen: DataFrame, max_rounds: int = 100, min_support: int = 5, pattern_score: float = 0.9, instance_score: float = 0.9, known_share: float = 0.4) -> DataFrame:
    """``(instance, kind)`` of identifiers that no fixed pattern has, learned from the seeds.

    ``seen(kind, instance, patterns)``; kind -1 is unknown, -2 known to be no identifier.  In each round a
    pattern scores, for each kind, its instances of that kind over all that are known, refused ones among them.  It is trusted from ``min_support``
    instances of the kind and ``pattern_score`` on, if at least ``known_share`` of all that stands in it is known to be of the kind: what
    is not known yet counts for nothing in the score, but must not be the rule.  An unknown instance takes its best
    trusted pattern's score, and is accepted for the next round from
    ``instance_score`` on.  What is accepted keeps its kind and its best score, so
    rounds only add, and they end when one adds nothing.  The graph stays
    distributed: it is grouped by pattern after map-side sums, and joined by instance.
    """
    edges = durable(seen.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("kind").alias("kind")), "edges")
    known = edges.where("false").select("instance", "kind", F.lit(0.0).alias("score"))
    open_ = edges.where("kind = -1").select("instance", "pattern")
    before = 0
    for n in range(max_rounds):
        now = edges.where("kind <> -1").select("pattern", "kind", F.lit(1.0).alias("score")).unionByName(
            edges.where("kind = -1").drop("kind").join(known, "instance", "left").select("pattern", F.coalesce("kind", F.lit(-1)).alias("kind"), F.coalesce("score", F.lit(0.0)).alias("score"))
        )
        sums = now.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
        full = sums.groupBy("pattern").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("kind") != -1, F.col("n"))).alias("told"), F.max(F.when(F.col("kind") >= 0, F.struct("s", "kind", "n"))).alias("top"))
        trusted = full.where(f"top is not null and top.n >= {min_support} and top.s / told >= {pattern_score} and top.n >= {known_share} * all").select("pattern", "top.kind", (F.col("top.s") / F.col("told")).alias("p"))
        reached = open_.join(trusted, "pattern").groupBy("instance").agg(F.max(F.struct("p", F.col("kind"))).alias("best"))
        both = reached.where(f"best.p >= {instance_score}").select("instance", "best.kind", F.col("best.p").alias("score"), F.lit(1).alias("new")).unionByName(known.withColumn("new", F.lit(0)))
        known = durable(both.groupBy("instance").agg(F.min_by("kind", "new").alias("kind"), F.max("score").alias("score")), f"known{n}")
        count = known.count()
        if count == before:
            return known
        before = count
    raise RuntimeError("the bootstrap did not settle; raise max_rounds")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, counts by kind, and all spans; base_sha256 is over the base spans alone.

    The method adds the seeds of its own kind, secrets, which n_secrets counts, and what the bootstrap learned, which no fixed
    pattern names and n_learned counts; n_added is both.  has_pii says whether there is any span.
    A null or empty text has no spans.  Repeated rows have repeated results;
    rows that share an id but not the text are told apart by the text's MD5.
    An empty table gives no rows.
    """
    rows = packed(docs, __id=F.col(f"`{id_col}`").cast("long"), __text=text_of(text_col)).drop("__row").withColumn("__key", F.md5("__text"))
    found = durable(occurrences(rows), "spans")
    seen = found.select("__id", "__key", F.explode("seen").alias("o")).select("__id", "__key", "o.*")
    learned = bootstrap(seen.select("kind", "instance", "patterns"), **options)
    spanned = lambda df, new: df.select("__id", "__key", F.array(F.col("kind"), F.col("start"), F.col("end"), F.lit(new)).alias("span"))
    more = spanned(seen.where("kind = -1").drop("kind").join(learned.select("instance", "kind"), "instance"), 1).unionByName(spanned(seen.where(f"kind = {len(KINDS)}"), 0))
    extra = more.groupBy("__id", "__key").agg(F.array_sort(F.collect_set(F.expr("array(span[1], -span[2], span[0], span[3])"))).alias("more"))
    # by start, longest first: what lies inside an earlier span goes
    outer = "aggregate(more, array(array(-1, 0, -1, 0)), (a, x) -> if(x[1] >= element_at(a, -1)[1], a, concat(a, array(x))), a -> transform(slice(a, 2, size(a)), x -> array(x[2], x[0], -x[1], x[3])))"
    extra = extra.withColumn("more", F.expr(outer))
    a, b = found.select("__id", "__key", "base").alias("a"), extra.alias("b")
    met = a.join(b, F.col("a.__id").eqNullSafe(F.col("b.__id")) & (F.col("a.__key") == F.col("b.__key")), "left").select(F.col("a.__id").alias("doc_id"), "base", F.coalesce("more", F.array().cast("array<array<int>>")).alias("more"))
    name = F.create_map(*[F.lit(x) for k, n in enumerate(ALL_KINDS) for x in (k, n)])

    def told(c):
        return F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", F.element_at(name, s[0]), s[1].cast("string"), s[2].cast("string"))), ",")

    def number(k):
        return F.size(F.filter("base", lambda s: s[0] == k)).cast("long")

    counts = [number(k).alias(f"n_{n}") for k, n in enumerate(KINDS)]
    every = F.concat(F.array_distinct("base"), F.transform("more", lambda s: F.slice(s, 1, 3)))
    added, learnt = F.size("more").cast("long"), F.size(F.filter("more", lambda s: s[3] == 1)).cast("long")
    return met.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"), added.alias("n_added"), (added - learnt).alias("n_secrets"), learnt.alias("n_learned"), (F.size(every) > 0).alias("has_pii"))
