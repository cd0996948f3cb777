"""Periodic runs, conversation repair and chat formatting against brute force."""

import hashlib
import random
import re
import zlib
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import chat, chunks, periodic, registry, repair

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- periodic runs --------------------------------------------------------------------------------------


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def brute_runs(words, min_length=24, exponent=3):
    names = {}
    w = np.array([names.setdefault(x, len(names)) for x in words], np.int64)
    out = []
    for q in range(1, len(w) // exponent + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (w[q:] == w[:-q]).astype(int), [0]])))
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            length = int(e - s + q)
            if length >= max(min_length, exponent * q) and smallest_period(words[s : s + length]) == q:
                out.append((int(s), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_against_every_period():
    rng = random.Random(5)
    cases = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 300]
    for _ in range(250):
        words = [rng.choice("ab" if rng.random() < 0.4 else "abcdefgh") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 11, 15, 16, 17, 18, 19, 31, 33, 40]))]
            if rng.random() < 0.5:
                unit = unit + unit + [rng.choice("abc")]
            n = rng.randint(1, 5 * len(unit) + 20)
            words += (unit * (n // len(unit) + 1))[:n] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 3))]
        cases.append(words)
    # a period whose k-grams repeat inside it
    cases.append((list("ab" * 20) + ["x"] + list("ab" * 20) + ["y"]) * 4)
    for words in cases:
        names = {}
        w = np.array([names.setdefault(x, len(names)) for x in words], np.int64)
        assert periodic.runs_of(w) == brute_runs(words), words
        assert periodic.runs_of(w, 12, 4) == brute_runs(words, 12, 4), words


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def told_runs(doc_id, text):
    words = planted(doc_id, words_of(text))
    runs = brute_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    s, n, q = best or (None,) * 3
    return doc_id, len(runs), s, n, q, n and 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)), len(words)


def test_periodic_query(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(3)
    odd = [(None, "a " * 50), (5000, None), (5001, ""), (5002, " \n\t"), (5003, "é\xa0b " * 30), (5003, "é\xa0b " * 30), (5004, " ".join(rng.choice("ab") for _ in range(60_000)))]
    odd += [(6000 + i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 90)))) for i in range(120)]
    given = [tuple(r) for r in rows] + odd
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumns({"runs": F.lit(1), "n_words": F.lit("x"), "g": F.lit(2), "w": F.lit(3), "__text": F.lit(4)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op11_periodic_runs(spark, str(tmp_path)).collect()
    long_ = [r for r in got if r["doc_id"] == 5004]
    assert len(long_) == 1 and long_[0]["n_words"] == 60_000
    want = [told_runs(i, t) for i, t in given if i != 5004]
    assert sorted(map(str, (tuple(r) for r in got if r["doc_id"] != 5004))) == sorted(map(str, want))
    assert sum(w[1] for w in want) > 20
    empty = periodic.periodic_runs(docs.limit(0), doc_id="doc_id")
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, exponent=2)


def test_long_run_is_not_quadratic():
    w = np.zeros(1_000_000, np.int64)
    assert periodic.runs_of(w) == [(0, 1_000_000, 1)]
    assert [r for r in periodic.runs_of(np.arange(1_000_000) % 333_333)] == [(0, 1_000_000, 333_333)]


# --- conversation repair --------------------------------------------------------------------------------

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def brute_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired lines) of the rows of a conversation, in order."""
    seen, told = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        told.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {s: min([(3 * k, "I" * k) for k in range(4) if (lambda t: t in (0, 3))(_after(s, k))]) for s in range(4)}
    levels = [best]
    for (role, _), fault in zip(reversed(rows), reversed(told), strict=True):
        after, plain = levels[-1], {}
        for s in range(4):
            ways = [(4 + after[s][0], "D" + after[s][1])]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                to = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                if to and (to == 1 and s == 0 or to == 2 and s != 2 or to == 3 and s == 2):
                    ways.append((extra + after[to][0], "K" + after[to][1]))
                ways.append((3 + extra + after[NEXT[s]][0], "R" + after[NEXT[s]][1]))
            plain[s] = min(ways)
        for _ in range(4):
            plain = {s: min(plain[s], (3 + plain[NEXT[s]][0], "I" + plain[NEXT[s]][1])) for s in range(4)}
        levels.append(plain)
    cost, audit = levels[-1][0]
    lines, state, at = [], 0, 0
    for edit in audit:
        if edit in "KRD":
            role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        else:
            state = NEXT[state]
            role, text = ("", "", "user", "assistant")[state], "" if edit == "I" else text
        lines.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in pairwise(rows))
    return told.count("blank"), told.count("duplicate"), told.count("truncated"), illegal, cost, audit, lines


def _after(s, k):
    for _ in range(k):
        s = NEXT[s]
    return s


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        named = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
        role, text = named(role), named(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).digest()))


def told_repair(rows):
    want = {}
    left = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = in_order([r for r in left if r[0] == conv])
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        *numbers, lines = brute_repair([r[2:] for r in mine])
        want[conv] = (conv, gaps, *numbers, sha("\n".join(lines)))
    return want


@pytest.fixture(scope="module")
def conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(11)
    texts = ["Yes.", "No!", "why", "", " ", "ok?", "cut", "a.b", " ", "...", "end. \n\t"]
    for conv in range(1000, 1060):
        rows += [(conv, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "uu", ""]), rng.choice(texts) + rng.choice(["", str(t) + "."])) for t in range(rng.randint(1, 12))]
    rows += [(None, 1, "user", "Null conversation."), (None, None, None, None), (1500, None, "user", "a."), (1500, None, "assistant", "b."), (1501, 0, "user", None), (1502, 3, None, "x.")]
    rows += [(1503, 5, "user", "Same.")] * 4
    # one conversation that holds a third of the rows
    rows += [(1600, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(texts) + rng.choice(["", f"{t}.", f"{t}"])) for t in range(len(rows) // 2)]
    rows += [(1601, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(120)]
    rows += [(1602, t, "tool", f"{t}.") for t in range(60)]
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_repair(spark, conversations, chunk_rows):
    want = told_repair(conversations)
    df = spark.createDataFrame(conversations, CONV).withColumns({"key": F.lit(1), "audit": F.lit(2), "n": F.lit(3), "position": F.lit(0), "digest": F.lit("d")}).repartition(4)
    summary, repaired = repair.repair(repair.damage(df), chunk_rows=chunk_rows)
    digests = {r["key"]: r["sha256"] for r in repair.line_digests(repaired.select("key", F.concat("role", F.lit(":"), "text").alias("line"))).collect()}
    got = {r["key"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], digests.get(r["key"], sha(""))) for r in summary.collect()}
    name = lambda c: "n" if c is None else f"s{c}"
    assert got == {name(c): w[1:] for c, w in want.items() if name(c) in got}
    missing = [w for c, w in want.items() if name(c) not in got]
    assert all(w[1:] == (0, 0, 0, 0, 0, 0, "", sha("")) for w in missing)


def test_repair_query(spark, conversations, tmp_path):
    spark.createDataFrame(conversations, CONV).withColumn("cost", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, told_repair(conversations).values()))
    empty = spark.createDataFrame([], CONV)
    summary, repaired = repair.repair(empty)
    assert summary.count() == 0 and repaired.count() == 0


def test_chunks_start_from_guesses_and_are_mended():
    """Random symbols: a vector behind a chunk, right but for a constant, gives its cost and its trace."""
    rng, v = random.Random(2), repair.Viterbi()
    for _ in range(300):
        symbols = "".join(rng.choice("bdsuaoSUAO") for _ in range(rng.randint(1, 30)))
        cut = rng.randint(0, len(symbols))
        right, lift = v.back(symbols[cut:], repair.finish())
        shifted = tuple(x + 5 for x in right)
        out, more = v.back(symbols[:cut], right)
        whole, total = v.back(symbols, repair.finish())
        assert (out, lift + more) == (whole, total)
        assert v.back(symbols[:cut], shifted)[0] == out or cut == 0
        a, b = [], []
        v.back(symbols[:cut], right, a)
        v.back(symbols[cut:], repair.finish(), b)
        first, state = v.trace(symbols[:cut], a, 0, False)
        audit = first + v.trace(symbols[cut:], b, state, True)[0]
        c = []
        v.back(symbols, repair.finish(), c)
        assert audit == v.trace(symbols, c, 0, True)[0]


def test_entry_states(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for key in range(6):
        state, n = 0, rng.randint(1, 40)
        for chunk in range(n):
            exits = rng.sample(range(4), 4) if rng.random() < 0.9 else [rng.randrange(4)] * 4  # mostly maps that forget nothing
            want[f"s{key}", 100 * key + chunk] = state
            rows.append((f"s{key}", 100 * key + chunk, chunk == 0, chunk == n - 1, exits))
            state = exits[state]
    maps = spark.createDataFrame(rows, "key string, chunk long, first boolean, last boolean, exits array<int>")
    assert {(r["key"], r["chunk"]): r["entry"] for r in chunks.entry_states(maps).collect()} == want


# --- chat formatting ------------------------------------------------------------------------------------


def test_chat_query(spark, conversations, tmp_path):
    rng = random.Random(8)
    bits = ["<", "|", "<|", "\\", "\\|", "<\\|", "<|im_start|>", "<|im_end|>", "\n", "\\n", "assistant", "é", "😀", "im_end|>"]
    rows = conversations + [(2000 + i, t, rng.choice(["user", "assistant", "a\nb", "<|im_end|>\\"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for i in range(80) for t in range(5)]
    spark.createDataFrame(rows, CONV).withColumns({"segments": F.lit(1), "key": F.lit(2), "digest": F.lit(3), "conv": F.lit(4)}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in registry.op13_chat_format(spark, str(tmp_path)).collect()}
    rows = rows + registry.TRICKY
    assert set(got) == {r[0] for r in rows}
    follows = chat.Template().follows
    for conv in got:
        mine = [(r or "", t or "") for _, _, r, t in in_order([(c, n, r or "", t) for c, n, r, t in rows if c == conv])]
        loss = "".join(t for r, t in mine if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(mine), sha("".join(f"{r}\n{t}\n" for r, t in mine)), len(loss), sha(loss))
        state, faults = "start", []
        for i, (r, _) in enumerate(mine):
            if r not in follows.get(state, follows["start"]):
                faults.append(i)
            state = r
        assert (g["n_illegal"], g["first_illegal"], g["well_ended"]) == (len(faults), faults[0] if faults else None, state == "assistant"), conv
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], CONV))).count() == 0


def test_chat_machine_over_chunks(spark, conversations):
    formatted = chat.format_turns(spark.createDataFrame(conversations, CONV))
    told = lambda n: sorted(map(str, map(tuple, chat.validate_turns(formatted, chunk_rows=n).collect())))
    assert told(1) == told(4) == told(4096)


def test_chat_template(spark):
    with pytest.raises(ValueError):
        chat.Template(opening="[[turn", closing="[[end")  # the pair of characters must differ
    with pytest.raises(ValueError):
        chat.Template(opening="<|a|>", closing="</a>")
    t = chat.Template(opening="{%say ", closing="{%end%}", trained=("bot", "user"), follows={"start": ("user",), "user": ("bot",), "bot": ("user",)}, ends=("bot",))
    rows = [(1, 0, "user", "a{%end%}\n{%say bot\nb"), (1, 1, "bot", "{\\%"), (2, 0, "bot", "x")]
    formatted = chat.format_turns(spark.createDataFrame(rows, CONV), t)
    text = {r["conv"]: "" for r in formatted.collect()}
    for r in sorted(formatted.collect(), key=lambda r: r["turn"]):
        text[r["conv"]] += "".join(s["text"] for s in r["segments"])
    assert text[1].count("{%") == 4 and text[1].startswith("{%say user\n")
    got = {r["key"]: r for r in chat.read_back(formatted, t).collect()}
    assert got["s1"]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, _, r, x in rows[:2])) and got["s1"]["loss_chars"] == len(rows[0][3]) + 3
    ok = {r["key"]: (r["n_illegal"], r["well_ended"]) for r in chat.validate_turns(formatted, t).collect()}
    assert ok == {"s1": (0, True), "s2": (1, True)}
