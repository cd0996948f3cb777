"""The corpus operators against brute force, on small fixtures with every odd row."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowloom.llm import bpe, common, exact_dedup, licenses, mixing, pii, quality, registry, simhash, suffixes, token_histogram, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(30)]
    near = texts[0].split()
    texts += [None, "", " ", "\n\n", "a", "A B", "Licensed under the APACHE\nLicense. cc  by-nc 4.0", words(rng, 30_000)]
    texts += [texts[0]] * 25 + [" ".join(near[:-1] + [w]) for w in ("x", "y", "z")]
    out = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return out + [(None, texts[1], "en", "src0", 1), (None, None, None, None, None), out[3], out[3], (3, "another text", None, "src1", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # more columns, with the names that the operators use
    return spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit("mine"), "id": F.lit(1), "text_sha256": F.lit(None).cast("int"), "slot": F.lit("s"), "fp": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.exact_dedup(docs, memtable_rows=5).select("__row.doc_id", "__row.text", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    stays = {}
    for r in got:
        ids = groups[r["text"] or ""]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        stays[r["text"] or ""] = stays.get(r["text"] or "", 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(stays.values()) == {1}
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    # digests that clash are split by their bytes; a filter that must not be sent lets every row through
    for more in ({"digest": lambda t: F.sha2(F.substring(t, 1, 1), 256)}, {"filter_bytes": 0}):
        other = exact_dedup.exact_dedup(docs, memtable_rows=5, **more).select("__row.doc_id", "__row.text", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(str, other)) == sorted(map(str, got))


def test_merge_index(spark, monkeypatch):
    rng = random.Random(9)
    given = [(rng.randint(0, 40), rng.choice([None, 1, 2, 3, 4, 5])) for _ in range(700)]
    rows = spark.createDataFrame(given, "x int, id long").select(F.unhex(F.sha2(F.col("x").cast("string"), 256)).alias("digest"), "id", "x").repartition(5)
    index = exact_dedup.merge_index(rows.select("digest", "id"), memtable_rows=30)
    want = {}
    for x, i in given:
        want.setdefault(hashlib.sha256(str(x).encode()).digest(), []).append(i)
    ranks = {d: max((i for i in ids if i is not None), default=None) for d, ids in want.items()}
    got = {bytes(r["digest"]): (r["high"], r["n"], r["ties"]) for r in index.where("n > 0").collect()}
    assert got == {d: (ranks[d], len(ids), ids.count(ranks[d])) for d, ids in want.items()}
    test = exact_dedup.may_repeat(index)
    once = spark.range(5000).select(F.unhex(F.sha2(F.concat(F.lit("z"), F.col("id").cast("string")), 256)).alias("digest"))
    assert {bytes(r[0]) for r in rows.where(~test(F.col("digest"))).select("digest").collect()} <= {d for d, ids in want.items() if len(ids) == 1}
    assert once.where(test(F.col("digest"))).count() < 500
    # the index decides: with a wrong one the result is wrong
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    real = exact_dedup.merge_index
    monkeypatch.setattr(exact_dedup, "merge_index", lambda *a: real(*a).withColumn("high", F.col("high") - 1).withColumn("n", F.col("n") * 2))
    got = {tuple(r) for r in exact_dedup.exact_dedup(docs).select("__row.doc_id", "keep_id", "group_size", "kept").collect()}
    assert {(1, 1, 4, True), (2, 1, 4, False)} <= got


def test_bpe(docs, rows, empty):
    import tiktoken

    path = registry.VOCABULARY
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()
    want = sorted(enc.encode_ordinary(r[1] or "") for r in rows)
    assert sorted(r["token_ids"] for r in got) == want
    assert all(r["n_tokens"] == len(r["token_ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["token_ids"])).encode()).hexdigest() for r in got)
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0
    one = bpe.ByteBpe(bpe.read_ranks(path), public_tokenizers.PATTERN)
    for t in ("", "<|endoftext|> naïve\t\r\n  x", "日本語 \U0001f600\u200d 12345 don't", "\x00\x7f\u2028", "ſ" * 500):
        assert one.encode(t) == enc.encode_ordinary(t) and one.decode(one.encode(t)) == t.encode()


def test_bpe_on_documents(spark):
    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(registry.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect()}
    for r in registry.op6_byte_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def brute_components(prints):
    """prints: list of fingerprints; root index of each by breadth-first search."""
    left, group = set(range(len(prints))), {}
    while left:
        start = left.pop()
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in [y for y in left if (prints[x] ^ prints[y]).bit_count() <= 3]:
                left.discard(y)
                seen.add(y)
                todo.append(y)
        for x in seen:
            group[x] = frozenset(seen)
    return group


def slow_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_of_documents(docs, rows, empty):
    got = simhash.near_components(docs).collect()
    assert len(got) == len(rows)
    prints = [slow_fingerprint(r[1]) for r in rows]
    group = brute_components(prints)
    want = sorted((-1 if r[0] is None else r[0], p - (p >> 63 << 64), min((rows[j][0] for j in group[i] if rows[j][0] is not None))) for i, (r, p) in enumerate(zip(rows, prints)))
    assert sorted((-1 if r["id"] is None else r["id"], r["fp"], r["component_id"]) for r in got) == want
    assert simhash.near_components(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group.values()))


@pytest.mark.parametrize("small", [1, 4, 32])
def test_simhash_links(spark, small):
    rng = random.Random(small)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            prints.add(p)
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 3, 3, 4])):
                p ^= 1 << b
    prints = sorted(x - (x >> 63 << 64) for x in prints)
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.near_links(nodes, small).collect()
    mask = (1 << 64) - 1
    assert all(((r["a"] ^ r["b"]) & mask).bit_count() <= 3 for r in links)
    roots = {r["node"]: r["root"] for r in common.components(simhash.near_links(nodes, small)).collect()}
    group = brute_components([p & mask for p in prints])
    for i, p in enumerate(prints):
        assert roots.get(p, p) == min(prints[j] for j in group[i])


def test_simhash_broadcasts_nothing_that_grows(spark, docs, monkeypatch):
    """Spark sizes exploded variants and compressed files too low: no join of simhash may leave it the choice."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (simhash, common):
        monkeypatch.setattr(module, "durable", lambda df, what, write=module.durable: (plans.append(plan(df)), write(df, what))[1])
    found = simhash.near_components(docs)
    assert found.count() > 0
    plans.append(plan(found))
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not [p for p in plans if "Broadcast" in p]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (5, 5)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for x in parent}
    assert got == {x: r for x, r in want.items() if x != r}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc(spark, tmp_path):
    rng = random.Random(1)
    bodies = [None, "", "<p>é</p>", "<p>é</p>", words(rng, 4000)] + [words(rng, 50) for _ in range(40)] + ["same"] * 20
    rows = [(i, None if i % 5 == 0 else f"http://x/é {i}", b) for i, b in enumerate(bodies)] + [(3, "http://x", "<p>é</p>"), (None, "u", "same"), (None, None, "alone"), (2, "twice", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    archives = warc.write_archives(pages, archive_bytes=4000, sample_bytes=2000, dictionary_bytes=1024)
    got = warc.read_archives(archives).collect()
    assert archives.count() > 3 and len(got) == len(rows)
    first = {}
    for i, _, b in rows:
        if i is not None:
            first[b or ""] = min(i, first.get(b or "", i))
    want = []
    for i, u, b in rows:
        low = first.get(b or "")
        revisit = low is not None and i != low
        raw = (b or "").encode()
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", str(low if revisit else None), None if revisit else raw))
    assert sorted(map(str, want)) == sorted(str((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]), None if r["payload"] is None else bytes(r["payload"]))) for r in got)
    none = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_warc_damage(tmp_path):
    w = warc.ArchiveWriter(f"file://{tmp_path}")
    for i in range(30):
        w.add(warc.record_bytes(i, "u", b"x" * i, warc.digest_of(b"x" * i), None))
    ((path, n, size),) = w.close()
    raw = open(path.removeprefix("file://"), "rb").read()
    assert n == 30 and size == len(raw) and raw[:4] == b"\x5d\x2a\x4d\x18" and len(list(warc.read_archive(path))) == 30
    (tmp_path / "cut").write_bytes(raw[:-3])
    with pytest.raises(ValueError):
        list(warc.read_archive(f"file://{tmp_path}/cut"))


def test_histogram(spark, docs, rows, empty):
    lengths = [0, 0, 3, 3, 3, 5000, 5001, 9]
    hist = token_histogram.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    for r in hist.collect():
        n = r["n_tokens"]
        assert r["docs"] == lengths.count(n) and r["docs_over"] == sum(x > n for x in lengths) and r["docs_at_most"] == sum(x <= n for x in lengths)
        assert r["tokens_over"] == sum(x for x in lengths if x > n) and r["tokens_at_most"] == sum(x for x in lengths if x <= n)
        assert r["tokens_kept"] == sum(min(x, n) for x in lengths) and r["share_at_most"] == r["docs_at_most"] / len(lengths)
    for r in token_histogram.at_limits(hist, [0, 1, 3, 4000, 10_000]).collect():
        assert (r["docs_over"], r["tokens_kept"]) == (sum(x > r["limit"] for x in lengths), sum(min(x, r["limit"]) for x in lengths))
    assert [r["n_tokens"] for r in token_histogram.quantiles(hist, [0.1, 0.5, 1.0]).orderBy("share").collect()] == [0, 3, 5001]
    got = token_histogram.token_lengths(docs, registry.VOCABULARY, public_tokenizers.PATTERN)
    one = bpe.ByteBpe(bpe.read_ranks(registry.VOCABULARY), public_tokenizers.PATTERN)
    assert sorted(r[0] for r in got.collect()) == sorted(len(one.encode(r[1] or "")) for r in rows)
    assert token_histogram.length_histogram(token_histogram.token_lengths(empty, registry.VOCABULARY, public_tokenizers.PATTERN)).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, mixing.root_weights(docs, resolution=40, per_source=1), block_rows=2).select("__row.*", F.col("slot").alias("at"), "block", "place").collect()
    assert len(got) == len(rows) and mixing.mix(empty).count() == 0
    assert len({(r["at"], r["place"]) for r in got}) == len(rows)
    mixed = mixing.in_mixed_order(docs, block_rows=2)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)


@pytest.mark.parametrize("weights", [None, {"hot": 5000, "s0": 1234, "s1": 7, "s2": 333, "gone": 50, "s4": 0}, {"hot": 2000, None: 3000, **{f"s{k}": 1000 for k in range(11)}}])
def test_mixing_deviation(spark, weights):
    """Less than one block from the exact target share, whatever the weights."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 11) end").alias("source"))
    given = None if weights is None else spark.createDataFrame(list(weights.items()), "source string, weight long")
    p = {r["source"]: r["weight"] for r in (mixing.root_weights(docs) if given is None else given).collect()}
    got = mixing.mix(docs, given, block_rows=1).select("__row.source", "slot").collect()
    last = {}
    for r in got:
        last[r["source"]] = max(r["slot"], last.get(r["source"], 0))
    share = {s: max(1, p.get(s, 1)) for s in last}
    total, seen = sum(share.values()), dict.fromkeys(share, 0)
    order = {r["slot"]: r["source"] for r in got}
    end = min(last.values())
    assert len(order) == 3000 and end > 50 and set(range(end + 1)) <= set(order)
    for t in range(end):
        seen[order[t]] += 1
        assert all(abs(seen[s] * total - (t + 1) * share[s]) < total for s in share)
    with pytest.raises(ValueError):
        mixing.mix(docs, given, max_steps=10)


def slow_scan(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(licenses.WORD, low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        ws = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(ws)] == ws]
        places += at
        labels |= {label} if at else set()
    more, best = set(), 0.0
    for t, label, required in licenses.TEMPLATES:
        of, n = set(t.split()), -(-len(t.split()) * 5 // 4)
        for i in range(len(w)):
            block = set(w[i : i + n])
            share = len(block & of) / len(of)
            if share >= 0.8 - 1e-12 and set(required.split()) <= block:
                more.add(label)
                best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if labels else best)


def test_licenses(spark, docs, rows, empty):
    extra = ["cc by cc by", "GNU  general-public LICENSE", "MIT license mit", licenses.TEMPLATES[6][0].upper() + "\nx", "redistribution and use in source and binary forms with or without", "gnu general public\nlicense"]
    wrapped = licenses.TEMPLATES[7][0].split()
    extra += ["\n".join(" ".join(wrapped[i : i + 6]) for i in range(0, len(wrapped), 6)), "licensed under cc by 4.0", "licensed under cc by-nc 4.0", "released under the gpl license", words(random.Random(6), 200) + " " + licenses.TEMPLATES[2][0]]
    rng = random.Random(5)
    for t, _, _ in licenses.TEMPLATES:
        w = t.split()
        for cut in (0.7, 0.8, 0.9, 1.0):
            extra.append(" ".join(rng.sample(w, round(cut * len(w))) + words(rng, 5).split()) + "\n" + words(rng, 20))
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    given = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(extra)]
    got = licenses.license_scan(docs.select("doc_id", "text").union(more)).collect()
    want, found = sorted(map(str, [(i, *slow_scan(t)) for i, t in given])), sorted(str(tuple(r)) for r in got)
    assert [(a, b) for a, b in zip(want, found) if a != b] == []
    assert licenses.license_scan(empty).count() == 0
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert [labels[1000 + i] for i in range(6, 11)] == ["bsd", "cc-by", "cc-by,cc-by-nc", "", "lgpl"]


def slow_spans(text):
    text = text or ""
    out = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = "".join(c for c in m[0] if c in "0123456789")
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base():
    rng = random.Random(11)
    for _ in range(3000):
        t = "".join(rng.choice("aZ0199..@@+--  ()é_%") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == slow_spans(t), t
    for t in ("4111 1111 1111 1111", "a@b.c._x@y.z", "1.2.3.4.5.6.7.8", "0001.2.3.4 256.1.1.1", "+1 (456) 555-2186", "x" * 50_000 + "@a.b", "1" * 50_000):
        assert pii.base_spans(t) == slow_spans(t)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii(spark, docs, rows, empty):
    ids = [f"call desk {n} now +1 (456) 555-{1000 + n} or so" for n in range(12)] + ["call desk 7 now (456) 555-9999 or so"] * 2
    lines = [(2000 + n, f"the user mail is u{n}@mail.example.com today") for n in range(20)] + [(3000, "the user mail is u77@localhost today"), (3001, "the value is 1234567 today")]
    lines += [(4000 + n, t) for n, t in enumerate(ids)]
    more = spark.createDataFrame(lines, "doc_id long, text string")
    got = pii.find_pii(docs.select("doc_id", "text").union(more)).collect()
    given = [(r[0], r[1]) for r in rows] + lines
    want = []
    for i, t in given:
        s = slow_spans(t)
        want.append((i, *[sum(x[0] == k for x in s) for k in range(4)], hashlib.sha256(pii.spans_text(s).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in got)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[2003] == "email:17:36" and spans[3001] == ""
    assert all(set(pii.spans_text(slow_spans(t)).split(",")) - {""} <= set(spans[i].split(",")) for i, t in lines)
    assert pii.find_pii(empty).count() == 0


def test_pii_bootstrap(spark):
    seen = [(0, f"a{n}@x.y", ["l1|mail"]) for n in range(19)] + [(-1, "b@local", ["l1|mail"]), (-1, "zz", ["l1|other"])] + [(2, f"{n}", ["l1|card", "l1|other"]) for n in range(3)]
    got = pii.bootstrap(spark.createDataFrame(seen, "kind int, instance string, patterns array<string>"))
    assert [(r["instance"], r["kind"]) for r in got.collect()] == [("b@local", 0)]


def test_pii_unseen(spark):
    """What looks like no base match is found by its context, in as many rounds as it takes."""
    lines = [f"call desk {n} now +1 (456) 555-{1000 + n} or so" for n in range(12)] + [f"the user mail is u{n}@mail.example.com today" for n in range(20)]
    lines += ["call desk 7 now (456) 555-9999 or so"] * 2 + ["the user mail is u77@localhost today", "the value is 1234567 today"]
    lines += [f"ring room 5 {'+1 ' if n else ''}(456) 556-{1000 + n} soon" for n in range(12)]  # after a number
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert [got[n] for n in range(32, 37)] == ["phone:16:30", "phone:16:30", "email:17:30", "", "phone:12:26"]
    secret = [f'word{n} token = "{hashlib.sha1(str(n).encode()).hexdigest()}" more' for n in range(9)] + ['a token = "x1234567" b', 'password: Hunter2Hunter2Hunter2.', "token = 1234567890123456789 x", "a key = 12 and token"]
    secret += [f"{'w' * 70} {'x' * 50}: {n}@mail.example.com z" for n in range(9)] + [f"{'w' * 70} {'x' * 50}: 9@localhost z"]  # long words
    found = {r["doc_id"]: (r["spans"], r["n_added"], r["has_pii"]) for r in pii.find_pii(spark.createDataFrame(list(enumerate(secret)), "doc_id long, text string")).collect()}
    assert [found[n] for n in (0, 9, 10, 12)] == [("secret:15:55", 1, True), ("secret:11:19", 1, True), ("secret:10:31", 1, True), ("", 0, False)]
    assert "secret" not in found[11][0] and found[22] == ("email:123:134", 1, True) and found[21][1:] == (0, True)
    # each pattern is trusted only after the one before it has had its unknown ones accepted
    chain = [(3, f"seed{n}", ["p0"]) for n in range(30)]
    for k in range(6):
        chain += [(-1, f"x{k}-{n}", [f"p{k}", f"p{k + 1}"]) for n in range(30)] + [(3, f"s{k}-{n}", [f"p{k + 1}"]) for n in range(10)]
    found = pii.bootstrap(spark.createDataFrame(chain, "kind int, instance string, patterns array<string>")).collect()
    assert {r["instance"] for r in found} == {f"x{k}-{n}" for k in range(6) for n in range(30)}
    with pytest.raises(RuntimeError):
        pii.bootstrap(spark.createDataFrame(chain, "kind int, instance string, patterns array<string>"), max_rounds=3)


@pytest.mark.parametrize("share", [0.1, 0.25, 0.5])
def test_pii_learns(spark, share):
    """Forms that no fixed pattern has, as a share of a wording, are found; what stands in other wordings, or is known to be none, is not."""
    n = round(40 * share / (1 - share))
    wordings = {
        "phone": ("my number is", [f"+1 (456) 555-{1000 + i}" for i in range(40)], [f"(456) 555-{2000 + i}" for i in range(n)]),
        "email": ("write to", [f"user{i}@mail.example.com" for i in range(40)], [f"user{i}@localhost" for i in range(n)]),
        "ring": ("ring me at", [f"+44 456 555 {1000 + i}" for i in range(40)], [f"0456 555 {2000 + i}" for i in range(n)]),
        "card": ("paid with", [c for i in range(400) if pii.luhn(c := str(4111111111110000 + i))], []),
    }
    lines, planted = [], {}
    for kind, (before, seeds, unseen) in wordings.items():
        for x in seeds + unseen:
            planted[len(lines)] = f"{kind.replace('ring', 'phone')}:{len(before) + 7}:{len(before) + 7 + len(x)}"
            lines.append(f"hello {before} {x} thanks")
    clean = [f"order no {i}234567 shipped" for i in range(30)] + [f"on {y}-03-12 we met" for y in range(1990, 2020)] + [f"sum of 1,234,{i:03d} units" for i in range(30)] + [f"see room 55512{i:02d} there" for i in range(30)]
    clean += [f"hello paid with {4111111111110000 + i} thanks" for i in range(40) if not pii.luhn(str(4111111111110000 + i))] + [f"url?next_page_token=CAUQ{i:04d}aBcDeFgHiJkL1 x" for i in range(10)]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(lines + clean)), "doc_id long, text string")).collect()
    spans = {r["doc_id"]: r["spans"] for r in got}
    unseen = [i for i in planted if not slow_spans(lines[i])]
    hits = sum(spans[i] == planted[i] for i in unseen)
    false = sum(bool(spans[i]) for i in range(len(lines), len(lines) + len(clean)))
    assert hits >= 0.9 * len(unseen) and false <= 0.1 * hits, (hits, len(unseen), false, [lines[i] for i in unseen if spans[i] != planted[i]][:4], [(clean[i - len(lines)], spans[i]) for i in spans if i >= len(lines) and spans[i]][:4])
    assert all(r["n_learned"] == (r["doc_id"] in unseen) for r in got if r["doc_id"] < len(lines) and spans[r["doc_id"]] == planted[r["doc_id"]])
    assert sum(r["n_secrets"] for r in got) == 0


def test_pii_candidates():
    t = "a 7 (456) 555-9999 b +12 34567 x123456y 4465758382889437 4465758382889437 [u@h], " + "9" * 70
    assert [t[a:b] for a, b in pii.candidates(t, [])] == ["7 (456) 555-9999", "(456) 555-9999", "555-9999", "+12 34567", "x123456y", "4465758382889437", "4465758382889437", "u@h", "9" * 70]
    assert pii.candidates("1234567 10.0.0.1 x", [(1, 8, 16)]) == [(0, 7)]


def slow_repeats(texts, n):
    """Covered word positions by whole windows that stand at two places or more."""
    where = {}
    ws = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for d, w in enumerate(ws):
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((d, i))
    out = []
    for d, w in enumerate(ws):
        starts = sorted(i for at in where.values() if len(at) > 1 for e, i in at if e == d)
        spans = []
        for i in starts:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + n
            else:
                spans.append([i, i + n])
        out += [(d, a, b) for a, b in spans]
    return sorted(out)


@pytest.mark.parametrize(("n", "k"), [(50, 16), (12, 5), (8, 8)])
def test_repeated_spans(spark, n, k):
    rng = random.Random(n)
    shared = [words(rng, m).split() for m in (n - 1, n, n + 1, 2 * n, 5 * n, 300)]
    texts = [None, "", "a b", "w " * 200]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, max(0, len(s) // 3))
            parts += words(rng, rng.randint(0, 80)).split() + s[a:] if rng.random() < 0.6 else words(rng, 30).split()
        texts.append("\n".join(parts))
    texts += [texts[5]] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.repeated_spans(docs, min_words=n, k=k)
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got.collect()) == slow_repeats(texts, n)


def test_repeated_spans_odd_rows(docs, rows, empty):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted((-1 if rows[d][0] is None else rows[d][0], a, b) for d, a, b in slow_repeats([r[1] for r in rows], 20))
    got = suffixes.repeated_spans(docs, min_words=20, k=6).collect()
    assert sorted(key(r[:3]) for r in got) == want and len(want) > 25
    assert all(r["span_chars"] >= 39 for r in got)
    assert suffixes.repeated_spans(empty).count() == 0
    assert suffixes.drop_repeats(docs).columns == docs.columns and suffixes.drop_repeats(docs).count() == len(rows) and suffixes.drop_repeats(empty).count() == 0


def test_drop_repeats(spark):
    rng, n = random.Random(4), 8
    shared = [words(rng, m).split() for m in (n, 2 * n, 40)]
    texts = [None, "", "a b"]
    for _ in range(40):
        s = rng.choice(shared)
        texts.append(" ".join(words(rng, rng.randint(0, 30)).split() + s[rng.randint(0, 3) :] + words(rng, rng.randint(0, 12)).split()) + "\n")
    texts += [texts[5]] * 4
    where, ws = {}, [(t or "").split() for t in texts]
    for d, w in enumerate(ws):
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((d, i))
    gone, stay = set(), set()
    for (d, i), *more in where.values():
        if more:
            stay |= {(d, i + k) for k in range(n)}
            gone |= {(e, j + k) for e, j in more for k in range(n)}
    docs = spark.createDataFrame([(d, t, d) for d, t in enumerate(texts)], "doc_id long, text string, starts int").repartition(3)
    got = {r["doc_id"]: r["text"] for r in suffixes.drop_repeats(docs, min_words=n, k=3).collect()}
    assert got[0] is None and got[1] == ""
    for d, w in enumerate(ws):
        assert (got[d] or "").split() == [x for i, x in enumerate(w) if (d, i) not in gone - stay], d
    assert sum(len((x or "").split()) for x in got.values()) < sum(map(len, ws))


def slow_facts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(three)
    inside = {i + k for i, x in enumerate(three) if times[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n)


def test_quality_facts(spark, docs, rows):
    rng = random.Random(2)
    texts = [r[1] for r in rows if len(r[1] or "") < 5000] + [" ".join(rng.choice("ab#é") for _ in range(n)) + "\nx\n x\nx\u00a0\nx" for n in range(60)]
    small = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("kept", F.lit("c"))
    for r in quality.score(small, None).select("__row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability").collect():
        assert tuple(r)[1:7] == slow_facts(r["text"]) and r["kept"] == (not r["base_failed"]) and r["probability"] is None


def test_quality_features():
    mask, mix, base = (1 << 64) - 1, int(quality.MIX), int(quality.BASE)
    for text in ("", "é", "aé日\U0001f600 aé日\U0001f600 b", "x y x y x"):
        spelt = quality.word_hashes(quality._bytes(text))[2].tolist()
        kinds = {1: spelt, 2: [(a * base + b) & mask for a, b in zip(spelt, spelt[1:])]}
        for n in (2, 3, 4):
            kinds[2 + n] = [sum((ord(c) + 1) * mix * base ** (n - 1 - k) for k, c in enumerate(text[i : i + n])) & mask for i in range(len(text) - n + 1)]
        want = []
        for kind, hashes in kinds.items():
            slots = pd.Series([((h + kind) * mix & mask) >> 48 for h in hashes]).value_counts().sort_index()
            want += [(at, (n / slots.sum()) ** 0.5) for at, n in slots.items()]
        at, v = quality.features(text, np.array(spelt, dtype=np.uint64))
        assert [a for a, _ in want] == at.tolist() and np.allclose([x for _, x in want], v)


def test_quality_bound(spark):
    docs = spark.createDataFrame([(i, "good words " * 30 if i % 2 else "bad terms " * 30) for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    few = quality.train(docs, labels, max_bytes=2)  # one row of each kind
    assert few is not None and quality.train(docs, labels, per_class=1) is not None
    assert np.array_equal(few.weights, quality.train(docs, labels, per_class=1).weights) and not np.array_equal(few.weights, quality.train(docs, labels).weights)


def test_platt():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * x - 0.7)))).astype(float)
    a, b = quality.platt(x, y)
    assert abs(a - 1.5) < 0.15 and abs(b + 0.7) < 0.15
    a, b = quality.platt(np.array([-9.0, -8.0, 9.0, 11.0, 12.0, 14.0]), np.array([0, 0, 1, 1, 1, 1.0]))
    assert 0 < a < 1 and abs(b) < 5


def test_quality_model(spark, empty):
    larger = SF.replace("sf0.001", "sf0.01")  # about 200 labelled rows on either side
    docs, labels = common.table(spark, larger, "documents"), common.table(spark, larger, "labels")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = quality.train(docs, train)
    got = quality.score(docs, model).select("__row.doc_id", "probability", "base_failed", "kept").join(held, "doc_id").toPandas()
    assert ((got["probability"] >= 0.5) == (got["quality"] == 1)).mean() > 0.9
    assert quality.train(docs, labels.where("quality = 1")) is None and quality.train(docs, labels.limit(0)) is None and quality.train(empty, labels) is None
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)], labels.schema))
    assert quality.train(docs, odd) is not None
    blank = spark.createDataFrame([(i, None) for i in range(20)], "doc_id long, text string")
    assert quality.score(blank, quality.train(blank, blank.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))).where("kept").count() == 0
    assert quality.keep_quality(empty, labels).count() == 0


def test_pipeline(spark, empty):
    import corpus_pipeline as p

    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ok = {r["doc_id"] for r in quality.score(docs, quality.train(docs, labels)).where("kept").select("__row.doc_id").collect()}
    last = {}
    for i in ok:
        last[texts[i]] = max(i, last.get(texts[i], i))
    ids = sorted(last.values())
    group = brute_components([slow_fingerprint(texts[i]) for i in ids])
    want = {min(ids[j] for j in g) for g in set(group.values())}
    got = p.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    one = bpe.ByteBpe(bpe.read_ranks(registry.VOCABULARY), public_tokenizers.PATTERN)
    assert all(r["token_ids"] == one.encode(texts[r["doc_id"]]) for r in got)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, empty, SF).columns == empty.columns and stage(spark, empty, SF).count() == 0
    assert p.STAGES[-1][1](spark, empty, SF).count() == 0


def test_pipeline_odd_rows(spark, docs, rows):
    """Each stage on nulls, ties, repeated rows, long texts and clashing columns."""
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    texts = [(r[0], r[1] or "") for r in rows]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")

    def run(name):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns
        return sorted(out.collect(), key=key)

    good = run("quality rules")
    assert 0 < len(good) < len(rows) and not any(slow_facts(r["text"])[-1] for r in good if len(r["text"]) < 5000) and all(r["kept"] == "mine" and r["slot"] == "s" for r in good)
    kept = {}
    for r in run("exact dedup"):
        assert kept.setdefault(r["text"] or "", r["doc_id"]) == r["doc_id"]
    assert set(kept) == {t for _, t in texts}
    assert all(i == max((j for j, t in texts if t == text and j is not None), default=None) for text, i in kept.items())
    prints = {i: slow_fingerprint(t) for i, (_, t) in enumerate(texts)}
    group = brute_components([prints[i] for i in range(len(texts))])
    lowest = sorted(min((texts[i][0] for i in g if texts[i][0] is not None), default=-1) for g in set(group.values()))
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in run("near dedup")) == lowest
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in run("mixing")) == sorted((str(i), t) for i, t in texts)
    one = bpe.ByteBpe(bpe.read_ranks(registry.VOCABULARY), public_tokenizers.PATTERN)
    coded = stages["encoding"](spark, docs, SF).collect()
    assert sorted(r["position"] for r in coded) == list(range(len(rows)))
    assert sorted((str(r["doc_id"]), r["token_ids"]) for r in coded) == sorted((str(i), one.encode(t)) for i, t in texts)


def test_stages_on_clashing_columns(spark, rows):
    """Columns named as the stages name theirs pass through, or are left alone by the last one."""
    import corpus_pipeline as p

    given = spark.createDataFrame(rows[:40], DOCS).withColumns({c: F.lit(c) for c in ("position", "slot", "place", "at", "block", "__start", "n", "tokens", "fingerprint")})
    for name, stage in p.STAGES:
        out = stage(spark, common.durable(given, "clash"), SF)
        if name != "encoding":
            assert out.columns == given.columns and {r["position"] for r in out.collect()} == {"position"}, name
        else:
            assert sorted(r["position"] for r in out.collect()) == list(range(40))


def test_schedule_in_parts(spark, monkeypatch):
    """Parts of the fold join without a seam, whatever their size; a period or schedule that is too long is an error, or is not broadcast."""
    shares = spark.createDataFrame([("sa", 7), ("sb", 40), ("sc", 101)], "__src string, p long")
    order = lambda: [r["__src"] for r in mixing.schedule(shares).orderBy("slot").collect()]
    whole = order()
    monkeypatch.setattr(mixing, "FOLD", 9)
    assert order() == whole and [whole.count(s) for s in ("sa", "sb", "sc")] == [7, 40, 101]
    docs = spark.createDataFrame([(i, "t", "en", "ab"[i % 2], 1) for i in range(60)], DOCS)
    weights = spark.createDataFrame([("a", 7), ("b", 13)], "source string, weight long")
    with pytest.raises(ValueError):
        mixing.mix(docs, weights, max_slots=19)
    rows = lambda **more: sorted(map(str, mixing.mix(docs, weights, **more).select("__row.doc_id", "slot", "place").collect()))
    assert rows(broadcast_bytes=0) == rows()


def test_queries_without_sql(spark):
    """The registered queries that SQL can't express, against brute force on the whole table."""
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, SF, "documents").collect()}
    ids = sorted(docs)
    prints = [slow_fingerprint(docs[i]) for i in ids]
    group = brute_components(prints)
    assert sorted(tuple(r) for r in registry.op3_simhash(spark, SF).collect()) == [(i, f"{p:016x}", min(ids[j] for j in group[n])) for n, (i, p) in enumerate(zip(ids, prints))]
    one = bpe.ByteBpe(bpe.read_ranks(registry.VOCABULARY), public_tokenizers.PATTERN)
    lengths = [len(one.encode(docs[i])) for i in ids]
    hist = {r["n_tokens"]: (r["docs"], r["docs_over"], r["tokens_over"], r["tokens_kept"]) for r in registry.op4_token_histogram(spark, SF).collect()}
    assert hist == {n: (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n), sum(min(x, n) for x in lengths)) for n in set(lengths)}
    found = {r["doc_id"]: r for r in registry.op7_pii(spark, SF).collect()}
    assert sorted(found) == ids
    for i in ids:
        s = slow_spans(docs[i])
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in s) for k in range(4)] and found[i]["base_sha256"] == hashlib.sha256(pii.spans_text(s).encode()).hexdigest()
        assert set(filter(None, pii.spans_text(s).split(","))) <= set(filter(None, found[i]["spans"].split(",")))
    repeats = slow_repeats([docs[i] for i in ids], 50)
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in registry.op8_repeated_spans(spark, SF).collect()) == [(ids[d], a, b) for d, a, b in repeats]
    scored = {r["doc_id"]: r for r in registry.op9_quality_rules(spark, SF).collect()}
    for i in ids:
        assert tuple(scored[i])[1:7] == slow_facts(docs[i]) and not (scored[i]["kept"] and scored[i]["base_failed"])


def test_pipeline_order(spark):
    """The mixing order reaches the pipeline's result, whatever order the files are read in."""
    import corpus_pipeline as p

    rng = random.Random(3)
    n = {"a": 900, "b": 100, "c": 400}
    given = [(i, words(rng, rng.choice((1, 1, 60))), "en", s, 1) for i, s in enumerate(x for s, k in n.items() for x in [s] * k)]
    docs = spark.createDataFrame(given, DOCS)
    mixed = common.durable(p.STAGES[-2][1](spark, docs, SF), "mixed")
    got = {r["position"]: r["doc_id"] for r in p.STAGES[-1][1](spark, mixed, SF).collect()}
    want = mixing.mix(docs).select("__row.doc_id", "slot", "place").collect()
    assert [got[k] for k in range(len(given))] == [r["doc_id"] for r in sorted(want, key=lambda r: (r["slot"], r["place"]))]
    again = p.encode(spark, docs.where("source = 'b'"), SF).collect()  # not from files
    assert sorted(r["position"] for r in again) == list(range(100))
    total, seen = sum(k**0.5 for k in n.values()), dict.fromkeys(n, 0)
    for k in range(len(given)):
        seen[given[got[k]][3]] += 1
        if any(n[s] - seen[s] < 16 for s in n):
            break
        assert all(abs(seen[s] - (k + 1) * n[s] ** 0.5 / total) <= 17 for s in n), k  # a block, and the rounding of shares
    assert k > 300


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.ORACLE_SQL[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = registry.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
