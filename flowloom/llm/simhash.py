"""SimHash near-duplicate components by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, growing, packed, text_of

SEED, SHINGLE = 42, 3
STEP = 200_000


def fingerprint(text: str) -> int:
    """64-bit SimHash: words are split at ASCII white space after A-Z are lower-cased; a bit is set
    when over half of the 3-word shingles' XXH64 (repeats included) have it; no word, zero."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > SHINGLE:
        starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hash_of, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), STEP):
        h = np.array([hash_of(joined[s:e], SEED) for s, e in zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist())], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, md5, fp)`` of every whole text, fp as a signed long; null counts as empty."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("md5"), pa.array([fingerprint(t) for t in b.column("text").to_pylist()], pa.int64())], names=["id", "md5", "fp"])

    src = packed(docs, id=F.col(f"`{id_col}`").cast("long"), md5=F.md5(text_of(text_col)), text=text_of(text_col)).select("id", "md5", "text")
    return src.mapInArrow(go, "id long, md5 string, fp long")


LOW = 0xFFFFFFFF


def _half(fp, side):
    return F.when(side == 0, fp.bitwiseAND(F.lit(LOW))).otherwise(F.shiftrightunsigned(fp, 32))


def _even(x):
    return F.bit_count(x) % 2 == 0


def _flips(half, radius: int):
    """The half with every choice of exactly ``radius`` bits flipped."""
    masks = [1 << i for i in range(32)] if radius == 1 else [(1 << i) | (1 << j) for i in range(32) for j in range(i)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: half.bitwiseXOR(m))


def near_links(nodes: DataFrame, small: int = 32) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints ``nodes(fp)`` within 3 differing bits.

    Of two such fingerprints, one half differs in at most one bit: half the
    radius.  So each fingerprint emits for each half the variants within that
    ball: itself, and, from the even one of a pair that differs in one bit (the
    other is odd), the 32 one-bit flips.  Variants shuffle and meet.

    Where few fingerprints have the variant as their exact half, each that meets
    them is verified against those few.  Where many do, the other half meets in the middle in turn: those on
    the exact half are centres and emit its one-bit ball, the rest and (for
    three bits in this half) the even ones' two-bit sphere are points; whatever
    meets a centre there differs from it in three bits at most, so a link to the
    smallest centre is enough and no group is ever expanded into its pairs.
    """
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    halves = nodes.select("fp", side).withColumn("own", _half(F.col("fp"), F.col("side")))
    exact = halves.select("side", F.col("own").alias("v"), "fp", F.lit(True).alias("exact"))
    flipped = halves.where(_even(F.col("own"))).select("side", F.explode(_flips(F.col("own"), 1)).alias("v"), "fp", F.lit(False).alias("exact"))
    emitted = exact.unionByName(flipped)
    crowd = emitted.groupBy("side", "v").agg(F.count("*").alias("n"), F.count_if("exact").alias("n0")).where("n > 1 and n0 > 0")
    met = durable(emitted.join(growing(crowd.drop("n")), ["side", "v"]), "met")

    few = met.where(F.col("n0") <= small)
    a, b = few.where("exact").select("side", "v", F.col("fp").alias("a")), few.select("side", "v", F.col("fp").alias("b"), "exact")
    direct = a.join(growing(b), ["side", "v"]).where("a <> b and (not exact or a < b)").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3).select("a", "b")

    many = met.where(F.col("n0") > small).withColumn("rest", _half(F.col("fp"), 1 - F.col("side")))
    one = many.select("side", "v", "fp", "exact", F.explode(F.concat(F.array("rest"), _flips(F.col("rest"), 1))).alias("w"))
    two = many.where("exact").where(_even(F.col("rest"))).select("side", "v", "fp", F.lit(False).alias("exact"), F.explode(_flips(F.col("rest"), 2)).alias("w"))
    points = one.unionByName(two)
    centre = points.where("exact").groupBy("side", "v", "w").agg(F.min("fp").alias("a"))
    starred = points.select("side", "v", "w", F.col("fp").alias("b")).join(growing(centre), ["side", "v", "w"]).where("a <> b").select("a", "b")
    return direct.unionByName(starred).distinct()


def labelled(docs: DataFrame, id_col: str, text_col: str, small: int) -> DataFrame:
    """``(id, md5, fp, root, component_id)`` of every row; the root is the component's smallest fingerprint."""
    prints = durable(fingerprints(docs, id_col, text_col), "prints")
    nodes = durable(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = components(near_links(nodes.select("fp"), small))
    named = nodes.join(growing(roots), nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    label = durable(named.join(growing(lowest), "root").select("fp", "root", "component_id"), "labels")
    return prints.join(growing(label), "fp").select("id", "md5", "fp", "root", "component_id")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = 32) -> DataFrame:
    """``(id, fp, component_id)`` of every row: fingerprints within 3 bits are linked, and the
    component's name is the smallest id that can be reached.

    Equal fingerprints are one node, so a group of copies costs one row after a
    map-side minimum.  A null or empty text has fingerprint zero and is linked
    like any other; null ids are never a component's name unless it has no
    other; repeated rows stay repeated; an empty table gives no rows.
    """
    return labelled(docs, id_col, text_col, small).select("id", "fp", "component_id")


def hex_print(fp):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component, the one with the smallest id; same columns.

    Of rows that share that id, the one with the smallest digest of its text
    stays, and of rows equal in both exactly one.
    """
    found = labelled(docs, id_col, text_col, 32)
    keep = durable(found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "md5")).alias("k")).select(F.col("k.id").alias("__keep"), F.col("k.md5").alias("__of")), "kept")
    rows = packed(docs, __id=F.col(f"`{id_col}`").cast("long"), __md5=F.md5(text_of(text_col)))
    kept = rows.join(keep, F.expr("__id <=> __keep and __md5 = __of"), "left_semi")
    return kept.withColumn("__n", F.expr("row_number() over (partition by __id, __md5 order by __md5)")).where("__n = 1").select("__row.*")
