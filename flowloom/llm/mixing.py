"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, packed


#: Slots that are folded into one array before it joins the others, so that no step copies all picks before it.
FOLD = 512


def _source(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n"))


def root_weights(docs: DataFrame, source_col: str = "source", power: float = 0.5, resolution: int = 1000, per_source: int = 50) -> DataFrame:
    """``(source, weight)``: whole target weights in proportion to each source's row count raised to ``power``.

    They add up to about ``resolution``, or ``per_source`` for each source where that is more, so
    that many sources don't all end at the least weight, one.
    """
    counted = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("w"))
    every = Window.partitionBy(F.lit(0))  # a row for each source
    slots = F.greatest(F.lit(resolution), F.count("*").over(every) * per_source)
    return counted.select("source", F.greatest(F.lit(1), F.round(F.col("w") / F.sum("w").over(every) * slots)).cast("long").alias("weight"))


def target_shares(rows: DataFrame, weights: DataFrame, max_steps: int, max_slots: int) -> DataFrame:
    """``(__src, p)``: the whole weight of each source of ``rows``, over their greatest common divisor.

    The sum of all p is the period of the schedule, which takes period times sources
    steps in one task; beyond ``max_steps``, or a period beyond ``max_slots``, that is an error, and the weights must be coarser.
    """
    target = weights.select(_source("source").alias("__src"), F.col("weight").cast("long").alias("p")).where("p >= 1").dropDuplicates(["__src"])
    shares = durable(rows.select("__src").distinct().join(target, "__src", "left").select("__src", F.coalesce("p", F.lit(1)).cast("long").alias("p")), "shares")
    sources, total, least = shares.agg(F.count("*"), F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.min("p"), F.lit(1))).first()
    common = math.gcd(least, *[r["p"] for r in shares.select("p").distinct().limit(least + 1).collect()]) if least > 1 else 1
    if sources * (total // common) > max_steps:
        raise ValueError(f"{sources} sources over a period of {total // common} slots are more than {max_steps} steps; give coarser weights")
    if total // common > max_slots:
        raise ValueError(f"a period of {total // common} slots is more than {max_slots}; give coarser weights")
    return shares.withColumn("p", F.expr(f"p div {common}"))


def schedule(shares: DataFrame) -> DataFrame:
    """``(__src, p, period, nth, slot)``: one period of the earliest-deadline-first schedule.

    The period is the sum of all p.  Block k of a source with p slots is released
    at ``k * period div p`` and due by ``ceil((k + 1) * period / p)``; each slot goes
    to the released block with the earliest deadline, the first source by name
    on a tie.  All shares add up to one, so every block meets its window and a
    source is never a whole block ahead of or behind its share.  The fold runs
    over one row that holds a number for each source, never over documents.
    """
    one = shares.agg(F.array_sort(F.collect_list(F.struct("__src", "p"))).alias("s")).select("s", F.expr("transform(s, x -> x.p)").alias("ps"), F.expr("aggregate(s, 0L, (a, x) -> a + x.p)").alias("period"))
    folded = one.where("period > 0").withColumn(
        "picks",
        F.expr(f"""
        aggregate(
          sequence(0L, (period - 1) div {FOLD}),
          named_struct('k', array_repeat(0L, size(ps)), 'parts', cast(array() as array<array<int>>)),
          (o, part) -> transform(
            array(aggregate(
              sequence(part * {FOLD}, least(period, (part + 1) * {FOLD}) - 1),
              named_struct('k', o.k, 'picks', cast(array() as array<int>)),
              (a, t) -> transform(
                array(array_min(transform(ps, (p, i) ->
                  if(a.k[i] * period div p <= t, named_struct('due', ((a.k[i] + 1) * period + p - 1) div p, 'i', i), null)))),
                best -> named_struct('k', transform(a.k, (k, i) -> if(i = best.i, k + 1, k)), 'picks', concat(a.picks, array(best.i))))[0])),
            x -> named_struct('k', x.k, 'parts', concat(o.parts, array(x.picks))))[0],
          o -> flatten(o.parts))"""),
    )
    slots = folded.select("s", "period", F.posexplode("picks").alias("slot", "i")).select(F.expr("s[i].__src").alias("__src"), F.expr("s[i].p").alias("p"), "period", F.col("slot").cast("long").alias("slot"))
    return slots.withColumn("nth", F.row_number().over(Window.partitionBy("__src").orderBy("slot")).cast("long") - 1)


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 16, max_steps: int = 20_000_000, max_slots: int = 1_000_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Every row of ``docs`` as struct ``__row`` with its block, slot and place in the slot.

    ``weights(source, weight)`` are the target weights, whole numbers of at least one; the
    share of a source is its weight over the sum of those of all sources that have rows,
    and is kept exactly, however many slots there are.  A source without such a weight has
    weight one.  None stands for :func:`root_weights`.

    Each source is cut into blocks of ``block_rows`` rows in the order of the MD5
    of the id; reading by (slot, place) keeps every source within one block of
    its target share for as long as no source has run out.  A source that has run
    out leaves its slots empty and the rest go on by the same deadlines.  Every
    row is there once: nothing is repeated or dropped.

    Rows are numbered within 4,096 parts of each source and the parts' counts
    are added up, so a source that holds a third of all rows is shared by many
    tasks.  A null source is a source of its own; a null id sorts as the text
    'null'; rows that tie in the id are in any order among themselves; an empty
    table gives no rows.  The schedule, a row a slot of the period, is broadcast if it is counted to take ``broadcast_bytes`` at most, names
    included; beyond that the joins shuffle.  A period of a million slots folds in about 40 seconds.
    """
    weights = root_weights(docs, source_col) if weights is None else weights
    rows = packed(docs, __id=id_col, __src=_source(source_col))
    rows = rows.withColumn("__h", F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("null")))).withColumn("__part", F.substring("__h", 1, 3))
    template = durable(schedule(target_shares(rows, weights, max_steps, max_slots)), "schedule")
    size = template.agg(F.sum(F.octet_length("__src") + 48)).first()[0] or 0
    sent = F.broadcast if size <= broadcast_bytes else (lambda df: df)
    before = Window.partitionBy("__src").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = durable(rows.groupBy("__src", "__part").agg(F.count("*").alias("__n")).select("__src", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "parts")
    shares = template.select("__src", "p", "period").distinct()
    within = Window.partitionBy("__src", "__part").orderBy("__h", "__id")
    ranked = (
        rows.withColumn("__nr", F.row_number().over(within).cast("long") - 1)
        .join(parts.join(sent(shares), "__src"), ["__src", "__part"])  # 4,096 rows a source
        .withColumn("__rank", F.col("__nr") + F.col("__before"))
        .withColumn("block", F.expr(f"__rank div {block_rows}"))
        .withColumn("place", F.col("__rank") % block_rows)
        .withColumn("nth", F.col("block") % F.col("p"))
    )
    placed = ranked.join(sent(template.select("__src", "nth", "slot")), ["__src", "nth"])
    return placed.select("__row", "block", (F.expr("block div p") * F.col("period") + F.col("slot")).alias("slot"), "place")


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of :func:`mix`, in range partitions; same rows, same columns."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mix(docs, **options).repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("__row.*")


def written_order(docs: DataFrame, name: str = "position", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with each row's number, from 0, in the order in which its files were written: by part, and by row in a part.

    A reader deals files out by size, so the order of :func:`in_mixed_order` is
    in the files alone.  Rows that don't come straight from files are written first.
    Only the files' counts, one row a file, are summed in one task and broadcast.
    """
    try:
        rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__nr"))
    except AnalysisException:
        return written_order(durable(docs, "order"), name, keep)
    part = F.regexp_extract("__file", r"/part-([0-9]+)[^/]*$", 1).try_cast("long")
    files = rows.groupBy("__file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(part, "__file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("__file", F.coalesce(before, F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__file").select(*[F.col(f"__row.`{c}`") for c in keep or docs.columns], (F.col("__start") + F.col("__nr")).alias(name))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
c AS (SELECT src, sqrt(count(*)::DOUBLE) AS w FROM d GROUP BY src),
q AS (SELECT src, greatest(1, round(w / (SELECT sum(w) FROM c) * 1000))::BIGINT AS p FROM c),
one AS (SELECT list(src ORDER BY src) AS srcs, list(p ORDER BY src) AS ps, sum(p)::BIGINT AS period FROM q),
best AS (
  SELECT 0::BIGINT AS t, list_transform(ps, lambda x: 0::BIGINT) AS k, NULL::BIGINT AS pick FROM one
  UNION ALL
  SELECT t + 1,
         list_transform(k, lambda x, i: CASE WHEN i = now THEN x + 1 ELSE x END), now
  FROM (SELECT t, k, list_min(list_transform(k, lambda x, i:
                 CASE WHEN x * period // ps[i] <= t
                      THEN ((x + 1) * period + ps[i] - 1) // ps[i] * 100000 + i END)) % 100000 AS now
        FROM best, one WHERE t < period)),
s AS (SELECT srcs[pick] AS src, ps[pick] AS p, period, t - 1 AS slot,
             row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth
      FROM best, one WHERE pick IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id) - 1 AS rank FROM d)
SELECT r.doc_id, r.source, rank // 16 AS block, rank // 16 // s.p * s.period + s.slot AS slot, rank % 16 AS place
FROM r JOIN s ON r.src = s.src AND s.nth = (rank // 16) % s.p
"""
