"""Mixing sources to target weights by a Pfair schedule.

Each source's documents form blocks.  With weight w, block k (from 1) is released
at slot floor((k - 1) / w) and due by slot ceil(k / w); earliest-deadline-first
then fills the slots, and after any number of slots every source has had its share
to within less than one block.

Weights are whole shares, so the schedule repeats after as many slots as there are
shares in all.  Only that one period (as large as the weights table, never as the
corpus) is laid out on the driver; blocks take their slot from it by arithmetic.
A source that runs out leaves its later slots empty, so the others go on at their
own weights; no document is dropped or repeated.

Odd input: null and unlisted sources share ``other``; null doc_ids are documents like
any others, ordered as the empty string; texts, null, empty or very long, are not
read; columns named like the added ones are replaced, all others stay.  An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswerk.llm.shared import aside

#: Target shares of the sources; sources not listed, and null, share OTHER.
SHARES = {"src0": 10} | {f"src{k}": 5 for k in range(1, 20)}
OTHER = 5
BLOCK_DOCS = 16
#: Most slots in a period, so that the broadcast table is small by construction.
MAX_PERIOD = 100_000


def schedule(shares: list[int]) -> list[tuple[int, int, int, int, int]]:
    """One period as (class, k, release, deadline, slot), k and slot from 0."""
    period = sum(shares)
    if not 0 < period <= MAX_PERIOD or min(shares) < 0:
        raise ValueError(f"shares must be whole, not negative, with a sum from 1 to {MAX_PERIOD}")
    done, out = [0] * len(shares), []
    for slot in range(period):
        due = [(-(-(done[c] + 1) * period // a), c) for c, a in enumerate(shares) if done[c] < a and done[c] * period // a <= slot]
        deadline, c = min(due)
        out.append((c, done[c], done[c] * period // shares[c], deadline, slot))
        done[c] += 1
    return out


def order_key(key: Column) -> Column:
    """Documents of a source are taken in the order of this digest, a fixed shuffle."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", shares: dict[str, int] | None = None, other: int = OTHER, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, source, block, release, deadline, slot, place.

    ``block`` counts a source's blocks from 0, ``place`` the documents in a block;
    (slot, place) is the order of the mixture.  All rows come back; rows that
    repeat a doc_id take neighbouring places.  Other columns are not carried.
    """
    shares = SHARES if shares is None else shares
    names, parts = list(shares), [*shares.values(), other]
    if min(parts) < 1:
        raise ValueError("every share, and other, must be 1 or more")
    plan = schedule(parts)
    spark = docs.sparkSession
    table = spark.createDataFrame([(c, k, r, d, s) for c, k, r, d, s in plan], "class int, k int, r long, d long, s long")
    which = F.coalesce(*(F.when(F.col("source") == n, i) for i, n in enumerate(names)), F.lit(len(names))) if names else F.lit(0)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), order_key(F.col(doc_id)).alias("o"))
    # A source is ranked within buckets of its digest and the buckets are offset by
    # their counts: a hot source is spread evenly and never sorted in one task.
    n = rows.count()
    digits = max(1, math.ceil(math.log(max(1, n / 20_000), 16)))
    rows = rows.withColumn("class", which).withColumn("bucket", F.substring("o", 1, digits))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("class", "bucket").count().select("class", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("class", "bucket").orderBy("o", "doc_id", "source")
    ranked = rows.withColumn("nth", F.row_number().over(within) - 1).join(counts, ["class", "bucket"]).withColumn("nth", F.col("nth") + F.col("offset"))
    sizes = F.element_at(F.lit(parts), F.col("class") + 1).cast("long")
    blocks = ranked.select("doc_id", "source", "class", F.expr(f"nth div {block_docs}").alias("block"), F.pmod("nth", F.lit(block_docs)).cast("long").alias("place"), sizes.alias("share"))
    blocks = blocks.withColumn("k", F.pmod("block", "share").cast("int")).withColumn("base", F.expr(f"(block div share) * {len(plan)}L"))
    placed = blocks.join(F.broadcast(table), ["class", "k"])
    return placed.select("doc_id", "source", "block", (F.col("base") + F.col("r")).alias("release"), (F.col("base") + F.col("d")).alias("deadline"), (F.col("base") + F.col("s")).alias("slot"), "place")


def in_order(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` unchanged, range-partitioned and sorted in the order of the mixture.

    Rows that repeat a doc_id all come at the first of their slots.
    """
    joined, columns, back = _sorted(docs, doc_id, **options)
    return joined.select(*columns).withColumnsRenamed(back)


def placed(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """As ``in_order``, with the columns slot and place that give each row's turn;
    columns of ``docs`` with these names are replaced."""
    joined, columns, back = _sorted(docs.drop("slot", "place"), doc_id, **options)
    return joined.select(*columns, "__at.slot", "__at.place").withColumnsRenamed(back)


def _sorted(docs: DataFrame, doc_id: str, **options) -> tuple[DataFrame, list[str], dict[str, str]]:
    order = mix(docs, doc_id=doc_id, **options).groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.struct("slot", "place")).alias("__at"))
    docs, back = aside(docs, doc_id)
    null = order.where("__id IS NULL").select("__at.*").first() if docs.where(F.col(doc_id).isNull()).take(1) else None
    joined = docs.join(order, F.col(doc_id) == F.col("__id"))
    if null:  # rows without an id share one turn, which is looked up once and not joined
        turn = F.struct(F.lit(null.slot).alias("slot"), F.lit(null.place).alias("place"))
        joined = joined.unionByName(docs.where(F.col(doc_id).isNull()).withColumns({"__id": F.lit(None).cast(order.schema["__id"].dataType), "__at": turn}))
    return joined.repartitionByRange("__at.slot", "__at.place").sortWithinPartitions("__at.slot", "__at.place", doc_id), docs.columns, back


_CLASS = "CASE " + " ".join(f"WHEN source = '{n}' THEN {i}" for i, n in enumerate(SHARES)) + f" ELSE {len(SHARES)} END"
_PARTS = [*SHARES.values(), OTHER]
_N = sum(_PARTS)
ORACLE = f"""
WITH RECURSIVE shares AS (SELECT {_PARTS} AS a),
edf AS (
  SELECT 0 AS t, list_transform(a, lambda x: 0) AS done, -1 AS c, 0 AS k FROM shares
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(a) + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick - 1, done[pick] FROM (
    SELECT t, done, a, list_min(list_transform(range(1, len(a) + 1), lambda i:
      CASE WHEN done[i] < a[i] AND done[i] * {_N} // a[i] <= t THEN ((done[i] + 1) * {_N} + a[i] - 1) // a[i] * 1000 + i ELSE 1000000000 END)) % 1000 AS pick
    FROM edf, shares WHERE t < {_N})),
period AS (SELECT c AS class, k, k * {_N} // a[c + 1] AS r, ((k + 1) * {_N} + a[c + 1] - 1) // a[c + 1] AS d, t - 1 AS s FROM edf, shares WHERE c >= 0),
ranked AS (
  SELECT doc_id, source, class, row_number() OVER (PARTITION BY class ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, source) - 1 AS nth
  FROM (SELECT doc_id, source, {_CLASS} AS class FROM documents)),
blocks AS (SELECT doc_id, source, class, nth // {BLOCK_DOCS} AS block, nth % {BLOCK_DOCS} AS place, a[class + 1] AS share FROM ranked, shares)
SELECT doc_id, source, block::BIGINT AS block, (block // share * {_N} + r)::BIGINT AS release, (block // share * {_N} + d)::BIGINT AS deadline,
       (block // share * {_N} + s)::BIGINT AS slot, place::BIGINT AS place
FROM blocks b JOIN period p ON b.class = p.class AND b.block % share = p.k
"""
