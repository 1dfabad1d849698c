"""Extendible hashing of documents into shards under a byte limit.

A document's address is the first 60 bits of the MD5 of its key.  The directory
starts with one bucket of depth 0; a bucket over the limit splits on the next bit
of the address, and only that bucket.  A shard is therefore the shallowest prefix
of an address whose documents fit the limit.

Instead of splitting one bit at a time, a round sums bytes for many more bits at
once, rolls these sums up to every shallower prefix and reads off the first that
fits; only documents still without a shard, such as those beyond the limit by
themselves, enter the second round, which looks at all bits that are left.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswerk.llm.shared import Scratch, aside

ADDRESS_BITS = 60
#: Shards of about this many bytes of text.
LIMIT_BYTES = 16 << 20
#: The limit of ``op2_sharding``: small, so that small tables are split many times too
#: and a long document alone goes beyond it.
QUERY_LIMIT = 32 << 10
#: Bits that a round looks beyond those an even spread would need.
EXTRA_BITS = 4


def address(key: Column) -> Column:
    """60-bit address; a null key is taken as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES, extra_bits: int = EXTRA_BITS, scratch: Scratch | None = None) -> DataFrame:
    """Per row: ``key``, n_bytes, shard, depth, shard_docs, shard_bytes, fits.

    ``shard`` is the address prefix as a string of ``depth`` bits, empty for an
    undivided directory.  Null texts have 0 bytes.  Rows that share one key share
    a shard.  Documents whose whole address is shared, or a single document beyond
    the limit, cannot be split: they get a shard of full depth with ``fits`` false.
    Repeated rows each count.  Only ``key`` and the size of ``text`` are read, so long texts
    and columns of any other name make no difference.  An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    base = scratch.write(docs.select(F.col(key).alias("key"), address(F.col(key)).alias("address"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")), "sizes")
    total, parts, open_, done, round_ = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0], [], base, 0, 0
    depth = min(ADDRESS_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + extra_bits)
    while True:
        prefix = F.shiftrightunsigned("address", ADDRESS_BITS - depth)
        leaves = open_.groupBy(prefix.alias("leaf")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
        rolled = leaves.select("leaf", "bytes", "docs", F.explode(F.sequence(F.lit(done), F.lit(depth))).alias("depth"))
        rolled = rolled.withColumn("prefix", F.expr(f"shiftrightunsigned(leaf, {depth} - depth)"))
        sums = rolled.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.lit(depth == ADDRESS_BITS) & (F.col("depth") == depth)))
        # A shard is a prefix that fits under one that does not; leaves look for theirs only
        # at the depths that shards have, so that no shallow prefix gathers them all.
        parents = fits.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        found = fits.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_anti").drop("parent")
        found = scratch.write(found, f"shards{round_}")
        low, high = found.agg(F.coalesce(F.min("depth"), F.lit(depth)), F.coalesce(F.max("depth"), F.lit(depth))).first()
        near = rolled.where(F.col("depth").between(low, high)).select("leaf", "depth", "prefix")
        directory = scratch.write(near.join(found, ["depth", "prefix"]), f"directory{round_}")
        parts.append(open_.withColumn("leaf", prefix).join(directory, "leaf"))
        if depth == ADDRESS_BITS or sum(1 for _ in leaves.join(directory, "leaf", "left_anti").take(1)) == 0:
            break
        open_ = scratch.write(open_.withColumn("leaf", prefix).join(directory, "leaf", "left_anti").drop("leaf"), f"open{round_}")
        done, depth, round_ = depth + 1, ADDRESS_BITS, round_ + 1
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), int(depth), '0')"))
    return reduce(DataFrame.unionAll, parts).select(F.col("key").alias(key), "n_bytes", shard.alias("shard"), F.col("depth").cast("long").alias("depth"), "shard_docs", "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", **options) -> None:
    """Write ``docs`` as Parquet, one folder for each shard; a column ``shard`` is replaced.

    Rows with a null key share one shard, which is looked up once and not joined; other
    columns, of whatever name, stay as they are."""
    docs, back = aside(docs.drop("shard"), key)
    scratch = options.setdefault("scratch", Scratch(docs.sparkSession, "shards"))
    shards = scratch.write(assign(docs, key, **options, text=next((k for k, v in back.items() if v == text), text)).groupBy(F.col(key).alias("__key")).agg(F.first("shard").alias("shard")), "of_keys")
    null = shards.where("__key IS NULL").first()
    joined = docs.join(shards, F.col(key) == F.col("__key")).drop("__key").unionByName(docs.where(F.col(key).isNull()).withColumn("shard", F.lit(null.shard if null else "")))
    joined.withColumnsRenamed(back).repartition("shard").write.partitionBy("shard").parquet(path)


ORACLE = f"""
WITH sizes AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS address,
         coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes
  FROM documents),
prefixes AS (
  SELECT doc_id, n_bytes, d AS depth, address >> ({ADDRESS_BITS} - d) AS prefix
  FROM sizes, range(0, {ADDRESS_BITS} + 1) t(d)),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM prefixes GROUP BY ALL),
leafs AS (
  SELECT p.doc_id, p.n_bytes, s.*, row_number() OVER (PARTITION BY p.doc_id ORDER BY s.depth) AS nth
  FROM prefixes p JOIN sums s USING (depth, prefix)
  WHERE s.shard_bytes <= {QUERY_LIMIT} OR s.depth = {ADDRESS_BITS})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
       depth::BIGINT AS depth, shard_docs, shard_bytes, shard_bytes <= {QUERY_LIMIT} AS fits
FROM leafs WHERE nth = 1
"""
