"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors are centred, rotated by PCA and then by several rotations learned to
bring them near the corners of a cube (iterative quantisation from different
starts), and each rotated component gives one bit, ``BITS`` in all.  Centre and
rotations are learned on at most ``SAMPLE`` vectors; every vector is indexed.

Index: the rows are dealt into shards by a hash of their id.  A shard splits its
codes into ``PIECES`` substrings and keeps the rows sorted by each.  By the
pigeonhole principle a code within ``RADIUS`` of a query's is, in one substring at
least, within RADIUS // PIECES of it (one less in the later substrings), so probing
the substrings at those distances finds all of them; their whole codes are then
compared, and the rows within the radius are ranked by true distance.

Queries go to every shard in blocks of at most ``QUERY_BLOCK``; a shard answers each
with its own best, and the best of all shards win.  Queries that find fewer than k
rows within the radius are searched again with the widest radius, which is exact.

A block of queries meets a shard once, and the shard's index is built there: sorting
16 columns of ``SHARD_ROWS`` values costs well under a hundredth of probing it for
``QUERY_BLOCK`` queries.

Odd input: vectors that are null, zero or hold null or non-finite components take no
part, nor do null ids; vectors of different lengths have no distance, so each length
is searched by itself; ties go to the smaller id; rows that repeat an id are candidates
each, but never for that id's query, whose vector is the smallest of them (the
shortest first).  Columns other than the two named are not read.  An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswerk.llm.shared import Scratch

K = 10
BITS, PIECES = 256, 16
RADIUS = 108
SAMPLE = 20_000
SHARD_ROWS = 8192
QUERY_BLOCK = 4096


@dataclass
class Codes:
    """Centre and rotation (components x BITS) of the binary codes."""

    centre: np.ndarray
    rotation: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Packed bits, one row of bytes for each vector."""
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1)


def learn(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 11) -> Codes:
    """Rotations learned by iterative quantisation on the rows of ``x``."""
    centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    dims = x.shape[1]
    _, _, axes = np.linalg.svd((x - centre).T @ (x - centre))
    v, random, parts = (x - centre) @ axes.T, np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(random.normal(size=(dims, dims)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes.T @ r)
    return Codes(centre, np.concatenate(parts, axis=1)[:, :bits])


@lru_cache(maxsize=8)
def probes(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``radius`` bits set."""
    masks = np.arange(1 << width, dtype=np.uint32)
    return masks[np.bitwise_count(masks) <= radius]


class MultiIndex:
    """Rows of one shard, sorted by each substring of their codes."""

    def __init__(self, codes: np.ndarray, pieces: int = PIECES):
        self.codes = codes.view(np.uint64)
        self.width = codes.shape[1] * 8 // pieces
        self.pieces = codes.view(np.uint16 if self.width == 16 else np.uint8).astype(np.uint32)
        self.tables = []
        for column in self.pieces.T:
            order = np.argsort(column, kind="stable")
            values, first = np.unique(column[order], return_index=True)
            self.tables.append((order, values, np.append(first, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits."""
        near, extra = divmod(radius, len(self.tables))
        hit = np.zeros(len(self.codes), np.bool_)
        for k, (sub, (order, values, bounds)) in enumerate(zip(code.view(np.uint16 if self.width == 16 else np.uint8).astype(np.uint32), self.tables, strict=True)):
            r = near if k <= extra else near - 1
            if r < 0:
                continue
            masks = probes(self.width, min(r, self.width))
            if len(masks) < len(values):  # look each probe up
                probed = sub ^ masks
                at = np.minimum(np.searchsorted(values, probed), len(values) - 1)
                at = at[values[at] == probed]
            else:  # or compare the values that occur
                at = np.flatnonzero(np.bitwise_count(values ^ sub) <= r)
            starts, sizes = bounds[at], bounds[at + 1] - bounds[at]
            places = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(at) else np.empty(0, np.int64)
            hit[order[places]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ code.view(np.uint64)).sum(axis=1) <= radius]


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id long, x array<double>) of the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("x", lambda v: v != 0.0))


_FOUND = "query_id long, vec_id long, score double"


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.concatenate([np.empty(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)]).reshape(-1, dims)


def _probe(rows: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int, n_rows: int, n_queries: int) -> DataFrame:
    """Each shard's best k within the radius, for each query."""
    shards, blocks = max(1, math.ceil(n_rows / SHARD_ROWS)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    dims = len(codes.centre)
    left = rows.select("vec_id", "x", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("query_id", "x", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if mine.num_rows and asked.num_rows:
            x, q = matrix(mine.column("x"), dims), matrix(asked.column("x"), dims)
            ids, index = mine.column("vec_id").to_numpy(), MultiIndex(codes.encode(x))
            for query, vector, code in zip(asked.column("query_id").to_numpy(), q, codes.encode(q), strict=True):
                found = index.within(code, radius)
                found = found[ids[found] != query]
                score = np.sqrt(((x[found] - vector) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], score))[:k]
                out[0].append(np.full(len(best), query))
                out[1].append(ids[found[best]])
                out[2].append(score[best])
        columns = [np.concatenate(o) if o else np.empty(0) for o in out]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()) if out[0] else pa.array([], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()) if out[0] else pa.array([], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, radius: int = RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of ``vectors`` to each of
    ``queries`` (both vec_id, embedding), never the query's own id."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    rows = scratch.write(valid(vectors), "rows")
    least = F.min_by("x", F.struct(F.size("x"), "x")).alias("x")
    asked = scratch.write(valid(queries).groupBy(F.col("vec_id").alias("query_id")).agg(least), "asked")
    lengths = sorted(r.dims for r in asked.select(F.size("x").alias("dims")).distinct().collect())
    parts = [_search(rows.where(F.size("x") == n), asked.where(F.size("x") == n), n, k, radius, scratch) for n in lengths]
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts, none) if len(parts) != 1 else parts[0]


def _search(rows: DataFrame, asked: DataFrame, dims: int, k: int, radius: int, scratch: Scratch) -> DataFrame:
    """``search`` among vectors of one length."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toPandas()["x"]
    codes = learn(np.array(sample.tolist()).reshape(-1, dims))
    n_rows, n_queries = rows.count(), asked.count()
    first = scratch.write(_best(_probe(rows, asked, codes, radius, k, n_rows, n_queries), k), f"found{dims}")
    short = asked.join(first.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    n_short = short.count()
    if n_short:
        again = _best(_probe(rows, short, codes, BITS, k, n_rows, n_short), k)
        first = first.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digests(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0))
