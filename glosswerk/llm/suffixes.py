"""Repeated-substring removal with a difference cover and buckets of fingerprints.

Every byte covered by a ``WINDOW``-byte string that also starts anywhere else in the
corpus is removed.

1. Equal texts are grouped first.  The texts left are dealt into chunks of about
   ``CHUNK_BYTES``; a chunk is the unit of work and of memory.
2. Cover sample.  Positions p of a text with p mod ``PERIOD`` in a difference cover
   are sampled and named by the fingerprint of their next ``BLOCK`` bytes.  For any two
   starts i, j some shift d < PERIOD puts both i + d and j + d in the sample, so
   two equal strings of BLOCK + PERIOD - 1 bytes or more hold two equal names.
3. Each chunk sends its distinct names once to the name's bucket.  Buckets split
   the range of fingerprints so that one holds about ``BUCKET_ROWS``; a task sorts
   one bucket at a time and answers each chunk with a bit mask: which of its
   names are repeated elsewhere ("tied").
4. Only starts with a tied name in their first PERIOD bytes are candidates.  They are
   ordered the same way, a bucket at a time, by a 96-bit fingerprint of their whole
   window, so ties of any length cost one comparison.  Equal neighbours are
   repeats; the chunks get a second mask and cut their texts.

What moves between tasks is distinct fingerprints one way and single bits the
other; a string held by a third of all documents is sent once by each chunk.  A
chunk sends one row to each bucket it has names for, so never more rows than names.

Not the dealt method: suffixes are not put in alphabetical order and no tie is
broken by the rank of a sample suffix; README gives the figures that decided it.
Windows count as equal if two fingerprints with independent bases (64 and 32 bits)
are; among n candidates that errs with probability n * n / 2**97 (2e-13 for the
10**8 of a GB, 3e-4 for the 10**13 of 100 TB), and bytes are not compared again.

Odd input: null and empty texts have 0 bytes; texts under ``WINDOW`` bytes lose
nothing; cuts may fall within a character, so what is kept is bytes; rows that
repeat a ``doc_id``, or a null one, are documents like any others; a text longer
than a chunk is a chunk of its own.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswerk.llm.shared import Scratch, aside

WINDOW = 400
#: Bytes that name a sample position: every repeat of BLOCK + PERIOD - 1 = 310 bytes,
#: about 50 words, ties some; at most WINDOW - PERIOD + 1, or windows would be missed.
BLOCK = 128
#: A prime q gives a perfect difference cover of q + 1 residues modulo q * q + q + 1.
COVER_PRIME = 13
PERIOD = COVER_PRIME**2 + COVER_PRIME + 1
CHUNK_BYTES = 2 << 20
BUCKET_ROWS = 1 << 20
#: Fingerprints are computed over this many bytes of a chunk at a time.
SEGMENT = 1 << 18


@lru_cache(maxsize=4)
def difference_cover(q: int) -> np.ndarray:
    """Residues modulo v = q*q + q + 1 whose differences give every residue once.

    Singer's construction: the powers of a root of a cubic over GF(q) that lie in a
    plane.  Cubics x^3 = a x^2 + b x + c are tried until the cover is perfect.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    x = ((x[2] * c) % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
                    return np.array(found)
    raise ValueError(f"no perfect difference cover for {q}")


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For two lanes: random values of bytes, powers of an odd base, inverse powers."""
    r = np.random.default_rng(99194853)
    values = r.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n, mod = SEGMENT + WINDOW + 1, 2**64
    bases = [int(b) * 2 + 1 for b in r.integers(1 << 61, 1 << 63, 2)]
    powers, inverse = (np.array([np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in bs]) for bs in ([b % mod for b in bases], [pow(b, -1, mod) for b in bases]))
    return values, powers, inverse


def fingerprints(raw: np.ndarray, at: np.ndarray, length: int, lanes: int = 1) -> list[np.ndarray]:
    """Fingerprints of raw[p : p + length] for the ascending positions ``at``: 64 bits,
    and with two lanes 32 more of another base."""
    values, powers, inverse = tables()
    out = [np.empty(len(at), (np.uint64, np.uint32)[lane]) for lane in range(lanes)]
    bounds = np.searchsorted(at, np.arange(0, len(raw) + SEGMENT, SEGMENT))
    for k, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if s == e:
            continue
        part = raw[k * SEGMENT : (k + 1) * SEGMENT + length]
        p = at[s:e] - k * SEGMENT
        for lane in range(lanes):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[lane][part] * powers[lane, : len(part)], out=sums[1:])
            h = (sums[p + length] - sums[p]) * inverse[lane][p]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            out[lane][s:e] = h if lane == 0 else (h >> np.uint64(32)).astype(np.uint32)
    return out


class Chunk:
    """The texts of a chunk laid end to end, in a fixed order."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("h1", "ascending"), ("h2", "ascending")])
        self.keys = table.select(["h1", "h2", "copies"])
        texts = [t.encode() for t in table.column("text").to_pylist()]
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], dtype=np.int64)
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def sample(self) -> np.ndarray:
        """Cover positions with a whole block after them."""
        cover, out = difference_cover(COVER_PRIME), []
        for s, e in zip(self.starts, self.ends, strict=True):
            if e - s >= BLOCK:
                p = (np.arange(0, e - s, PERIOD)[:, None] + cover[None, :]).ravel()
                out.append(s + p[p + BLOCK <= e - s])
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Which text each position lies in."""
        return np.searchsorted(self.ends, at, side="right")

    def candidates(self, tied: np.ndarray) -> np.ndarray:
        """Starts of whole windows with one of the positions ``tied`` in their first PERIOD bytes."""
        mark = np.zeros(len(self.raw) + 1, np.int32)
        p = tied
        first = self.starts[self.text_of(p)]
        np.add.at(mark, np.maximum(p - PERIOD + 1, first), 1)
        np.add.at(mark, p + 1, -1)
        could = np.cumsum(mark[:-1]) > 0
        for e, s in zip(self.ends, self.starts, strict=True):
            could[max(s, e - WINDOW + 1) : e] = False
        return np.flatnonzero(could)


class Names:
    """Distinct fingerprints of one chunk, in order, and where each came from."""

    def __init__(self, lanes: list[np.ndarray], buckets: int):
        self.order = np.lexsort(lanes[::-1]) if len(lanes) > 1 else np.argsort(lanes[0], kind="stable")
        lanes = [x[self.order] for x in lanes]
        new = np.ones(len(self.order), np.bool_)
        if len(new):
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in lanes])
        self.group = np.cumsum(new) - 1
        self.lanes = [x[new] for x in lanes]
        self.twice = np.bincount(self.group, minlength=int(new.sum())) > 1 if len(new) else new
        bucket = (self.lanes[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        self.bounds = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))

    def rows(self) -> Iterator[tuple[int, list[bytes]]]:
        for b in np.flatnonzero(np.diff(self.bounds)):
            yield int(b), [x[self.bounds[b] : self.bounds[b + 1]].tobytes() for x in self.lanes]

    def repeated(self, masks: dict[int, bytes]) -> np.ndarray:
        """For each original fingerprint: is it found again, here or elsewhere?"""
        flags = self.twice.copy()
        for b, mask in masks.items():
            s, e = self.bounds[b], self.bounds[b + 1]
            flags[s:e] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=int(e - s)).astype(np.bool_)
        out = np.empty(len(self.order), np.bool_)
        out[self.order] = flags[self.group] if len(self.order) else False
        return out


def answer(table: pa.Table) -> pa.Table:
    """One bucket: bit masks of the names that more than one chunk holds."""
    lanes = [[np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("n1", np.uint64), ("n2", np.uint32))]
    sizes = [len(x) for x in lanes[0]]
    one, two = np.concatenate(lanes[0]), np.concatenate(lanes[1])
    keys = [one] if not len(two) else [two, one]
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    flags = np.zeros(len(one), np.bool_)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    masks, at = [], 0
    for n in sizes:
        masks.append(np.packbits(flags[at : at + n]).tobytes() if flags[at : at + n].any() else None)
        at += n
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "mask": pa.array(masks, pa.binary())}).filter(pa.compute.is_valid(pa.array(masks, pa.binary())))


def _masks(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("mask").to_pylist(), strict=True))


def _sent(chunk: int, names: Names) -> pa.Table:
    rows = list(names.rows())
    lanes = [[r[1][k] if k < len(r[1]) else b"" for r in rows] for k in (0, 1)]
    return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()), "n1": pa.array(lanes[0], pa.binary()), "n2": pa.array(lanes[1], pa.binary())})


_SENT = "chunk long, bucket long, n1 binary, n2 binary"
_MASK = "chunk long, bucket long, mask binary"
_CUT = "h1 long, h2 long, n_bytes long, n_ties long, spans array<struct<start:long,end:long>>, kept binary"


def keyed(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The ``keep`` columns with a 128-bit digest (h1, h2) of each text and the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), body.alias("text"))


def cut_texts(docs: DataFrame, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per distinct text: h1, h2, n_bytes, n_ties, spans (removed, as byte offsets), kept
    (bytes).  ``n_ties`` counts the sample positions whose next ``BLOCK`` bytes are found
    at another one; it also shows repeats too short to be removed."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffixes")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(total / CHUNK_BYTES))
    sample_buckets = max(1, math.ceil(total * len(difference_cover(COVER_PRIME)) / PERIOD / BUCKET_ROWS))
    window_buckets = max(1, math.ceil(total / 4 / BUCKET_ROWS))
    texts = keyed(docs, text=text).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = scratch.bucketed(texts.withColumn("chunk", F.pmod("h1", F.lit(chunks))), "texts", max(1, math.ceil(chunks / 8)), "chunk")

    def sampled(table: pa.Table) -> tuple[Chunk, np.ndarray, Names]:
        chunk = Chunk(table)
        at = chunk.sample()
        return chunk, at, Names(fingerprints(chunk.raw, at, BLOCK), sample_buckets)

    def windows(table: pa.Table, masks: pa.Table) -> tuple[Chunk, np.ndarray, np.ndarray, Names]:
        chunk, at, names = sampled(table)
        tied = at[names.repeated(_masks(masks))]
        starts = chunk.candidates(tied)
        return chunk, tied, starts, Names(fingerprints(chunk.raw, starts, WINDOW, lanes=2), window_buckets)

    def send_names(table: pa.Table) -> pa.Table:
        return _sent(table.column("chunk")[0].as_py(), sampled(table)[2])

    def send_windows(table: pa.Table, masks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, Names([np.empty(0, np.uint64), np.empty(0, np.uint32)], window_buckets))
        return _sent(table.column("chunk")[0].as_py(), windows(table, masks)[3])

    def cut(table: pa.Table, masks: pa.Table) -> pa.Table:
        if table.num_rows:
            first, second = (masks.filter(pa.compute.equal(masks.column("step"), k)) for k in (1, 2))
            chunk, tied, starts, names = windows(table, first)
            repeated = starts[names.repeated(_masks(second))]
            keys, ends, begins, raw = chunk.keys, chunk.ends, chunk.starts, chunk.raw
            copied = keys.column("copies").to_numpy() > 1
            at = chunk.sample()
            ties = np.where(copied, np.bincount(chunk.text_of(at), minlength=len(ends)), np.bincount(chunk.text_of(tied), minlength=len(ends)))
        else:
            keys, ends, begins, raw, repeated = pa.table({c: pa.array([], pa.int64()) for c in ("h1", "h2", "copies")}), [], [], b"", np.empty(0, np.int64)
            ties = np.empty(0, np.int64)
        mark = np.zeros(len(raw) + WINDOW + 1, np.int32)
        mark[repeated] += 1
        mark[repeated + WINDOW] -= 1
        gone = np.cumsum(mark)[: len(raw)] > 0
        spans, kept = [], []
        for s, e, copies in zip(begins, ends, keys.column("copies").to_pylist(), strict=True):
            if copies > 1 and e - s >= WINDOW:
                gone[s:e] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[s:e], [False]]).astype(np.int8)))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            kept.append(raw[s:e][~gone[s:e]].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        sizes = pa.array([int(e - s) for s, e in zip(begins, ends, strict=True)], pa.int64())
        return pa.table({"h1": keys.column("h1"), "h2": keys.column("h2"), "n_bytes": sizes, "n_ties": pa.array(ties, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    def answered(sent: DataFrame, buckets: int, name: str) -> DataFrame:
        """As many tasks as buckets, whose size is fixed, however large the corpus."""
        return scratch.write(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, _MASK), name)

    first = answered(texts.groupBy("chunk").applyInArrow(send_names, _SENT), sample_buckets, "masks1")
    second = answered(texts.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send_windows, _SENT), window_buckets, "masks2")
    both = first.withColumn("step", F.lit(1)).unionAll(second.withColumn("step", F.lit(2)))
    return texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut, _CUT)


def dedup(docs: DataFrame, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_ties, spans (byte offsets removed) and kept (binary);
    columns of these names are replaced, all others stay."""
    docs, back = aside(docs.drop("n_bytes", "n_ties", "spans", "kept"), text)
    ids = docs.withColumns({"h1": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "h2": F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit("")))})
    return ids.join(cut_texts(docs, text, scratch), ["h1", "h2"]).drop("h1", "h2").withColumnsRenamed(back)


def digests(docs: DataFrame) -> DataFrame:
    found = cut_texts(docs.select("text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    results = found.select("h1", "h2", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_ties")
    return keyed(docs, "doc_id").drop("text").join(results, ["h1", "h2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_ties")
