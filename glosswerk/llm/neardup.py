"""Near-duplicate documents by b-bit MinHash.

1. A document's set is its distinct five-word shingles (lower-cased A-Z; words are
   ``[^\\x20\\x09-\\x0D]+``).  Documents of one and the same set are grouped by its
   fingerprint, and only the smallest ``doc_id`` of each goes on.
2. Of the minima of ``HASHES`` hash functions, ``ROWS`` at a time are hashed to
   ``BANDS`` band keys; of each minimum only ``BITS`` bits are kept, packed into longs.
3. Documents that share a band key are candidates.  A bit count over two packed
   signatures gives the share of equal minima, and corrected for chance collisions
   the estimated similarity; pairs below ``FLOOR`` (four standard errors under the
   threshold) or whose set sizes rule the threshold out go no further.
4. Candidates are confirmed on the full sets and joined to components.

A band's bucket never emits all its pairs.  First each document is tested against
one document of its buckets (the smallest, or the largest, of each bucket), and
components are formed.  Then pairs that lie in different components are compared
inside the tasks, in blocks of at most ``BLOCK`` documents on a side whatever a
bucket's size; a pair belongs to the first band it shares, and each component sends
only its nearest pair of each block to be confirmed.  Once these have merged their
components, all pairs above the floor that still lie in different ones are confirmed.
So every candidate pair is either within one component or was confirmed.

Odd input: null, empty or blank texts have no set and are linked with nothing; a
text of one to four words has its whole sequence as one shingle; of rows that repeat
a ``doc_id`` with different texts the one with the smallest fingerprint stands for
all; a null ``doc_id`` is linked with nothing, has a null component and is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswerk.llm.components import components
from glosswerk.llm.shared import Scratch, aside, join_hot, slices, text_bytes

WORDS = 5
#: A pair is linked where 100 * intersection >= PERCENT * union.
PERCENT = 75
HASHES, BANDS, ROWS, BITS = 512, 48, 6, 4
FLOOR = 0.67
#: Estimates from here on count as clearly near when a pivot is chosen.
CLEAR = 0.85
BLOCK = 2048
_LANES = 0x1111111111111111


class WordHashes(dict):
    """64-bit hashes of words, emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers of the hash functions, and of the rows of a band."""
    r = np.random.default_rng(20240229)
    odd = lambda n, bits: r.integers(0, 1 << (bits - 1), n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(HASHES, 32).astype(np.uint32), odd(ROWS, 64)


def shingles(text: bytes, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = text.lower().split()  # bytes.split() and .lower() know ASCII alone
    n = len(words)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    if not n:
        return h
    size = min(n, WORDS)
    s = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        s = mixed(s + h[j : j + len(s)])
    return np.unique(s)


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima and band keys of a non-empty set."""
    a, q = multipliers()
    found = (found >> np.uint64(32)).astype(np.uint32)
    least, rows = np.empty(HASHES, np.uint32), max(1, 131_072 // len(found))
    for k in range(0, HASHES, rows):
        least[k : k + rows] = (a[k : k + rows, None] * found[None, :]).min(axis=1)
    spread = mixed(least + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)))
    low = (spread & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    packed = (low << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    bands = mixed((spread[: BANDS * ROWS].reshape(BANDS, ROWS) * q).sum(axis=1, dtype=np.uint64))
    return packed, bands


def estimate(equal_share):
    """Similarity from the share of equal lanes, corrected for chance collisions."""
    chance = 2.0**-BITS
    return (equal_share - chance) / (1 - chance)


def estimated(a: Column, b: Column) -> Column:
    """``estimate`` of two packed signatures (array<long>), inside Spark."""
    def lanes(x: Column) -> Column:
        """Lowest bit of each lane that has any bit set."""
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LANES))

    unequal = F.aggregate(F.transform(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), lambda x: F.bit_count(lanes(x))), F.lit(0), lambda s, x: s + x)
    return estimate(F.lit(1.0) - unequal / F.lit(float(HASHES)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id, packed, bands of (doc_id, text) rows.

    ``set_id`` is a 128-bit fingerprint of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for part in slices(whole, "text"):
                sizes, prints, packed, bands = [], [], [], []
                for text in text_bytes(part.column("text")):
                    found = shingles(text, cache)
                    sizes.append(len(found))
                    prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    p, b = signature(found) if len(found) else (None, None)
                    packed.append(None if p is None else p.view(np.int64))
                    bands.append(None if b is None else b.view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(packed, longs), pa.array(bands, longs)], names=["doc_id", "n_shingles", "set_id", "packed", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, packed array<long>, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, found (the sorted set as packed unsigned 64-bit integers) of the rows
    (doc_id, text, set_id) whose text has that fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for part in slices(whole, "text"):
                found = [shingles(t, cache).tobytes() for t in text_bytes(part.column("text"))]
                meant = [xxhash.xxh3_128_digest(f) == s for f, s in zip(found, part.column("set_id").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "found"]).filter(pa.array(meant, pa.bool_()))

    return docs.mapInArrow(run, "doc_id long, found binary")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) whose full sets reach the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("found_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("found").alias("found_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "found_a", "found_b"):
                keep = []
                for x, y in zip(part.column("found_a").to_pylist(), part.column("found_b").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(two, "b").join(one, "a").mapInArrow(run, "a long, b long")


def across(members: DataFrame, nearest: bool) -> DataFrame:
    """(a, b) of different components within a cell, estimated above the floor.

    ``members``: cell (string), side (0 or 1), place (of the cell's band), node,
    component, size, packed, bands.  In a cell with two sides only pairs between
    them are made, else pairs within it, and only those that share no earlier band.
    With ``nearest`` each component sends its nearest pair alone.  A cell has at most
    ``BLOCK`` rows or so on a side; rows of a cell come together.
    """

    def pairs_of(side, place, node, comp, size, packed, bands) -> tuple[np.ndarray, np.ndarray]:
        two = bool(side.any()) and not bool(side.all())
        right, left, found = np.flatnonzero(side == 1), [], []
        score: list[np.ndarray] = []
        for k in range(len(node)):
            if two and side[k] == 1:
                continue
            others = right if two else np.arange(k + 1, len(node))
            others = others[(comp[others] != comp[k]) & (100 * np.minimum(size[others], size[k]) >= PERCENT * np.maximum(size[others], size[k]))]
            x = packed[others] ^ packed[k]
            x |= x >> np.uint64(2)
            x = (x | (x >> np.uint64(1))) & np.uint64(_LANES)
            est = estimate(1 - np.bitwise_count(x).sum(axis=1, dtype=np.int64) / HASHES)
            others, est = others[est >= FLOOR], est[est >= FLOOR]
            new = ~(bands[others, : place[k]] == bands[k, : place[k]]).any(axis=1)
            left.append(np.full(int(new.sum()), k))
            found.append(others[new])
            score.append(est[new])
        if not left:
            return node[:0], node[:0]
        a, b, est = np.concatenate(left), np.concatenate(found), np.concatenate(score)
        if nearest:
            groups, pair = np.concatenate([comp[a], comp[b]]), np.tile(np.arange(len(a)), 2)
            order = np.lexsort((node[b[pair]], node[a[pair]], -est[pair], groups))
            first = np.unique(groups[order], return_index=True)[1]
            pick = np.unique(pair[order[first]])
            a, b = a[pick], b[pick]
        return np.minimum(node[a], node[b]), np.maximum(node[a], node[b])

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cells = table.column("cell").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
        columns = [table.column(c).to_numpy() for c in ("side", "place", "node", "component", "size")]
        wide = [np.array(table.column(c).combine_chunks().flatten()).reshape(table.num_rows, -1) for c in ("packed", "near")]
        columns += [wide[0].view(np.uint64), wide[1]]
        out = [pairs_of(*(c[s:e] for c in columns)) for s, e in zip(edges[:-1], edges[1:], strict=True) if e - s > 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a cell that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            cells = table.column("cell").to_numpy()
            new = np.flatnonzero(cells != cells[-1])
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield from emit(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held))

    return members.mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = scratch.write(signatures(source), "signatures")
    one = signed.where("doc_id IS NOT NULL AND set_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_id").alias("set_id"))
    nodes = scratch.write(one.groupBy("set_id").agg(F.min("doc_id").alias("node")), "nodes")
    sets = scratch.write(signed.join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "set_id"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "packed", "bands"), "sets")
    signs = sets.select("node", "packed")

    banded = scratch.write(sets.select("node", F.posexplode("bands").alias("place", "band")), "bands")
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).where("n > 1")
    shared = scratch.write(join_hot(banded, buckets, "band", "n", banded.count()), "shared")
    scratch.drop("bands")
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").withColumnRenamed("node", "doc_id")
    full = scratch.write(shingle_sets(source.join(wanted, "doc_id")), "full")

    # Round 1: each document against one pivot, the smallest that is clearly near or else the nearest.
    pivots = shared.select("node", F.explode(F.array("least", "most")).alias("pivot")).where("node != pivot").distinct()
    pivots = scratch.write(pivots, "pivots")
    asked = pivots.groupBy("pivot").agg(F.count("*").alias("n")).join(signs.select(F.col("node").alias("pivot"), F.col("packed").alias("other")), "pivot")
    scored = join_hot(pivots.join(signs, "node"), asked, "pivot", "n", pivots.count())
    scored = scored.select("node", "pivot", estimated(F.col("packed"), F.col("other")).alias("est")).where(F.col("est") >= FLOOR)
    clear = F.col("est") >= CLEAR
    rank = F.struct((~clear).alias("far"), F.when(clear, F.lit(0.0)).otherwise(-F.col("est")).alias("by"), F.col("pivot").alias("pivot"))
    tested = scored.groupBy("node").agg(F.min(rank).alias("r")).select(F.least("node", "r.pivot").alias("a"), F.greatest("node", "r.pivot").alias("b"))
    tested = scratch.write(tested.distinct(), "tested1")
    links = scratch.write(confirm(tested, full), "links1")
    labels = scratch.write(components(links, scratch, "first"), "labels1")

    # Round 2: the nearest pairs across components.  Round 3: all that are left.
    for k, nearest in ((2, True), (3, False)):
        pairs = across(cells(shared, sets, labels), nearest).join(tested, ["a", "b"], "left_anti")
        new = scratch.write(pairs, f"tested{k}")
        links = scratch.write(links.unionAll(confirm(new, full)), f"links{k}")
        labels = scratch.write(components(links, scratch, f"round{k}_"), f"labels{k}")
        tested = tested.unionAll(new)
    scratch.drop("sets", "shared", "pivots", "full", "tested1", "tested2", "tested3", "links1", "links2", "links3", "labels1", "labels2")

    classed = with_label(one.join(nodes, "set_id"), labels, "node", "component").select(F.col("doc_id").alias("id"), "component")
    out = signed.select("doc_id", "n_shingles").join(classed, signed["doc_id"] == classed["id"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def cells(shared: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of all buckets that hold several components, dealt into cells of
    one block, or of two blocks as their sides; rows of a cell come together."""
    labelled = with_label(shared.select("band", "place", "node", "n"), labels, "node", "component")
    several = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    near = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int"))
    rest = labelled.join(several, "band", "left_semi").join(sets.select("node", "size", "packed", near.alias("near")), "node")
    rest = rest.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.concat_ws("/", "band", F.least("mine", "j"), F.greatest("mine", "j"))
    dealt = rest.select(cell.alias("cell"), (F.col("mine") > F.col("j")).cast("int").alias("side"), "place", "node", "component", "size", "packed", "near")
    return dealt.repartition("cell").sortWithinPartitions("cell")


def with_label(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """``rows`` with the component of ``node``, which is its own until it is linked."""
    found = labels.select(F.col("node").alias(node), F.col("component").alias("__found"))
    return rows.join(found, node, "left").withColumn(label, F.coalesce("__found", node)).drop("__found")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those whose component has a smaller doc_id."""
    gone = classes(docs, doc_id, text).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    docs, back = aside(docs, doc_id, text)
    return docs.join(gone, docs[doc_id].cast("long") == gone["__gone"], "left_anti").withColumnsRenamed(back)


ORACLE = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) END) AS s
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * inter >= {PERCENT} * (x.n + y.n - inter)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, least(a, min(b)) AS c FROM edges GROUP BY a
  UNION
  SELECT e.a, min(r.c) FROM reach r JOIN edges e ON e.b = r.doc_id GROUP BY e.a)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(r.c, d.doc_id)::BIGINT AS component_id, d.doc_id = coalesce(r.c, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""
