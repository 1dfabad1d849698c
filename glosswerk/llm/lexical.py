"""Ranked lexical search over document-sharded postings with integer impacts.

Terms are the maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z in
lower case.  One pass over the texts makes the shards: consecutive rows of an input
partition, up to ``SHARD_DOCS`` documents and about ``SHARD_TERMS`` term occurrences, become
one row that holds their terms in byte order and, in compressed sparse rows, each term's
documents and counts.  Statistics (documents, occurrences, and in how many documents a
term is) come from the shards, and a second pass over them turns counts into impacts,
which depend on the collection's mean length.  Both are plain tables, so one index serves
many searches (``Index``).

A search looks up its terms' weights, packs items into blocks of up to ``BLOCK_ITEMS``
items and about ``BLOCK_TERMS`` terms, and sends each block (so bounded) to all tasks.
A task goes through its shards one at a time, adds weight times impact of each term of an
item into a dense array over the shard's documents, and picks the best with argpartition,
keeping everything that ties with the last place before ids decide.  It keeps the best
of its shards so far, and Spark merges the tasks' lists.  No posting is moved after it is written.

Scores are 64-bit integers.  With N documents that have a term, L occurrences in all, n in
a document, f documents with the term and t occurrences of it in the document: weight
floor(1000 ln((2N+2)/(2f+1))), m = 25 + (75nN) div L, impact (10^9 t) div (1000t + 8m).

Odd input: null and empty texts have no terms; an item or document without terms finds
nothing and is not found.  Rows that repeat a doc_id are documents of their own; rows
that repeat an item_id are one item with the terms of all.  A null doc_id stands last among
equal scores; a null item_id is an item like another.  A long text is read in pieces; a
document of more than ``SHARD_TERMS`` occurrences is a shard by itself.  Extra columns are
not read.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswerk.llm.shared import Scratch, limit_batches, text_bytes

K = 10
SHARD_DOCS = 1 << 15
SHARD_TERMS = 1 << 20
BLOCK_ITEMS = 1024
BLOCK_TERMS = 1 << 17
#: A text is read in pieces of about this many bytes.
PIECE = 1 << 20

#: Bytes that end a term become spaces, A-Z become a-z.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, some at a time."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(_TERM_BYTES)
        if at + PIECE < len(text) and (end := piece.rfind(b" ")) >= 0:
            piece = piece[:end]
        elif at + PIECE < len(text):  # one term fills the piece
            rest = text[at:].translate(_TERM_BYTES)
            end = rest.find(b" ")
            piece = rest if end < 0 else rest[:end]
        at += max(1, len(piece))
        yield piece.split()


_RAW = "terms array<binary>, starts binary, docs binary, counts binary, ids array<long>, sizes binary"
_SHARD = "terms array<binary>, starts binary, docs binary, impacts binary, ids array<long>"


class _Shard:
    """Postings of the documents added so far."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.sizes, self.found, self.total = [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts: Counter[bytes] = Counter()
        for words in terms(text):
            counts.update(words)
        if not counts:
            return
        number, n = self.vocabulary, len(counts)
        terms_ = np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int32, n)
        self.found.append((terms_, np.fromiter(counts.values(), np.int32, n)))
        self.ids.append(doc_id)
        self.sizes.append(size := int(self.found[-1][1].sum()))
        self.total += size

    def full(self) -> bool:
        return self.total >= SHARD_TERMS or len(self.ids) >= SHARD_DOCS

    def row(self) -> pa.RecordBatch:
        names = [*self.vocabulary]
        place = np.empty(len(names), np.int64)
        order = sorted(range(len(names)), key=names.__getitem__)
        place[order] = np.arange(len(names))
        term = place[np.concatenate([t for t, _ in self.found])]
        doc = np.repeat(np.arange(len(self.ids)), [len(t) for t, _ in self.found])
        turn = np.argsort(term * len(self.ids) + doc, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
        counts = np.concatenate([c for _, c in self.found])[turn]
        columns = [pa.array([[names[k] for k in order]], pa.list_(pa.binary())), *(pa.array([x.tobytes()]) for x in (starts.astype("<u4"), doc[turn].astype("<u2"), counts.astype("<u4")))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([self.ids], pa.list_(pa.int64())), pa.array([np.array(self.sizes, "<u4").tobytes()])], names=[c.split()[0] for c in _RAW.split(", ")])


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = _Shard()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
            shard.add(doc_id, text)
            if shard.full():
                yield shard.row()
                shard = _Shard()
    if shard.ids:
        yield shard.row()


@dataclass
class Index:
    """Postings in shards, documents of each term, and the collection's size."""

    shards: DataFrame
    frequencies: DataFrame
    documents: int

    @classmethod
    def build(cls, docs: DataFrame, scratch: Scratch) -> Index:
        """From (doc_id, text); every document is indexed."""
        limit_batches(docs.sparkSession)
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        raw = scratch.write(narrow.mapInArrow(_invert, _RAW), "raw")

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = [np.frombuffer(x, "<u4") for x in batch.column("sizes").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sizes], pa.int64()), pa.array([int(s.sum(dtype=np.int64)) for s in sizes], pa.int64())], names=["n", "l"])

        n, length = raw.select("sizes").mapInArrow(measure, "n long, l long").agg(F.sum("n"), F.sum("l")).first()

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    held = np.diff(np.frombuffer(batch.column("starts")[k].as_py(), "<u4").astype(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column("terms")[k].values, pa.array(held, pa.int64())], names=["term", "docs"])

        frequencies = scratch.write(raw.select("terms", "starts").mapInArrow(tally, "term binary, docs long").groupBy("term").agg(F.sum("docs").alias("docs")), "frequencies")

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    doc = np.frombuffer(batch.column("docs")[k].as_py(), "<u2")
                    t = np.frombuffer(batch.column("counts")[k].as_py(), "<u4").astype(np.int64)
                    m = np.array([100 - 75 + (75 * s * n) // length for s in np.frombuffer(batch.column("sizes")[k].as_py(), "<u4").tolist()], np.int64)
                    impacts = (1_000_000_000 * t) // (1000 * t + 8 * m[doc])
                    row = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("terms", "starts", "docs")), pa.array([impacts.astype("<u4").tobytes()]), row.column("ids")], names=[c.split()[0] for c in _SHARD.split(", ")])

        shards = scratch.write(raw.mapInArrow(weigh, _SHARD), "shards")
        scratch.drop("raw")
        return cls(shards, frequencies, n or 0)

    def search(self, items: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
        """item_id, rank, doc_id, score: the k best documents of each of ``items``
        (item_id, text) with a score above 0."""
        spark = items.sparkSession
        blocks = scratch.write(self._blocks(items), "blocks")
        numbers = [r.block for r in blocks.select("block").collect()]
        for number in numbers:
            row = blocks.where(F.col("block") == number).first()
            sent = spark.sparkContext.broadcast((np.frombuffer(row.starts, "<i8"), [bytes(t) for t in row.terms], np.frombuffer(row.weights, "<i8")))
            scratch.write(self.shards.mapInArrow(_searcher(sent, k), _FOUND), f"found/block={number}")
            sent.destroy()
        found = scratch.read("found", f"{_FOUND}, block long") if numbers else spark.createDataFrame([], f"{_FOUND}, block long")
        found = found.join(blocks.select("block", F.posexplode("items").alias("place", "item_id")), ["block", "place"])
        rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

    def _blocks(self, items: DataFrame) -> DataFrame:
        """Rows of up to ``BLOCK_ITEMS`` items with their terms and weights (times repeats)."""
        kind = items.schema["item_id"].dataType
        asked = items.select("item_id", "text").mapInArrow(_split, items.select("item_id").schema.add("term", "binary").add("times", "long"))
        asked = asked.groupBy("item_id", "term").agg(F.sum("times").alias("times"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * self.documents + 2) / (2.0 * F.col("docs") + 1))).cast("long") * F.col("times")
        whole = asked.join(self.frequencies, "term").select("item_id", "term", weight.alias("weight")).where("weight > 0")
        whole = whole.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            made, held, size = 0, [], 0
            base = TaskContext.get().partitionId() << 32
            for batch in batches:
                for k in range(batch.num_rows):
                    n = len(batch.column("terms")[k])
                    if held and (len(held) >= BLOCK_ITEMS or size + n > BLOCK_TERMS):
                        yield _block(base + made, held, schema)
                        made, held, size = made + 1, [], 0
                    held.append((batch.column("item_id").slice(k, 1), batch.column("terms")[k].values))
                    size += n
            if held:
                yield _block(base + made, held, schema)

        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([("block", pa.int64()), ("items", pa.list_(to_arrow_type(kind))), ("starts", pa.binary()), ("terms", pa.list_(pa.binary())), ("weights", pa.binary())])
        n = whole.select(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
        parts = max(1, math.ceil(n[0] / BLOCK_ITEMS * 1.1), math.ceil((n[1] or 0) / BLOCK_TERMS * 1.1)) if n[0] > BLOCK_ITEMS or (n[1] or 0) > BLOCK_TERMS else 1
        return whole.repartition(parts).mapInArrow(pack, f"block long, items array<{kind.simpleString()}>, starts binary, terms array<binary>, weights binary")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, text in enumerate(text_bytes(batch.column("text"))):
            counts: Counter[bytes] = Counter()
            for words in terms(text):
                counts.update(words)
            ids = batch.column("item_id").take(pa.array(np.full(len(counts), k)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())], names=["item_id", "term", "times"])


def _block(number: int, held: list[tuple[pa.Array, pa.StructArray]], schema: pa.Schema) -> pa.RecordBatch:
    ids = pa.concat_arrays([i for i, _ in held])
    words = pa.concat_arrays([t.field("term") for _, t in held])
    weights = pa.concat_arrays([t.field("weight") for _, t in held]).to_numpy()
    starts = np.cumsum([0, *(len(t) for _, t in held)])

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays([pa.array([number]), one(ids), pa.array([starts.astype("<i8").tobytes()]), one(words), pa.array([weights.astype("<i8").tobytes()])], schema=schema)


_FOUND = "place int, doc_id long, score long"


def top(scores: np.ndarray, ids: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores; equal ones by id, marked ids last."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        s = scores[found]
        kth = s[np.argpartition(-s, k - 1)[k - 1]]
        found = found[s >= kth]  # all that tie with the last place
    return found[np.lexsort((ids[found], last[found], -scores[found]))[:k]]


def _searcher(sent, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, words, weights = sent.value
        asked = pa.array(words, pa.binary())
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                place = pc.index_in(asked, value_set=batch.column("terms")[r].values).fill_null(-1).to_numpy()
                bounds = np.frombuffer(batch.column("starts")[r].as_py(), "<u4").astype(np.int64)
                docs = np.frombuffer(batch.column("docs")[r].as_py(), "<u2")
                impacts = np.frombuffer(batch.column("impacts")[r].as_py(), "<u4").astype(np.int64)
                held = batch.column("ids")[r].values
                ids, last = held.fill_null(0).to_numpy(), held.is_null().to_numpy(zero_copy_only=False)
                scores = np.zeros(len(ids), np.int64)
                for item in range(len(starts) - 1):
                    scores[:] = 0
                    for q in range(starts[item], starts[item + 1]):
                        if (p := place[q]) >= 0:
                            a, b = bounds[p], bounds[p + 1]
                            scores[docs[a:b]] += weights[q] * impacts[a:b]
                    won = top(scores, ids, last, k)
                    if not len(won):
                        continue
                    new = scores[won], ids[won], last[won]
                    if item in best:
                        new = [np.concatenate(pair) for pair in zip(best[item], new, strict=True)]
                        won = top(*new, k)
                        new = [x[won] for x in new]
                    best[item] = tuple(new)
        if best:
            sizes = [len(v[0]) for v in best.values()]
            score, ids, last = (np.concatenate([v[j] for v in best.values()]) for j in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([*best], np.int32), sizes)), pa.array(ids, pa.int64(), mask=last), pa.array(score, pa.int64())], names=["place", "doc_id", "score"])

    return search


def rank(docs: DataFrame, items: DataFrame, k: int = K, scratch: Scratch | None = None) -> DataFrame:
    scratch = scratch or Scratch(docs.sparkSession, "lexical")
    return Index.build(docs, scratch).search(items, scratch, k)


_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
c AS (SELECT count(*) AS n, sum(len(words)) AS l FROM d WHERE len(words) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT item_id, term, times * CAST(floor(1000 * ln((2.0::DOUBLE * c.n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), c),
m AS (SELECT r, doc_id, 100 - 75 + CAST((75 * len(words) * c.n) // c.l AS BIGINT) AS m FROM d, c WHERE len(words) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM w JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM t WHERE rank <= {K}
"""
