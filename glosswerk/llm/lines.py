"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table bucketed and sorted by line hash: the hash, how many documents
of one batch hold the line, and the largest ``doc_id`` among them.  A new batch
merge-anti-joins the runs, bucket by bucket and without moving them, so lines that are
already settled are not stored again, and adds the rest as a run of level 0.  Once a
level has ``fanout`` runs they are compacted into one run of the next level, so n
batches leave O(log n) runs and each entry is rewritten O(log n) times.  A manifest
beside the runs names the levels; ``LineRuns.open`` takes them up in a later job.

Files are few: Hadoop's local file system starts some processes for each one it makes,
and each of them shares all memory of its executor until it runs its own program.  So
entries are rebalanced before they are written, and runs have a bucket for
``BUCKET_ENTRIES``.

Rules, also for odd input: a line's key is the line without ``[\\x20\\x09-\\x0D]``
at both ends and with A-Z in lower case; only keys of ``min_chars`` code points or
more count.  A key in at least ``min_docs`` documents loses all its lines except
those in the largest ``doc_id`` holding it.  Rows that repeat a ``doc_id`` are one
document, but within one call: a ``doc_id`` added to the same runs in two calls counts
as two documents.  A null ``doc_id`` holds no line and loses none.  A null or empty text
is one empty line; a null text stays null.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswerk.llm.shared import WS, Scratch, aside, join_hot, shuffle_partitions, slices, text_bytes

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
#: Entries for which the runs of one call have a bucket; never more buckets than shuffle partitions.
BUCKET_ENTRIES = 200_000
_WS = WS.encode()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, None if the key is too short to count."""
    key = line.strip(_WS).lower()  # bytes.lower() changes A-Z alone
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


_RUN = "key binary, docs long, last long"


class LineRuns:
    """The levelled runs; ``add`` takes batches of (key, docs, last)."""

    def __init__(self, scratch: Scratch, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.scratch, self.min_docs, self.fanout = scratch, min_docs, fanout
        self.buckets = buckets or shuffle_partitions(scratch.spark)
        self.levels: list[list[str]] = [[]]
        self.written = self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineRuns:
        """The runs below ``path`` as their last ``add`` left them."""
        last = spark.read.text(f"{path}/manifest").orderBy(F.desc("version")).first()
        kept = json.loads(last.value)
        runs = cls(Scratch(spark, "lines", path), kept["min_docs"], kept["fanout"], kept["buckets"])
        runs.levels, runs.written, runs.version = kept["levels"], kept["written"], last.version
        return runs

    def _save(self) -> None:
        self.version += 1
        kept = json.dumps({"min_docs": self.min_docs, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels, "written": self.written})
        self.scratch.spark.createDataFrame([(kept,)], "value string").coalesce(1).write.text(f"{self.scratch.path}/manifest/version={self.version}")

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"run{self.written}"
        self.written += 1
        self.scratch.bucketed(entries, name, self.buckets, "key", sort=True, dealt=True)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _run(self, name: str) -> DataFrame:
        return self.scratch.open_bucketed(name, _RUN, self.buckets, "key")

    def _names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key is not settled: once enough documents, with a
        larger id among them, are stored."""
        docs, largest = F.lit(0), F.lit(None).cast("long")
        joined = batch
        for k, name in enumerate(self._names()):
            run = self._run(name).select("key", F.col("docs").alias(f"docs{k}"), F.col("last").alias(f"last{k}"))
            joined = joined.join(run, "key", "left")
            docs, largest = docs + F.coalesce(f"docs{k}", F.lit(0)), F.greatest(largest, F.col(f"last{k}"))
        settled = (docs >= self.min_docs) & (F.col("last") <= F.coalesce(largest, F.lit(-(2**63))))
        return joined.where(~settled).select(*batch.columns)

    def add(self, batch: DataFrame) -> None:
        if self.buckets != shuffle_partitions(self.scratch.spark):  # else its grouping has dealt it so
            batch = batch.repartition(self.buckets, "key")
        self._write(self.unsettled(batch), 0)
        old: list[str] = []
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                self._write(self._merged(names), level + 1)
                self.levels[level] = []
                old += names
        self._save()
        self.scratch.drop(*old)

    def _merged(self, names: list[str]) -> DataFrame:
        """Two runs at a time: they lie in the same buckets, so none is moved.  (A union of
        bucketed tables must not be grouped: Spark 4.1.2 then takes their buckets to
        be aligned although they are not, and gives wrong sums.)"""
        merged = self._run(names[0])
        for name in names[1:]:
            other = self._run(name).select("key", F.col("docs").alias("docs2"), F.col("last").alias("last2"))
            sums = (F.coalesce("docs", F.lit(0)) + F.coalesce("docs2", F.lit(0))).alias("docs")
            merged = merged.join(other, "key", "full_outer").select("key", sums, F.greatest("last", "last2").alias("last"))
        return merged

    def table(self) -> DataFrame:
        """key, docs, last over all batches; docs may stop at ``min_docs`` or more."""
        return self._merged(self._names())


def _entries(docs: DataFrame, doc_id: str, text: str, min_chars: int, batches: int) -> DataFrame:
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(batches)).cast("int").alias("batch"))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in arrow:
            for part in slices(whole, "text"):
                ids, owners, keys = part.column("doc_id").to_pylist(), [], []
                for k, text in enumerate(text_bytes(part.column("text"))):
                    found = {h for line in set(text.split(b"\n")) if (h := line_key(line, min_chars))}
                    owners += [k] * len(found)
                    keys += sorted(found)
                rows = pa.array(owners, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()).take(rows), part.column("batch").take(rows)], names=["key", "doc_id", "batch"])

    return source.mapInArrow(run, "key binary, doc_id long, batch int")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, scratch: Scratch | None = None, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus n_lines and n_dropped.

    The table is dealt into ``batches`` by document, each added to the runs in
    turn, as arriving data would be; the result does not depend on their number.
    With ``runs`` the documents are new ones beside those already added there: lines
    are counted over all, and ``min_docs`` is that of the runs.
    Columns of ``docs`` named like the added ones are replaced, all others stay.
    """
    docs, back = aside(docs.drop("n_lines", "n_dropped"), doc_id, text)
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    _entries(docs, doc_id, text, min_chars, batches).hint("rebalance", "doc_id").write.partitionBy("batch").parquet(f"{scratch.path}/entries")
    entries = scratch.read("entries", "key binary, doc_id long, batch int")
    total = entries.count()
    runs = runs or LineRuns(scratch, min_docs, fanout, min(shuffle_partitions(scratch.spark), max(1, math.ceil(total / BUCKET_ENTRIES))))
    for k in range(batches):
        runs.add(entries.where(F.col("batch") == k).groupBy("key").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last")))
    common = scratch.write(runs.table().where(F.col("docs") >= runs.min_docs), "common")
    doomed = join_hot(entries, common, "key", "docs", total).where(F.col("doc_id") < F.col("last")).groupBy("doc_id").agg(F.collect_set("key").alias("__keys"))
    doomed = doomed.withColumnRenamed("doc_id", "__id")
    joined = docs.join(doomed, docs[doc_id].cast("long") == doomed["__id"], "left").drop("__id")
    schema = T.StructType([*docs.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names, out_names = docs.columns, schema.names
    at = names.index(text)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in arrow:
            for part in slices(whole, text):
                texts, lines, dropped = [], [], []
                for raw, keys in zip(part.column(text).cast(pa.binary()).to_pylist(), part.column("__keys").to_pylist(), strict=True):
                    pieces = (raw or b"").split(b"\n")
                    if keys:
                        gone = set(keys)
                        kept = [line for line in pieces if line_key(line, min_chars) not in gone]
                        raw = b"\n".join(kept)
                    else:
                        kept = pieces
                    texts.append(raw)
                    lines.append(len(pieces))
                    dropped.append(len(pieces) - len(kept))
                columns = [part.column(c) for c in names]
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=out_names)

    return joined.select(*docs.columns, "__keys").mapInArrow(run, schema).withColumnsRenamed(back)


def digests(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id < c.last, false) AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
