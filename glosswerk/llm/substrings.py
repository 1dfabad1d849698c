"""Substring dedup by hashing lines, and the sentence-like units within them.

Lines (up to and with their ``\\n``) are normalised (A-Z in lower case, white space
``[\\x20\\x09-\\x0D]`` collapsed and stripped) and hashed to 128 bits; digests are
grouped over the whole corpus.  Occurrences rank by (doc_id, digest of the text, place
in the text): the first stays, and every later one of a line of ``min_chars``
characters or more is removed, however few its words.

Passages that many documents share seldom begin and end with a line, so finer units
are hashed alike: a unit runs up to and including the next ``.``, ``!``, ``?`` or line
end (and any of these right after it), so the units of a text joined give the text
back.  Consecutive repeated units form a stretch, and one of ``min_words`` words or
more is removed; chance repeats of short sentences within a line stay.  With
``min_words=None`` lines alone count, with ``min_chars=None`` stretches alone.  A line's
first occurrence holds its units, so no text loses its first occurrence by either.

Odd input: null or empty texts have no units; units and lines without a word have no
digest and never repeat; a null ``doc_id`` takes no part; rows that repeat a ``doc_id``
are documents of their own, ranked by a digest of their texts.  Of rows equal in doc_id and
text one is the first, whichever Spark numbers first, and all of every other one
repeats it.  Very long texts are hashed whole, one at a time.  An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswerk.llm.shared import Scratch, aside, join_hot, slices, text_bytes

#: Fewest words of a repeated stretch of units that is removed.
MIN_WORDS = 20
#: Fewest characters of a normalised line that is removed where it is repeated.
MIN_CHARS = 20
#: Places from here on count lines, those below it units.
LINE = 1 << 30
UNIT = re.compile(rb"[^.!?\n]+[.!?\n]*|[.!?\n]+")
LINES = re.compile(rb"[^\n]*\n|[^\n]+")


def units(text: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """Digest (b'' without a word), words, first byte and end of each unit."""
    for m in UNIT.finditer(text):
        words = m[0].lower().split()
        yield (xxhash.xxh3_128_digest(b" ".join(words)) if words else b""), len(words), m.start(), m.end()


def lines(text: bytes, min_chars: int) -> Iterator[tuple[bytes, int, int]]:
    """Digest (b'' if shorter than ``min_chars``), first byte and end of each line;
    the digest is never a unit's, as no unit begins with a line end when normalised."""
    at = 0
    for line in LINES.findall(text):
        key = b" ".join(line.lower().split())
        yield (xxhash.xxh3_128_digest(b"\n" + key) if key and len(key.decode()) >= min_chars else b""), at, at + len(line)
        at += len(line)


def _all_places(text: bytes, min_words: int | None, min_chars: int | None) -> list[int]:
    found = [n for n, u in enumerate(units(text)) if u[0]] if min_words is not None else []
    return found + ([LINE + n for n, x in enumerate(lines(text, min_chars)) if x[0]] if min_chars is not None else [])


def _entries(docs: DataFrame, min_words: int | None, min_chars: int | None) -> DataFrame:
    """key, doc_id, digest, place of the units and lines of (doc_id, digest, text)."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in arrow:
            for part in slices(whole, "text"):
                owners, keys, places = [], [], []
                for k, text in enumerate(text_bytes(part.column("text"))):
                    found = [(u[0], n) for n, u in enumerate(units(text)) if u[0]] if min_words is not None else []
                    if min_chars is not None:
                        found += [(x[0], LINE + n) for n, x in enumerate(lines(text, min_chars)) if x[0]]
                    owners += [k] * len(found)
                    keys += [x for x, _ in found]
                    places += [n for _, n in found]
                rows = pa.array(owners, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column("doc_id").take(rows), part.column("digest").take(rows), pa.array(places, pa.int32())], names=["key", "doc_id", "digest", "place"])

    return docs.mapInArrow(run, "key binary, doc_id long, digest long, place int")


def text_digest(text: str) -> Column:
    """60 bits of a text's MD5, which SQL can compute as well."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _later_copies(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """``docs`` with ``__copy``: is the row equal to an earlier one in doc_id and text?

    Rows that have an equal are few as a rule; they are written with a number, so that
    it stays what it is, and the least number of each group is kept.
    """
    keyed = docs.withColumns({"__d": docs[doc_id].cast("long"), "__t": text_digest(text)})
    many = scratch.write(keyed.where("__d IS NOT NULL AND __t IS NOT NULL").groupBy("__d", "__t").count().where("count > 1").select("__d", "__t"), "equal")
    if not many.take(1):
        return docs.withColumn("__copy", F.lit(False))
    same = ["__d", "__t"]
    numbered = scratch.write(keyed.join(many, same, "left_semi").withColumn("__row", F.monotonically_increasing_id()), "copies")
    first = numbered.groupBy(same).agg(F.min("__row").alias("__first"))
    copies = numbered.join(first, same).withColumn("__copy", F.col("__row") != F.col("__first"))
    single = keyed.join(many, same, "left_anti").withColumn("__copy", F.lit(False))
    return single.unionByName(copies.select(single.columns)).drop(*same)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int | None = MIN_WORDS, min_chars: int | None = MIN_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with repeated lines and stretches taken out of ``text``.

    Adds n_units, n_removed (units in removed stretches), n_lines_removed and spans,
    what was removed as code point offsets (end exclusive) into the original text.
    Columns of ``docs`` named like these are replaced, all others stay.
    """
    docs, back = aside(docs.drop("n_units", "n_removed", "n_lines_removed", "spans"), doc_id, text)
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    docs = _later_copies(docs, doc_id, text, scratch)
    digest = text_digest(text).alias("digest")
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), digest, F.col(text).alias("text"))
    entries = scratch.write(_entries(source, min_words, min_chars), "entries")
    order = F.struct("doc_id", "digest", "place")
    first = entries.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = join_hot(entries, scratch.write(first, "first"), "key", "n", entries.count()).where(order != F.col("first"))
    places = repeats.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.collect_set("place").alias("__places"))
    mine = (docs[doc_id].cast("long") == places["__id"]) & (text_digest(text) == places["__digest"])
    joined = docs.join(places, mine, "left").select(*docs.columns, "__places")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    counts = ("n_units", "n_removed", "n_lines_removed")
    docs = docs.drop("__copy")
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in counts), T.StructField("spans", span)])
    names, out_names = docs.columns, schema.names
    at = names.index(text)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in arrow:
            for part in slices(whole, text):
                texts, numbers, spans = [], [], []
                for raw, places, copy in zip(part.column(text).cast(pa.binary()).to_pylist(), part.column("__places").to_pylist(), part.column("__copy").to_pylist(), strict=True):
                    if copy and raw:
                        places = _all_places(raw, min_words, min_chars)
                    if places:
                        raw, *found, cuts = cut(raw, set(places), min_words, min_chars)
                    else:
                        found, cuts = (sum(1 for _ in UNIT.finditer(raw or b"")), 0, 0), []
                    texts.append(raw)
                    numbers.append(found)
                    spans.append([{"start": a, "end": b} for a, b in cuts])
                columns = [part.column(c) for c in names]
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([n[k] for n in numbers], pa.int64()) for k in range(3)), pa.array(spans, kind)], names=out_names)

    return joined.mapInArrow(run, schema).withColumnsRenamed(back)


def cut(text: bytes, repeats: set[int], min_words: int | None, min_chars: int | None) -> tuple[bytes, int, int, int, list[tuple[int, int]]]:
    """Kept bytes, number of units, of units in removed stretches, of removed lines, and
    removed code point spans."""
    found, parts, gone, k = list(units(text)), [], 0, 0
    while min_words is not None and k < len(found):
        end = k
        while end < len(found) and end in repeats:
            end += 1
        if end > k and sum(u[1] for u in found[k:end]) >= min_words:
            parts.append((found[k][2], found[end - 1][3]))
            gone += end - k
        k = end + 1
    doomed = [(a, b) for n, (_, a, b) in enumerate(lines(text, min_chars)) if LINE + n in repeats] if min_chars is not None else []
    merged: list[list[int]] = []
    for a, b in sorted(parts + doomed):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    kept, spans, at, chars = [], [], 0, 0
    for a, b in merged:
        kept.append(text[at:a])
        start = chars + len(kept[-1].decode())
        chars = start + len(text[a:b].decode())
        spans.append((start, chars))
        at = b
    return b"".join(kept) + text[at:], len(found), gone, len(doomed), spans


def digests(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("doc_id", "n_units", "n_removed", "n_lines_removed", F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def _units_sql(name: str, pattern: str, key: str) -> str:
    """SQL of ``name``: row, doc_id, u, place, key, pos (code points before) and nth of each unit."""
    return f"""
{name}_split AS (SELECT r, doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS us FROM numbered),
{name}_raw AS (SELECT r, doc_id, unnest(us) AS u, unnest(range(len(us))) AS place FROM {name}_split),
{name}_norm AS (
  SELECT *, trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS key FROM {name}_raw),
{name} AS (
  SELECT *, coalesce(sum(length(u)) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
         CASE WHEN doc_id IS NOT NULL AND {key} THEN row_number() OVER (PARTITION BY key ORDER BY r, place) ELSE 1 END AS nth
  FROM {name}_norm)"""


ORACLE = f"""
WITH numbered AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(text)[:15]) AS r, doc_id, text FROM documents),
{_units_sql("units", "[^.!?\\n]+[.!?\\n]*|[.!?\\n]+", "key <> ''")},
{_units_sql("lines", "[^\\n]*\\n|[^\\n]+", f"key <> '' AND length(key) >= {MIN_CHARS}")},
islands AS (
  SELECT *, CASE WHEN key = '' THEN 0 ELSE len(string_split(key, ' ')) END AS words,
         sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY place) AS island FROM units),
stretches AS (
  SELECT r, min(pos) AS a, max(pos + length(u)) AS b, count(*) AS n
  FROM islands WHERE nth > 1 GROUP BY r, island HAVING sum(words) >= {MIN_WORDS}),
doomed AS (SELECT r, pos AS a, pos + length(u) AS b FROM lines WHERE nth > 1),
parts AS (SELECT r, a, b FROM stretches UNION ALL SELECT r, a, b FROM doomed),
reach AS (SELECT *, max(b) OVER (PARTITION BY r ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM parts),
spread AS (SELECT *, sum(CASE WHEN a <= far THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS span FROM reach),
gone AS (SELECT r, min(a)::BIGINT AS a, max(b)::BIGINT AS b FROM spread GROUP BY r, span),
pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM gone),
cuts AS (
  SELECT p.r, count(*) AS n_spans, string_agg(a || '-' || b, ',' ORDER BY a) AS spans,
         string_agg(substr(text, since + 1, a - since), '' ORDER BY a) || substr(any_value(text), max(b) + 1) AS kept
  FROM pieces p JOIN numbered d USING (r) GROUP BY p.r),
many AS (SELECT r, count(*) AS n FROM units GROUP BY r),
stretched AS (SELECT r, sum(n) AS n FROM stretches GROUP BY r),
lined AS (SELECT r, count(*) AS n FROM doomed GROUP BY r)
SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_units, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(l.n, 0)::BIGINT AS n_lines_removed,
       coalesce(c.n_spans, 0)::BIGINT AS n_spans, coalesce(c.spans, '') AS spans, sha256(coalesce(c.kept, d.text, '')) AS kept_sha256
FROM numbered d LEFT JOIN many m USING (r) LEFT JOIN stretched s USING (r) LEFT JOIN lined l USING (r) LEFT JOIN cuts c USING (r)
"""
