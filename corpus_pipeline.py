"""Corpus pipeline: five stages over ``documents``, each written as Parquet and
reread as the input of the next.

Every stage works on all that its predecessor kept and returns the columns of
``documents``; the last adds the token ids and each row's turn in the mixture (slot,
place), by which its rows are sorted.  Extra columns pass through unchanged,
except that the last stage's own ones replace columns of the same names.

Null and empty texts have no language and go with the first stage; nulls in other
columns stay as they are.  Rows that repeat a ``doc_id`` are documents of their own to
the first stage, one document to line and near dedup, and share a turn in the mixture.
Very long texts are read whole, one at a time.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswerk.llm import bpe, langid, lines, mixing, neardup
from glosswerk.llm.shared import WS, Scratch, aside, limit_batches, read

OWN = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less certain than this are rejected, as is ``und``.
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language of ``MIN_SCORE``.

    ``lang`` stays as it was given.  Where nothing can be learned (no document has
    a language) every document is rejected as unknown.
    """
    limit_batches(spark)
    docs, back = aside(docs, *OWN)
    judged = langid.predict(docs, langid.train(docs))
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns).withColumnsRenamed(back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of ``text``; ``n_chars`` follows the new text.

    A document that loses lines and keeps nothing but white space goes, as all it said
    stays in other documents; any other keeps its row, however little is left of it.
    """
    docs, back = aside(docs, *OWN)
    blank = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(WS)) == "")
    out = lines.dedup(docs).where(~F.coalesce(blank, F.lit(False))).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns).withColumnsRenamed(back)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mixture: files in order of their names,
    and rows within them, follow the schedule.  No document is dropped."""
    return mixing.in_order(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot, place, ids, n_tokens and round_trip (do the decoded bytes equal the
    text?), in the order of (slot, place).

    Spark reads files in an order of its own, so the turns are worked out from the
    documents again; they are those that ``mix_sources`` wrote by, as it drops none.
    """
    docs = mixing.placed(docs.drop("ids", "n_tokens", "round_trip"))
    docs, back = aside(docs, *OWN, "slot", "place")
    coded = bpe.encode(docs, decoded="decoded")
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip")).withColumnsRenamed(back)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("byte_bpe", encode_text),
]

#: SQL cannot express the trained language model; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
