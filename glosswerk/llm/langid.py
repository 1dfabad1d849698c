"""Language identification: sparse multinomial logistic regression on TF-IDF
weighted character n-grams, trained by follow-the-regularised-leader with
elastic-net penalties, then calibrated by a temperature.

A text is lower-cased, everything but letters becomes a space and runs of spaces
collapse; n-grams of 1 to 3 characters are hashed to ``DIMS`` features.  Document
frequencies are counted over all training documents.  The weights are fitted on a
bounded sample of labelled documents (``MAX_ROWS``, shared evenly by the
languages, smallest hashes first; rows equal in id, language and text once), a fifth of
which only sets the temperature.

Odd input: a text that is null or has no letter is ``und`` with score 0, as is
every text where no labelled document is left to learn from; documents with null
``lang`` or null ``doc_id`` are predicted but teach nothing; rows that repeat a ``doc_id``
each count in document frequencies.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswerk.llm.shared import slices

ORDERS = 3
DIMS = 1 << 15
MAX_ROWS = 3000
EPOCHS = 4
#: Learning rate and smoothing of the leader's per-feature steps; L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: Texts are turned into n-grams this many characters at a time.
CHUNK = 1 << 18
UNKNOWN = "und"
#: Odd multipliers of the n-gram hash, one for each place.
MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: is it a letter (any Unicode category L)?"""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=np.bool_)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, None without a letter."""
    out, some, tail = np.zeros(DIMS, np.int64), False, np.empty(0, np.uint32)
    for at in range(0, len(text or ""), CHUNK):
        code = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters()[code]
        some = some or bool(is_letter.any())
        code = np.concatenate([tail, np.where(is_letter, code, 32)])
        code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
        h, hashed = np.zeros(len(code), np.uint32), []
        for n in range(ORDERS):
            h = h[: len(code) - n] + code[n:] * MIX[n]
            new = h[max(0, len(tail) - n) :]  # n-grams that end in this chunk
            mixed = (new ^ (new >> np.uint32(15))) * MIX[(n + 1) % ORDERS]
            hashed.append(mixed >> np.uint32(17))
        out += np.bincount(np.concatenate(hashed), minlength=DIMS)
        tail = code[max(0, len(code) - ORDERS + 1) :]
    return out if some else None


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = np.flatnonzero(found)
        x = (1 + np.log(found[index])) * self.idf[index]
        return index, x / max(float(np.linalg.norm(x)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        index, x = self.features(found)
        p = softmax((x @ self.weights[index] + self.bias) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal weights (DIMS x classes) and bias; the bias has no penalty."""
    z, n = np.zeros((DIMS, classes)), np.zeros((DIMS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def leader(z, n, l1, l2):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            index, x, y = rows[r]
            w, b = leader(z[index], n[index], L1, L2), leader(zb, nb, 0.0, 0.0)
            err = softmax(x @ w + b)
            err[y] -= 1
            g = x[:, None] * err
            for zz, nn, ww, gg, at in ((z, n, w, g, index), (zb, nb, b, err, slice(None))):
                step = (np.sqrt(nn[at] + gg * gg) - np.sqrt(nn[at])) / ALPHA
                zz[at] += gg - step * ww
                nn[at] += gg * gg
    return leader(z, n, L1, L2), leader(zb, nb, 0.0, 0.0)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    """Temperature of least log loss, by golden section on its logarithm."""
    if not rows:
        return 1.0
    logits = np.array([x @ model.weights[i] + model.bias for i, x, _ in rows])
    true = np.array([y for _, _, y in rows])

    def loss(log_t: float) -> float:
        s = logits / math.exp(log_t)
        s -= s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), true]))

    low, high, g = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the documents that are not held out and have a language.

    To the driver come at most 64 vectors of document frequencies and the features of
    at most ``max_rows`` documents (``DIMS`` entries each at most).  Each language
    takes one of these at least, so of more than ``max_rows`` languages the most
    frequent are learned.
    """
    taught = docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id) & F.col(lang).isNotNull()).select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("digest"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for t in (t for part in slices(batch, "text") for t in part.column("text").to_pylist()):
                if (found := counts(t)) is not None:
                    total[:DIMS] += found > 0
                    total[DIMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total += np.frombuffer(v, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    vectors = taught.select("text").mapInArrow(frequencies, "v binary").repartition(64).mapInArrow(added, "v binary")
    df = sum((np.frombuffer(r.v, np.int64) for r in vectors.toLocalIterator()), start=np.zeros(DIMS + 1, np.int64))
    # Hashes are of ids, so a language's share of them depends on how many different ones it has.
    counted = taught.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids"))
    sizes = {r.lang: max(1, r.ids) for r in counted.orderBy(F.desc("n"), "lang").limit(max_rows).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(DIMS), np.zeros((DIMS, 0)), np.zeros(0))
    # Only hashes below a bound that about three times the quota reach are ranked at all.
    quota = max(1, max_rows // len(langs))
    bounds = docs.sparkSession.createDataFrame([(k, (min(1.0, (3 * quota + 30) / n) * 2 - 1) * 2.0**63) for k, n in sizes.items()], "lang string, bound double")
    small = taught.select("id", "lang", "digest").join(F.broadcast(bounds), "lang").where(F.xxhash64("id") <= F.col("bound")).select("id", "lang", "digest").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "digest"))
    chosen = small.withColumn("nth", nth).where(F.col("nth") <= quota).select("id", "lang", "digest")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                packed: tuple[list, list] = ([], [])
                for found in map(counts, part.column("text").to_pylist()):
                    index = None if found is None else np.flatnonzero(found)
                    packed[0].append(None if found is None else index.astype(np.uint32).tobytes())
                    packed[1].append(None if found is None else found[index].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "lang", "digest")), *(pa.array(p, pa.binary()) for p in packed)], names=["id", "lang", "digest", "features", "found"])

    sample = taught.join(F.broadcast(chosen), ["id", "lang", "digest"], "left_semi").mapInArrow(featured, "id string, lang string, digest long, features binary, found binary").where("features IS NOT NULL").dropDuplicates(["id", "lang", "digest"])
    model = Model(langs, np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1, np.zeros((DIMS, len(langs))), np.zeros(len(langs)))
    rows = []
    for r in sorted(sample.collect(), key=lambda r: (r.id, r.lang, r.digest)):
        dense = np.zeros(DIMS, np.int64)
        dense[np.frombuffer(r.features, np.uint32)] = np.frombuffer(r.found, np.uint32)
        rows.append((*model.features(dense), langs.index(r.lang)))
    teaching = [r for k, r in enumerate(rows) if k % 5]
    seen = {y for _, _, y in teaching}
    teaching += [r for r in rows[::5] if r[2] not in seen]  # or their languages would not be learned
    model.weights, model.bias = ftrl(teaching, len(langs))
    model.temperature = calibrate(model, rows[::5])
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (calibrated probability of lang_pred).

    Reads the text alone.  The model has a fixed number of features for each
    language and is broadcast.  Columns named like the added ones are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = [shared.value.predict(t) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    model = train(docs)
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
