"""Tokens, language, neighbours, quality, mixing and shards: round trips, held-out
accuracy, recall and brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from glosswerk.llm import bpe, langid, mixing, quality, sharding, vectors
from glosswerk.llm.shared import read

SF = "/root/testdata/sf0.001"


def reference_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_are_those_of_the_rank_file(spark, docs, rows, empty):
    enc = reference_encoding()
    texts = [(r.doc_id, r.text) for r in read(spark, SF, "documents").select("doc_id", "text").collect()] + [(r[0], r[1]) for r in rows]
    texts += [(900, "<|endoftext|> a b \r\n\n  c'll DON'T 1234567 � \U0001f468‍\U0001f469‍\U0001f467"), (901, " ".join(["word", "　", "漢字かな", "a  b"] * 9000))]
    want = []
    for k, t in texts:
        ids = enc.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((k, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.digests(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digests(empty).count() == 0
    assert bpe.encode(docs, ids="score").columns[-1] == "score"


def test_offsets_and_split_characters(spark):
    text = "naïve 😀 漢字 text"
    r = bpe.decode(bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), spans=True)).first()
    assert bytes(r.decoded).decode() == text
    assert all(0 <= a < b <= len(text) for a, b in zip(r.ids_starts, r.ids_ends, strict=True))
    assert sum(1 for a, b in zip(r.ids_starts, r.ids_starts[1:], strict=False) if a == b) > 0  # a character in several ids
    part = bpe.decode(spark.createDataFrame([(r.ids[:4],)], "ids array<int>")).first()
    assert text.encode().startswith(bytes(part.decoded))


def test_language_of_held_out_documents(spark, docs, rows, empty):
    docs_ = read(spark, "/root/testdata/sf0.01", "documents")
    out = langid.digests(docs_).join(docs_.select("doc_id", "lang", "text"), "doc_id").collect()
    judged = [r for r in out if r.held_out and r.lang is not None and r.lang_pred != langid.UNKNOWN and len(r.text) >= 40]
    assert sum(r.lang == r.lang_pred for r in judged) / len(judged) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    odd = {r.doc_id: r for r in langid.digests(docs).collect() if r.doc_id is not None}
    assert len(langid.digests(docs).collect()) == len(rows)
    for k in (40, 41, 42, 45):
        assert (odd[k].lang_pred, odd[k].score) == ("und", 0.0)
    assert langid.digests(empty).count() == 0
    untaught = langid.digests(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_rows_that_repeat_a_doc_id_teach_once(spark):
    """A language of one document repeated beyond the sample is learned, whatever the partitions."""
    ids = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(ids[0], "aaa aab aba baa", "aa")] * 3000 + [(k, f"zzy zyz xxz {'y' * (k % 7)}", "zz") for k in ids[1:200]] + [(ids[3], "qqr qrq", "qq"), (ids[3], "qqq rrq", "qq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (langid.train(docs.repartition(n), max_rows=18) for n in (1, 7))  # six rows a language at most
    assert one.langs == ["aa", "qq", "zz"] and (one.weights == two.weights).all() and one.temperature == two.temperature
    assert [one.predict(t)[0] for t in ("aaa aab", "qqr qqq", "zzy xxz")] == one.langs


def test_chunks_of_a_long_text_count_as_the_whole():
    text = "Ünïcode, and some words. " * 30_000
    whole = langid.counts(text)
    old, langid.CHUNK = langid.CHUNK, 1001
    try:
        assert (langid.counts(text) == whole).all()
    finally:
        langid.CHUNK = old


def brute_nearest(rows, k=10):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    out = {}
    for q, v in zip(ids, x, strict=True):
        if q % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            out[q] = [(ids[i], float(d[i])) for i in sorted(range(len(ids)), key=lambda i: (d[i], ids[i])) if ids[i] != q][:k]
    return out


def test_neighbours_have_recall(spark):
    table = read(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.x) for r in vectors.valid(table).collect()]
    want = brute_nearest(rows)
    got = defaultdict(list)
    for r in vectors.digests(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(len(got[q]) == len(want[q]) and got[q] == sorted(got[q], key=lambda p: (p[1], p[0])) for q in want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (9, []), (200, [0.0, 0.0])]
    got = vectors.digests(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 1), (100, 2, 2), (100, 3, 0)]
    none = vectors.digests(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert none.count() == 0


def test_quality(docs, rows, empty, spark):
    got = quality.digests(docs).collect()
    assert len(got) == len(rows) and quality.digests(empty).count() == 0
    for r in got:
        if r.doc_id is None or r.doc_id in (60, 61):
            continue
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        threes = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(3)}
        ls = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(ls) - len(set(ls)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.kept and r.base_failed)
    judged = quality.judge(docs)
    assert set(docs.columns) < set(judged.columns)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_schedule_keeps_every_source_within_a_block():
    shares = [7, 1, 3, 3, 5]
    plan, total = mixing.schedule(shares), sum(shares)
    done = Counter()
    for c, k, release, deadline, slot in plan:
        assert release <= slot < deadline and k == done[c]
        done[c] += 1
        assert all(abs(done[i] - (slot + 1) * a / total) < 1 for i, a in enumerate(shares))
    assert done == dict(enumerate(shares))


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs, shares={"src0": 3, "src1": 1}, other=1, block_docs=4).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[3]) for r in rows)
    assert len({(r.slot, r.place) for r in out}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert mixing.mix(empty).count() == 0
    ordered = mixing.in_order(docs)
    assert ordered.columns == docs.columns and ordered.count() == len(rows)


def test_shards(docs, rows, empty, tmp_path):
    limit = 30_000
    out = sharding.assign(docs, limit=limit).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    for name, group in shards.items():
        assert sum(r.n_bytes for r in group) == group[0].shard_bytes and len(group) == group[0].shard_docs
        assert group[0].shard_bytes <= limit or not group[0].fits
        assert not any(other != name and other.startswith(name) for other in shards)
        if name:  # the parent was over the limit, or its split would not have been made
            assert sum(r.n_bytes for r in out if r.shard.startswith(name[:-1])) > limit
    assert sharding.assign(empty).count() == 0
    sharding.write_shards(docs, str(tmp_path / "shards"), limit=limit)
    assert docs.sparkSession.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_shards_of_any_columns_and_null_keys(spark, docs, rows, tmp_path):
    sharding.write_shards(docs.withColumnRenamed("score", "leaf").withColumnRenamed("key", "depth"), str(tmp_path / "s"), limit=20_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {"leaf", "depth", "shard"} <= set(back.columns) and back.where("doc_id IS NULL").count() == 2 and back.count() == len(rows)


def test_neighbours_over_shards_lengths_and_ties(spark):
    """Several shards and blocks, ties at rank 10, lengths searched apart, other columns."""
    r = np.random.default_rng(5)
    rows = [(k, [float(v) for v in r.integers(-1, 2, 8)]) for k in range(600)] + [(1000 + k, [float(v) for v in r.integers(-1, 2, 5)]) for k in range(150)]
    rows = [x for x in rows if any(x[1])]
    want = brute_nearest([x for x in rows if len(x[1]) == 8]) | brute_nearest([x for x in rows if len(x[1]) == 5])
    table = spark.createDataFrame([(*x, 1, "s") for x in rows], "vec_id long, embedding array<double>, query_id int, score string")
    old = vectors.SHARD_ROWS, vectors.QUERY_BLOCK
    vectors.SHARD_ROWS, vectors.QUERY_BLOCK = 100, 2
    try:
        found = vectors.search(table, table.where("vec_id % 100 = 0"), radius=vectors.BITS).orderBy("query_id", "rank").collect()
        few = vectors.search(table, table.where("vec_id % 100 = 0"), radius=0).orderBy("query_id", "rank").collect()  # the second pass
    finally:
        vectors.SHARD_ROWS, vectors.QUERY_BLOCK = old
    for out in (found, few):
        got = defaultdict(list)
        for x in out:
            got[x.query_id].append((x.vec_id, x.score))
        assert {q: [v for v, _ in g] for q, g in got.items()} == {q: [v for v, _ in w] for q, w in want.items()}


def brute_model(rows, classes):
    """A plain counter of n-grams, TF-IDF, and dense FTRL, without numpy indexing tricks."""
    import math
    import unicodedata

    def grams(text):
        s = "".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower())
        s = re.sub(" +", " ", s)
        return Counter(s[i : i + n] for n in range(1, 4) for i in range(len(s) - n + 1))

    found = [grams(t) for t, _ in rows]
    df = Counter(g for f in found for g in f)
    idf = {g: math.log((1 + len(rows)) / (1 + n)) + 1 for g, n in df.items()}
    vecs = []
    for f in found:
        v = {g: (1 + math.log(n)) * idf[g] for g, n in f.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vecs.append({g: x / size for g, x in v.items()})
    z, n = defaultdict(lambda: [0.0] * classes), defaultdict(lambda: [0.0] * classes)
    lead = lambda z, n, l1, l2: 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((langid.BETA + math.sqrt(n)) / langid.ALPHA + l2)

    def weights(g):
        l1, l2 = (0.0, 0.0) if g is None else (langid.L1, langid.L2)
        return [lead(z[g][c], n[g][c], l1, l2) for c in range(classes)]

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for r in order.permutation(len(rows)):
            w = {g: weights(g) for g in [*vecs[r], None]}
            x = {**vecs[r], None: 1.0}
            s = [sum(x[g] * w[g][c] for g in x) for c in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            p = [v / sum(e) for v in e]
            for g in x:
                for c in range(classes):
                    grad = x[g] * (p[c] - (c == rows[r][1]))
                    step = (math.sqrt(n[g][c] + grad * grad) - math.sqrt(n[g][c])) / langid.ALPHA
                    z[g][c] += grad - step * w[g][c]
                    n[g][c] += grad * grad
    return [[sum(x * weights(g)[c] for g, x in v.items()) + weights(None)[c] for c in range(classes)] for v in vecs]


def test_model_against_dense_ftrl():
    """Counts, TF-IDF and FTRL equal a slow plain version (no hash of these n-grams collides)."""
    texts = [("Der Hund und die Katze.", 0), ("the dog and the cat", 1), ("le chien et le chat, été", 2), ("und der das die", 0), ("and the of to", 1), ("et les des aux", 2)]
    found = [langid.counts(t) for t, _ in texts]
    df = sum((f > 0).astype(int) for f in found)
    model = langid.Model(["de", "en", "fr"], np.log((1 + len(texts)) / (1 + df)) + 1, None, None)
    rows = [(*model.features(f), y) for f, (_, y) in zip(found, texts, strict=True)]
    model.weights, model.bias = langid.ftrl(rows, 3)
    got = np.array([x @ model.weights[i] + model.bias for i, x, _ in rows])
    assert np.allclose(got, brute_model(texts, 3), atol=1e-9)
    assert (got.argmax(axis=1) == [y for _, y in texts]).all()
