"""Ranked search against the formula in plain Python, with odd rows, many shards and blocks."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from glosswerk.llm import lexical
from glosswerk.llm.shared import Scratch

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(words(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, query in asked.items():
        found = []
        for (d, b), s in zip(bags, sizes, strict=True):
            score = 0
            for t, times in query.items():
                if b[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * (25 + (75 * s * n) // length)))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def items():
    return [(1, "lorem1 Lorem1 ipsum2, dolor3 héllo"), (2, "the0 of1 and2 漢字"), (3, ""), (4, None), (5, "... !!"), (6, "nowhere_at_all-1x2y3z"), (7, "lorem1"), (7, "ipsum2 lorem1"), (None, "sit4 x"), (8, "The0 the0 THE0")]


@pytest.mark.parametrize("docs_a_shard, items_a_block", [(1 << 15, 1024), (3, 2)])
def test_against_the_formula(spark, rows, docs, empty, items, monkeypatch, docs_a_shard, items_a_block):
    monkeypatch.setattr(lexical, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items_a_block)
    asked = spark.createDataFrame([(*i, "a", 1) for i in items], "item_id long, text string, doc_id string, term int")
    assert rows_of(lexical.rank(docs, asked)) == brute([(r[0], r[1]) for r in rows], items)
    if items_a_block == 2:
        assert lexical.rank(empty, asked).count() == 0 and lexical.rank(docs, asked.limit(0)).count() == 0
        assert lexical.rank(empty, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_sql_on_odd_rows(spark, rows, docs, items):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in rows])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({lexical.ORACLE})").fetchall()
    assert sorted(want, key=repr) == brute([(r[0], r[1]) for r in rows], items)


def test_ties_go_to_the_smaller_id_across_shards(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 4)
    docs = [(k, "same text here") for k in random.Random(1).sample(range(500), 60)] + [(1000 + k, f"other{k} words") for k in range(60)]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame([("a", "text")], "item_id string, text string"))
    assert rows_of(got) == brute(docs, [("a", "text")])


def test_top_keeps_all_that_tie():
    r = np.random.default_rng(0)
    for _ in range(300):
        n = r.integers(1, 40)
        scores, ids, last = r.integers(0, 4, n), r.permutation(n), r.random(n) < 0.1
        want = sorted((k for k in range(n) if scores[k] > 0), key=lambda k: (-scores[k], last[k], ids[k]))[:5]
        assert lexical.top(scores, ids, last, 5).tolist() == want


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 50)
    for text in ("ab cd " * 500, "x" * 3000, "é漢 " * 400, "a" * 60 + " " + "b" * 10, " " * 500 + "z"):
        assert [w.decode() for part in lexical.terms(text.encode()) for w in part] == words(text)
    monkeypatch.undo()
    docs = [(1, "alpha beta " * 500_000), (2, "gamma" * 1_000_000), (3, "alpha gamma")]
    items = [(1, "alpha"), (2, "gamma beta")]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == brute(docs, items)


def test_an_index_serves_several_searches(spark, rows, docs, items):
    scratch = Scratch(spark, "lexical")
    index = lexical.Index.build(docs, scratch)
    plain = [(r[0], r[1]) for r in rows]
    for k, asked in enumerate((items[:2], items[6:])):
        df = spark.createDataFrame(asked, "item_id long, text string")
        assert rows_of(index.search(df, Scratch(spark, f"search{k}"), k=3)) == brute(plain, asked, 3)
