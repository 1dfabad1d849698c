"""Texts of five megabytes, with words and lines and without a space, through every operator on texts."""

import hashlib
import random

import pytest

from glosswerk.llm import bpe, lines, neardup, quality, substrings, suffixes

SIZE = 5_000_000


@pytest.fixture(scope="module")
def long_docs(spark):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(3, 9))) for _ in range(20_000)]
    prose = " ".join(r.choices(words, k=SIZE // 7))
    solid = "".join(r.choices("abcdefghijklmnop", k=SIZE))
    texts = {1: prose, 2: prose, 3: f"{prose} one more", 4: solid, 5: solid, 6: solid, 7: f"{prose[:1000]}\nother"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(7)
    return texts, df


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_lines(long_docs):
    texts, df = long_docs
    got = by_id(lines.digests(df))
    assert {k: r.n_dropped for k, r in got.items()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 0, 7: 0}
    assert got[4].kept_sha256 == sha("") and got[6].kept_sha256 == sha(texts[6])


def test_substrings(long_docs):
    texts, df = long_docs
    got = by_id(substrings.digests(df))
    assert [got[k].kept_sha256 for k in (1, 2, 4, 5)] == [sha(texts[1]), sha(""), sha(texts[4]), sha("")]
    assert got[3].kept_sha256 == sha(texts[3])  # a line and a unit of its own


def test_near_duplicates(long_docs):
    _, df = long_docs
    assert {k: r.component_id for k, r in by_id(neardup.classes(df)).items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7}


def test_suffixes(long_docs):
    texts, df = long_docs
    got = by_id(suffixes.digests(df))
    assert {k: r.n_removed for k, r in got.items()} == {1: len(texts[1]), 2: len(texts[1]), 3: len(texts[1]), 4: SIZE, 5: SIZE, 6: SIZE, 7: 1000}


def test_quality(long_docs):
    texts, df = long_docs
    got = by_id(quality.digests(df))
    assert {k: (r.n_words, r.word_chars) for k, r in got.items()} == {k: (len(t.split()), sum(map(len, t.split()))) for k, t in texts.items()}


def test_byte_bpe(long_docs):
    texts, df = long_docs
    got = by_id(bpe.digests(df.where("doc_id IN (1, 4)")))
    assert {k: r.decoded_sha256 for k, r in got.items()} == {k: sha(texts[k]) for k in (1, 4)}
