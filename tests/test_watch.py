"""The watch against a full audit after every batch: versions, retractions, restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glosswerk.operators import bibliography, citations
from glosswerk.streaming import watch as W

SCHEMA = "file string, content string, modified timestamp"
BIB = "id string, authors array<string>, year int, doi string, pos long"
START = datetime(2026, 1, 1)


class Watched:
    """A folder of arriving files; every ``batch`` is a run of the stream of its own, on the
    checkpoint of the one before."""

    def __init__(self, spark, path, bib):
        self.spark, self.path, self.newest = spark, path, {}
        self.bib = spark.createDataFrame(bib, BIB)
        spark.conf.set("spark.sql.shuffle.partitions", 2)

    def batch(self, *rows):
        """rows: (file, content, hours)"""
        rows = [(f, c, START + timedelta(hours=h)) for f, c, h in rows]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        files = self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in")
        W.watch(self.spark, files, self.bib, f"{self.path}/out", f"{self.path}/cp").awaitTermination(120)
        for f, c, m in rows:
            self.newest[f] = max(self.newest.get(f, (m, "")), (m, c or ""))
        return self.current()

    def current(self):
        return sorted((r.type, r.citation, r.file, r.bib_entries) for r in W.current(self.spark, f"{self.path}/out").collect())

    def audited(self):
        """The same by an audit of all newest versions at once."""
        order = sorted(self.newest, key=lambda f: (self.newest[f][0], f))
        files = self.spark.createDataFrame([(f, self.newest[f][1]) for f in order], "file string, content string")
        rank = F.create_map(*(x for k, f in enumerate(order, 1) for x in (F.lit(f), F.lit(k))))
        own = bibliography.normalise(bibliography.parse(files), "file")
        own = own.withColumn("pos", F.col("pos") + rank[F.col("file")] * bibliography.SOURCE)
        # entries stand where their last source has them
        every = self.bib.unionByName(own.select(self.bib.columns))
        last = every.groupBy("id").agg(F.max_by(F.struct("authors", "year", "doi", "pos"), "pos").alias("e")).select("id", "e.*")
        found = [(r.type, r.citation, r.file, r.bib_entries) for r in citations.issues(citations.audit(files, last)).collect()]
        within = own.groupBy("file", "id").agg(F.max_by("doi", "pos").alias("doi"), F.count("*").alias("n"))
        found += [("missing_doi", r.id, r.file, None) for r in within.where("doi IS NULL").collect()]
        return sorted(found)


@pytest.fixture
def watched(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda bib: Watched(spark, str(tmp_path), bib)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_three_batches_out_of_order_with_restarts(watched):
    w = watched([("s", ["Smith, J."], 2010, None, 0)])
    got = w.batch(("a", "Smith (2010) Lee (2011) Roe (2012)", 1), ("b", "Lee (2011)", 1))
    assert got == [("orphan", "Lee (2011)", "a", None), ("orphan", "Lee (2011)", "b", None), ("orphan", "Roe (2012)", "a", None)] == w.audited()
    # an entry elsewhere clears both orphans, and a second one makes Smith ambiguous
    got = w.batch(("refs", "@misc{l, author={Lee, K.}, year={2011}, doi={10.1/l}} @misc{t, author={Smith, K.}, year={2010}}", 2))
    assert got == [("ambiguous", "Smith (2010)", "a", ["s", "t"]), ("missing_doi", "t", "refs", None), ("orphan", "Roe (2012)", "a", None)] == w.audited()
    # an old version comes late and is ignored; the entry file loses an entry; a is rewritten
    got = w.batch(("refs", "@misc{r, author={Roe, R.}, year={2012}}", 0), ("refs", "@misc{t, author={Smith, K.}, year={2010}, doi={10.1/t}}", 3), ("a", "Smith & Lee (2010)", 4))
    assert got == [("ambiguous", "Smith & Lee (2010)", "a", ["s", "t"]), ("orphan", "Lee (2011)", "b", None)] == w.audited()


def test_newest_of_two_versions_in_a_batch_counts(watched):
    w = watched([])
    assert w.batch(("a", "Roe (2012)", 5), ("a", "Lee (2011)", 9), ("a", "Doe (2013)", 7)) == [("orphan", "Lee (2011)", "a", None)]
    assert w.batch(("a", None, 10)) == []


def test_an_id_defined_again_moves(watched):
    """The file modified last wins an id, and the given bibliography comes first."""
    w = watched([("k", ["Roe, R."], 2012, None, 1)])
    assert w.batch(("a", "Roe (2012) Lee (2011)", 1)) == [("orphan", "Lee (2011)", "a", None)]
    assert w.batch(("refs", "@misc{k, author={Lee, K.}, year={2011}, doi={10.1/k}}", 2)) == [("orphan", "Roe (2012)", "a", None)] == w.audited()
    assert w.batch(("more", "@misc{k, author={Roe, K.}, year={2012}, doi={10.1/k}}", 1)) == [("orphan", "Roe (2012)", "a", None)] == w.audited()
    assert w.batch(("refs", "", 3)) == [("orphan", "Lee (2011)", "a", None)] == w.audited()
    assert w.batch(("more", None, 4)) == [("orphan", "Lee (2011)", "a", None)] == w.audited()


def test_any_order_ends_like_a_full_audit(watched):
    r = random.Random(6)
    names, years = ["Smith", "Lee", "Roe"], [2010, 2011]
    w = watched([("s", ["Smith, J."], 2010, None, 0), ("l", ["Lee, J."], 2011, "10.1/l", 1)])
    for _ in range(4):
        rows = []
        for _ in range(8):
            text = " ".join(f"{r.choice(names)}{r.choice(['', ' et al.'])} ({r.choice(years)})" for _ in range(r.randrange(4)))
            text += " ".join(f"@misc{{{r.choice('slxy')}, author={{{r.choice(names)}, Q.}}, year={{{r.choice(years)}}}{r.choice(['', ', doi={10.1/z}'])}}}" for _ in range(r.randrange(3)))
            rows.append((r.choice("abcde"), text, r.randrange(60)))
        assert w.batch(*rows) == w.audited()
