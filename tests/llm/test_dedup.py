"""Line, substring, near-duplicate and suffix dedup against brute force, odd rows included."""

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from glosswerk.llm import lines, neardup, substrings, suffixes

WS = " \t\n\x0b\x0c\r"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_lines(docs, rows, empty):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    key = lambda x: lower(x.strip(WS))
    held = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(line)) >= 20:
                held[key(line)].add(r[0])
    want = []
    for r in rows:
        all_ = (r[1] or "").split("\n")
        kept = [x for x in all_ if r[0] is None or len(held[key(x)]) < 3 or r[0] == max(held[key(x)])]
        want.append((r[0], len(all_), len(all_) - len(kept), sha("\n".join(kept).encode())))
    assert sorted(map(tuple, lines.digests(docs).collect()), key=repr) == sorted(want, key=repr)
    assert lines.digests(empty).count() == 0
    assert any(w[2] for w in want)
    whole = lines.dedup(docs)
    assert whole.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert whole.where("key = 'z' AND __id = 2").count() == len(rows)


def test_lines_do_not_depend_on_batches(docs):
    one, seven = (sorted(map(tuple, lines.dedup(docs, batches=b, fanout=f).select("doc_id", "text", "n_dropped").collect()), key=repr) for b, f in ((1, 2), (7, 3)))
    assert one == seven


def test_runs_are_taken_up_by_a_later_session(spark):
    """Two jobs: the second sees the lines of the first, and moves none of its runs."""
    line = "A line that many documents share."
    rows = [(k, f"{line}\nown line of document {k} alone") for k in range(12)]
    first, second = spark.createDataFrame(rows[:6], "doc_id long, text string"), rows[6:]
    runs = lines.LineRuns(lines.Scratch(spark, "kept"))
    lines.dedup(first, runs=runs).collect()
    other = spark.newSession()
    again = lines.LineRuns.open(other, runs.scratch.path)
    assert again.levels == runs.levels and again.buckets == runs.buckets
    keys = other.createDataFrame([(lines.line_key(line.encode(), 20), 1, 3), (b"new", 1, 3)], "key binary, docs long, last long").groupBy("key").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
    plan = again.unsettled(keys)
    assert [r.key for r in plan.collect()] == [b"new"]
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = again.unsettled(keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        other.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs_read = text.count("FileScan")
    assert runs_read == len(again._names()) and text.count("Exchange") <= 1  # that of the batch's own grouping
    out = {r.doc_id: r.text for r in lines.dedup(other.createDataFrame(second, "doc_id long, text string"), runs=again).collect()}
    assert out == {k: f"{line}\nown line of document {k} alone" if k == 11 else f"own line of document {k} alone" for k in range(6, 12)}


def test_few_lines_make_few_files(spark):
    """However many shuffle partitions and input tasks there are, and where a session takes up
    runs that were dealt out otherwise."""
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", 40)
    line = "A line that many documents share."
    rows = [(k, "\n".join([line, *(f"own line {j} of document {k} alone" for j in range(20))])) for k in range(90)]
    first, second = (other.createDataFrame(x, "doc_id long, text string").repartition(16) for x in (rows[:60], rows[60:]))
    made = lambda path: sorted(str(p.relative_to(path)) for p in Path(path).rglob("*.parquet"))
    scratch = lines.Scratch(other, "few")
    got = {r.doc_id: r.n_dropped for r in lines.dedup(first, scratch=scratch).collect()}
    assert got == {k: int(k < 59) for k in range(60)}
    files = made(scratch.path)
    assert sum(f.startswith("entries/") for f in files) <= lines.BATCHES
    assert len([f for f in files if f.startswith("run")]) == 1
    third, kept = spark.newSession(), lines.Scratch(other, "kept")  # other: 40 shuffle partitions, third: 4
    runs = lines.LineRuns(kept, buckets=3)
    lines.dedup(first, runs=runs).collect()
    for session, docs in ((other, second), (third, third.createDataFrame(rows[60:], "doc_id long, text string"))):
        again = lines.LineRuns.open(session, kept.path)
        again.add(lines._entries(docs, "doc_id", "text", 20, 1).groupBy("key").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last")))
        for name in again._names():
            assert len([f for f in made(kept.path) if f.startswith(f"{name}/")]) <= 3
        assert {r.docs >= 60 for r in again.table().where(F.col("last") == 89).where(F.col("docs") > 2).collect()} == {True}


def brute_substrings(rows, min_words=20, min_chars=20):
    """(kept text, n_removed, n_lines_removed) of each row, by dictionaries of first places."""
    key = lambda x: b" ".join(x.encode().lower().split()).decode()
    unit = lambda t: [(m[0], *m.span()) for m in re.finditer(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", t or "")]
    line = lambda t: [(m[0], *m.span()) for m in re.finditer(r"[^\n]*\n|[^\n]+", t or "")]
    texts = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}, key=lambda r: (r[0], DIGESTS[r[1]]))
    first = {}
    for doc_id, text in texts:
        for kind, found in ((0, unit(text)), (1, line(text))):
            for n, (x, _, _) in enumerate(found):
                first.setdefault((kind, key(x)), (doc_id, text, n))
    out, seen = [], set()
    for r in rows:
        doc_id, text, gone = r[0], r[1] or "", set()
        copy = (doc_id, text) in seen
        seen.add((doc_id, text))
        again = lambda kind, n, x: bool(key(x)) and doc_id is not None and (copy or first[kind, key(x)] != (doc_id, text, n))  # noqa: E731, B023
        n_removed, n_lines, held = 0, 0, []
        for n, u in [*enumerate(unit(text)), (-1, None)]:
            if u and again(0, n, u[0]):
                held.append(u)
                continue
            if sum(len(key(x).split(" ")) for x, _, _ in held) >= min_words:
                n_removed += len(held)
                gone |= {i for _, a, b in held for i in range(a, b)}
            held = []
        for n, (x, a, b) in enumerate(line(text)):
            if len(key(x)) >= min_chars and again(1, n, x):
                n_lines += 1
                gone |= set(range(a, b))
        out.append((doc_id, "".join(c for i, c in enumerate(text) if i not in gone), n_removed, n_lines))
    return out


DIGESTS: dict[str, int] = {}


def digest_texts(spark, rows):
    texts = sorted({r[1] for r in rows if r[1]})
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", substrings.text_digest("text")).collect()
    DIGESTS.update(map(tuple, found))


def test_substrings(spark, docs, rows, empty):
    """Against loops over all lines and units with their first places."""
    digest_texts(spark, rows)
    want = brute_substrings(rows)
    out = substrings.dedup(docs).collect()
    assert sorted((repr((r.doc_id, r.text or "", r.n_removed, r.n_lines_removed)) for r in out)) == sorted(map(repr, want))
    assert substrings.dedup(empty).count() == 0
    assert any(w[2] for w in want) and any(w[3] for w in want)
    texts = {(r[0], r[1]) for r in rows}
    for r in out:
        assert any(d == r.doc_id and "".join(c for i, c in enumerate(t or "") if not any(s.start <= i < s.end for s in r.spans)) == (r.text or "") for d, t in texts)
    by_id = {r.doc_id: r for r in out}
    assert by_id[20].n_removed == 0 and by_id[21].text == "" and by_id[23].text == ""


def test_rows_that_repeat_a_doc_id_lose_only_what_stays_elsewhere(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(2, a), (2, b), (3, a), (2, c), (2, c), (1, f"{c}\nshort"), (9, b)]
    digest_texts(spark, rows)
    out = sorted((r.doc_id, r.text) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert out == sorted((w[0], w[1]) for w in brute_substrings(rows)) == sorted([(2, a), (2, b), (3, ""), (2, ""), (2, ""), (1, f"{c}\nshort"), (9, "")])


def test_one_of_several_equal_rows_stays(spark, rows):
    """In the operator and in the SQL alike."""
    a = " ".join(f"a{k}" for k in range(30))
    three = [(1, f"{a}\n{a}. end\nx"), (1, f"{a}\n{a}. end\nx"), (2, f"{a}\n{a}. end\nx"), (1, f"{a}\n{a}. end\nx")]
    out = sorted((r.doc_id, r.text) for r in substrings.dedup(spark.createDataFrame(three, "doc_id long, text string").repartition(4)).collect())
    assert out == [(1, ""), (1, ""), (1, three[0][1]), (2, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    both = [*three, *((r[0], r[1]) for r in rows), (None, "twice\n" * 40)]
    con.executemany("INSERT INTO documents VALUES (?, ?)", both)
    want = con.sql(substrings.ORACLE)
    got = substrings.digests(spark.createDataFrame(both, "doc_id long, text string")).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_repeated_lines_go_however_short(spark):
    line, other = "Nine words that many of the texts do share.", "Ünïcode line número one"
    texts = [f"alpha one\n{line}\nbeta two", f"gamma three\n  {line.upper()}\t\n... delta\n{line}", line, other, f"{other}\nthe.\nepsilon four", f"the.\n{other}\n{other}"]
    out = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_words=None).collect()}
    assert out[2].text == "" and out[1].text == "gamma three\n... delta\n" and out[5].text == "the.\n" and out[0].text == texts[0]
    assert [out[k].n_lines_removed for k in range(6)] == [0, 2, 1, 0, 1, 2]


def brute_classes(rows):
    def grams(text):
        w = [x for x in re.split(f"[{WS}]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(r[0], grams(r[1])) for r in rows]
    root = {k: k for k, _ in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return [(k, len(s), find(k)) for k, s in sets]


def test_near_duplicates(docs, rows, empty):
    plain = [r for r in rows if r[0] not in (None, 61)]  # 61 has two different texts
    got = neardup.classes(docs.where("doc_id IS NOT NULL AND doc_id != 61")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_classes(plain))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    odd = neardup.classes(docs).where("doc_id IS NULL").collect()
    assert [(r.component_id, r.kept) for r in odd] == [(None, True)] * 2
    assert neardup.classes(empty).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} & {20, 21, 22, 23} == {20}


def test_chains_and_large_groups_lose_no_link(spark):
    """Chains of near copies, and more near copies than a block of a bucket holds."""
    words = [f"w{k}" for k in range(400)]
    chain = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(40)]
    many = [(1000 + k, " ".join([*(f"v{j}" for j in range(60)), f"only{k}"])) for k in range(300)]
    rows = [(i, t) for i, t in chain + many]
    old, neardup.BLOCK = neardup.BLOCK, 64
    try:
        got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        neardup.BLOCK = old
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_classes(rows))


def brute_repeats(texts, w=suffixes.WINDOW):
    seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                gone[i : i + w] = b"\x01" * w
        out.append((len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    return out


def test_suffixes(docs, rows, empty, spark):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(r[0], *x) for r, x in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows]), strict=True)]
    assert sorted(map(tuple, suffixes.digests(docs).select(columns).collect()), key=repr) == sorted(want, key=repr)
    assert suffixes.digests(empty).count() == 0
    assert sum(1 for w in want if 0 < w[2] < w[1]) > 3
    whole = suffixes.dedup(docs)
    assert set(whole.columns) == set(docs.columns) | {"n_bytes", "n_ties", "kept"} and whole.count() == len(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]
    # The same over chunks and buckets of a few rows, so that repeats cross them.
    old = suffixes.CHUNK_BYTES, suffixes.BUCKET_ROWS
    suffixes.CHUNK_BYTES, suffixes.BUCKET_ROWS = 3000, 100
    try:
        assert sorted(map(tuple, suffixes.digests(docs).select(columns).collect()), key=repr) == sorted(want, key=repr)
    finally:
        suffixes.CHUNK_BYTES, suffixes.BUCKET_ROWS = old


def test_repeats_below_the_window_are_ties(spark):
    """Every repeat of BLOCK + PERIOD - 1 bytes ties, none below BLOCK bytes does."""
    import random

    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    long_, short = text(suffixes.BLOCK + suffixes.PERIOD - 1), text(suffixes.BLOCK - 1)
    rows = [(k, text(200 + 31 * k) + (long_ if k % 3 == 0 else short if k % 3 == 1 else "") + text(150)) for k in range(30)]
    got = {x.doc_id: (x.n_ties > 0, x.n_removed) for x in suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (k % 3 == 0, 0) for k in range(30)}


def test_difference_cover_has_every_shift():
    cover, v = suffixes.difference_cover(suffixes.COVER_PRIME), suffixes.PERIOD
    assert {(i - j) % v for i in cover for j in cover} == set(range(v)) and len(cover) == 14
