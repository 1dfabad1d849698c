"""The pipeline against plain Python over its stages' inputs."""

import hashlib

import corpus_pipeline as P
from glosswerk.llm import langid, mixing

from .test_dedup import brute_classes


def test_stages_on_odd_rows(spark, docs, empty, tmp_path):
    docs = docs.drop("score")
    for start in (docs, empty):
        at = start
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, at, "")
            if k < len(P.STAGES) - 1:
                assert sorted(out.columns) == sorted(start.columns), name
            out.write.parquet(f"{tmp_path}/{start is docs}/{k}")
            at = spark.read.parquet(f"{tmp_path}/{start is docs}/{k}")
        assert {"ids", "n_tokens", "round_trip"} <= set(at.columns)
        assert at.where("NOT round_trip").count() == 0


def test_run_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(source)
    kept = [tuple(r) for r in source.select("doc_id", "text", "source").collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= P.MIN_SCORE]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t, _ in kept:
        for x in {key(x) for x in t.split("\n") if len(key(x)) >= 20}:
            held.setdefault(x, set()).add(d)
    cut = [(d, "\n".join(x for x in t.split("\n") if len(held.get(key(x), ())) < 3 or d == max(held[key(x)])), s) for d, t, s in kept]
    before = {d: t for d, t, _ in kept}
    cut = [(d, t, s) for d, t, s in cut if t == before[d] or t.strip(" \t\n\x0b\x0c\r")]
    first = {d: c for d, _, c in brute_classes(cut)}
    want = {d: t for d, t, _ in cut if first[d] == d}
    got = P.run(spark, sf).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.round_trip and r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in got)
    turns = brute_turns([(d, s) for d, _, s in cut if d in want])
    assert [(r.slot, r.place, r.doc_id) for r in got] == sorted((*turns[d], d) for d in want)


def test_line_dedup_loses_no_line(spark):
    """Three documents share sixty lines and have one line of their own each."""
    shared = "\n".join(f"This is shared line number {k} of many documents." for k in range(60))
    docs = spark.createDataFrame([(k, f"{shared}\nOnly document {k} says this, in one line that stands nowhere else.", "en", "src0", 0) for k in (1, 2, 3)] + [(0, shared, "en", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.dedup_lines(spark, docs, "").collect()}
    assert set(got) == {1, 2, 3} and all(f"Only document {k} says" in got[k] for k in got)
    assert set(shared.split("\n")) <= set(got[3].split("\n"))


def brute_turns(rows):
    """(slot, place) of each doc_id: earliest deadline first over blocks, slot by slot."""
    names = list(mixing.SHARES)
    parts = [*mixing.SHARES.values(), mixing.OTHER]
    waiting = [[] for _ in parts]
    for d, s in rows:
        waiting[names.index(s) if s in names else len(names)].append((hashlib.md5(str(d).encode()).hexdigest(), d))
    total, size, done, turns, slot = sum(parts), mixing.BLOCK_DOCS, [0] * len(parts), {}, 0
    waiting = [[d for _, d in sorted(w)] for w in waiting]
    while len(turns) < len(rows):
        c = min((c for c, a in enumerate(parts) if done[c] * total // a <= slot), key=lambda c: (-(-(done[c] + 1) * total // parts[c]), c))
        turns |= {d: (slot, n) for n, d in enumerate(waiting[c][done[c] * size : (done[c] + 1) * size])}
        done[c] += 1
        slot += 1
    return turns


def test_mixing_order_is_that_of_the_schedule(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mix(source).collect()}
    ids = [r.doc_id for r in mixing.in_order(source).select("doc_id").collect()]
    assert [place[i] for i in ids] == sorted(place.values())
