"""Hand-made cases: citations, BibTeX, notebooks, stale values, files, streams, commands."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from glosswerk import cli
from glosswerk.functions import text as X
from glosswerk.functions.bibtex import entries
from glosswerk.operators import bibliography, citations, claims, registry
from glosswerk.plans.claim_queries import STALE_VALUES
from glosswerk.sources import corpus


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "content string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, found",
    [
        ("However, Smith (2010)", [("However, Smith", 2010)]),
        ("McDonald (2011)", [("Donald", 2011)]),
        ("Freihaut & Göritz (2022)", []),
        ("(Pelli, 2008) Tillman (2008a) Foo et al (2003)", []),
        ("SmithandJones (2001)", [("SmithandJones", 2001)]),
        ("Smith (2009)", [("Smith", 2009)]),
        ("Smith et al. (2010), Lee and Park (1999)", [("Smith et al.", 2010), ("Lee and Park", 1999)]),
        ("", []),
    ],
)
def test_inline(spark, text, found):
    assert [(c.authors, c.year) for c in one(spark, text, X.inline_citations(F.col("content")))] == found


def test_dois(spark):
    assert one(spark, "doi:10.1038/nn.2889. https://doi.org/10.1016/S0140-6736(98)01", X.dois(F.col("content"))) == ["10.1038/nn.2889.", "10.1016/S0140-6736(98"]


def test_audit_counts_a_key_once_in_a_file(spark):
    files = spark.createDataFrame([("a", "Smith (2010) and then Smith & Lee (2010), None (1999)"), ("b", None)], "file string, content string")
    bib = spark.createDataFrame([("k1", ["Smith, J."], 2010, "d", 1), ("k2", ["Smith, K."], 2010, None, 2), ("k3", [], 1999, None, 3)], "id string, authors array<string>, year int, doi string, pos long")
    found = {r.lookup_key: r for r in citations.audit(files, bib).collect()}
    r = found["smith_2010"]
    assert (r.raw, r.mentions, r.ambiguous, r.has_doi, r.ids) == ("Smith (2010)", 2, True, True, ["k1", "k2"])
    stats = citations.stats(citations.audit(files, bib)).first()
    assert stats.total == stats.in_bibtex + stats.orphans and stats.issue_count == stats.orphans + stats.ambiguous


def test_bibtex(spark, tmp_path):
    (tmp_path / "r.bib").write_text('@comment{x}\n@Article{Key1, Author = {Roe, {J.} and  Doe, K. AND}, title={A {B} title}, year = "2010a",\n DOI={10.1/x}, url={http://arxiv.org/abs/2101.12345v2}}\n@book{key1, author={Jane Roe}, title={Later}, booktitle = {In}}\n@misc{, year = {{2010}}}')
    raw = corpus.bibtex(spark, str(tmp_path / "r.bib"))
    rows = {r.pos: r for r in bibliography.normalise(raw).collect()}
    assert (rows[0].id, rows[0].authors, rows[0].title, rows[0].year, rows[0].doi, rows[0].arxiv) == ("key1", ["Roe, J.", "Doe, K. AND"], "A B title", 2010, "10.1/x", "2101.12345")
    assert (rows[1].journal, rows[1].year, rows[2].id, rows[2].year) == ("In", 0, "", None)
    last = {r.id: r for r in bibliography.last_wins(bibliography.normalise(raw)).collect()}
    assert last["key1"].title == "Later" and last["key1"].pos == 0


def test_the_last_of_several_sources_wins(spark, tmp_path):
    """Whatever its place in its own source."""
    (tmp_path / "a.bib").write_text("@misc{x, title={X}} @misc{k, author={Roe, J.}, year={2010}, title={Old}}")
    (tmp_path / "b.bib").write_text("@misc{k, author={Roe, J.}, year={2010}, title={New}, doi={10.1/k}}")
    both = bibliography.normalise(corpus.bibtex(spark, f"{tmp_path}/a.bib", f"{tmp_path}/b.bib"))
    apart = bibliography.in_turn(*(bibliography.normalise(corpus.bibtex(spark, f"{tmp_path}/{n}.bib")) for n in "ab"))
    for entries_ in (both, apart):
        won = {r.id: (r.title, r.doi) for r in bibliography.last_wins(entries_).collect()}
        assert won == {"x": ("X", None), "k": ("New", "10.1/k")}


def test_bibtex_grammar():
    text = """@string{jop = "Journal of Parts"} @comment{@article{old, title={Old}}} @preamble{"x" # "y"}
    @misc{a, note={see @misc{b, title={X}} there}, title={C# in practice}, howpublished="a # b", journal = jop # " " # {B},}
    @book(c, title = "With {\\"o} and (round)", year = 1999) @misc{open, title={never closed"""
    assert list(entries(text)) == [
        ("a", "misc", {"note": "see @misc{b, title={X}} there", "title": "C# in practice", "howpublished": "a # b", "journal": "Journal of Parts B"}),
        ("c", "book", {"title": 'With {\\"o} and (round)', "year": "1999"}),
        ("open", "misc", {"title": "never closed"}),
    ]
    assert list(entries("")) == [] and list(entries("@misc{x, y}")) == [("x", "misc", {})]


def test_bibliography_in_a_folder_with_a_comma(spark, tmp_path):
    (tmp_path / "a, b").mkdir()
    (tmp_path / "a, b/r.bib").write_text("@misc{k, title={T}}")
    assert [r.citation_key for r in corpus.bibtex(spark, f"{tmp_path}/a, b/r.bib").collect()] == ["k"]


def notebook(*cells):
    return json.dumps({"cells": [{"cell_type": "markdown", "source": c} for c in cells]})


def test_notebooks(spark):
    rows = [
        ("11_5_x.ipynb", notebook(["## Key Claims\n", "| **K1** | a |\n", "| K2 | K3 |\n", "## Next\n| K9 | no |"])),
        ("05_y.ipynb", notebook("### Key Claims\n| K1 | a |")),
        ("06_z.ipynb", notebook("##Key Claims\n| K1 | a |")),
        ("07_e.ipynb", notebook("## Key Claims\n\n## Next")),
        ("08_b.ipynb", "{"),
        ("notes.ipynb", notebook("## Key Claims\n| K1 | a |")),
    ]
    files = spark.createDataFrame(rows, "file string, json string")
    blocks = {r.file: r for r in claims.blocks(files).collect()}
    assert set(blocks) == {r[0] for r in rows[:5]}
    assert (blocks["11_5_x.ipynb"].label, blocks["11_5_x.ipynb"].claim_count, blocks["05_y.ipynb"].label) == ("NB11.5", 2, "NB05")
    assert [blocks[f].block is None for f in ("05_y.ipynb", "06_z.ipynb", "07_e.ipynb", "08_b.ipynb")] == [True, False, True, True]
    status = {r.file: r for r in claims.status(files).collect()}
    assert [status[f].has_block for f in ("05_y.ipynb", "06_z.ipynb", "08_b.ipynb")] == [True, False, False]
    assert status["08_b.ipynb"].error == "parse error"
    assert "08_b.ipynb" not in {r.file for r in claims.prose(files).collect()}


def test_catalog_and_references(spark):
    catalog = spark.createDataFrame([("c", "## NB14\n| K1 | not in a section |\n## NB05: a\n| K1 | x | y |\n# other\n| **K2** | z |\n## NB05: again\n| K3 | w |")], "file string, content string")
    assert {(r.nb, r.claim_id, r.text) for r in claims.claims(catalog).collect()} == {("NB05", "K3", "w")}
    refs = claims.refs(spark.createDataFrame([("f", "a\n[NB5:K1] [NB05:K3] [NB05:K1] [NB14]")], "file string, content string"))
    assert {(r.ref, r.type, r.line) for r in claims.missing(refs, catalog).collect()} == {("[NB5:K1]", "missing_notebook", 2), ("[NB05:K1]", "missing_claim", 2)}


def test_a_catalog_is_carried_through_segments(spark, monkeypatch):
    """Whatever the length of a segment, the sections are those of one pass over the lines."""
    r = random.Random(8)
    texts = {f: "\n".join(r.choice(["## NB1: a", "## NB2 b", "# other", "| **K1** | x |", "| K2 | y | z |", "| K1 |", "text", ""]) for _ in range(200)) for f in ("c", "d")}
    want = {}
    for f in ("c", "d"):
        mine, at = {}, None
        for line in texts[f].split("\n"):
            if m := re.match(r"## (NB\d+)[: ]", line):
                at = m[1]
                mine[at] = {}
            elif at and (m := re.match(r"\| \**(K\d+)\** \| (.*) \|$", line)):
                mine[at][m[1]] = m[2]
        want |= {(n, k): t for n, ks in mine.items() for k, t in ks.items()}
    files = spark.createDataFrame([*texts.items()], "file string, content string")
    for size in (1, 3, 7, 4096):
        monkeypatch.setattr(claims, "SEGMENT", size)
        assert {(x.nb, x.claim_id): x.text for x in claims.claims(files).collect()} == want


def test_the_catalog_document_is_sorted_over_ranges(spark):
    rows = [(f"{n:02}_x{k}.ipynb", notebook(f"## Key Claims\n| K1 | {n} |\n| K2 | {k} |")) for n in (3, 11, 2) for k in range(9)] + [("05_none.ipynb", notebook("nothing"))]
    files = spark.createDataFrame(rows, "file string, json string").repartition(5)
    got = claims.markdown(claims.blocks(files)).orderBy("place").collect()
    assert [r.place for r in got] == [*range(1, len(got) + 1)]
    order = sorted((r[0] for r in rows[:-1]), key=lambda f: (int(f[:2]), f))
    text = "\n".join(r.line for r in got)
    assert [m for m in re.findall(r"^- \[NB\d+: `(.*?)`\]", text, re.M)] == [f.removesuffix(".ipynb") for f in order]
    assert re.findall(r"^## NB\d+: `(.*?)`$", text, re.M) == [f.removesuffix(".ipynb") for f in order]
    assert "> 27 notebooks, 54 claims.\n\n**Contract:**" in text
    assert claims.markdown(claims.blocks(files.where("file LIKE '05%'"))).where("line LIKE '> 0 notebooks%'").count() == 1


def test_stale(spark):
    files = spark.createDataFrame([("f", "In 1994,\nAUC 0.827 and 994")], "file string, content string")
    assert {(r.line, r.value) for r in claims.stale(files, STALE_VALUES).collect()} == {(1, "994"), (2, "0.827"), (2, "994")}


def test_many_stale_values_find_what_few_do(spark, monkeypatch):
    """Automata and the test in place, over overlapping, repeated, empty and long values."""
    r = random.Random(3)
    files = spark.createDataFrame([(f"f{k}", "\n".join("".join(r.choice("ab1é漢") for _ in range(r.randrange(12))) for _ in range(30))) for k in range(4)] + [("n", None)], "file string, content string")
    values = [("".join(r.choice("ab1é漢") for _ in range(n % 4 + 1)), r.choice([None, "m"]), r.choice([None, "c"])) for n in range(60)] + [("", "every line", None), ("a", "again", "x"), ("a", "again", "y")]
    want = sorted(map(repr, claims.stale(files, values).collect()))
    for block in (1 << 20, 5):
        monkeypatch.setattr(claims, "MANY", 1)
        monkeypatch.setattr(claims, "BLOCK_VALUES", block)
        assert sorted(map(repr, claims.stale(files, values).collect())) == want
    none = spark.createDataFrame([], "value string, message string, correction string")
    assert claims.stale(files, none).count() == 0


def test_reference_pages(spark):
    item = '<li id="bib.1">A (2001). A title that is long enough. Venue. <a href="https://doi.org/10.1000/{}">x</a></li>'
    title = '<li id="bib.2">B (2002). Another title that is long. Venue.</li>'
    pages = spark.createDataFrame([("p", "<html>References" + "".join(item.format(k) for k in range(20)) + title * 9), ("q", "<li id='bib.1'>no section</li>"), ("r", None)], "paper string, html string")
    kinds = registry.budget(registry.references(pages)).groupBy("paper", "kind").count().collect()
    assert registry.dois_in_budget(registry.items(pages)).count() == 15 and registry.titles_in_budget(registry.items(pages)).count() == 5
    assert {(r.paper, r.kind, r["count"]) for r in kinds} == {("p", "doi", 15), ("p", "title", 5)}


def test_a_feed_of_over_a_million_entries_is_whole(spark):
    feed = spark.range(1).selectExpr("'f' AS feed", "repeat('<entry>', 1000000) || '<entry><id>http://arxiv.org/abs/last</id><title>T</title></entry>' AS xml")
    assert [(r.id, r.title) for r in registry.papers(feed).collect()] == [("last", "T")]


def test_feed_files_are_split_at_any_byte(spark, tmp_path):
    """Small splits, tags that cross them, long entries, files without entries."""
    r = random.Random(2)
    for f in range(3):
        entries_ = [f"<entry>\n<id>http://arxiv.org/abs/{f}.{k}v1</id><title>T\n{'x' * r.randrange(300)} é &amp; {k}</title><author><name>A</name></author></entry>\n" for k in range(40)]
        (tmp_path / f"f{f}.xml").write_text(f"<?xml version='1.0'?>\n<feed><id>http://arxiv.org/abs/feed</id><title>Feed</title>{''.join(entries_)}</feed>")
    (tmp_path / "none.xml").write_text("<feed><id>http://arxiv.org/abs/none</id><title>None</title></feed>")
    (tmp_path / "bare.xml").write_text("<entry><id>http://arxiv.org/abs/bare</id><title>B</title>")
    rows = [(p.name, p.read_text()) for p in tmp_path.glob("*.xml")]
    want = sorted(map(repr, registry.papers(spark.createDataFrame(rows, "feed string, xml string")).collect()))
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "97", "1000"):
            spark.conf.set(key, size)
            got = registry.papers_in(spark, str(tmp_path))
            assert sorted(map(repr, got.collect())) == want and len(want) == 121
        assert got.rdd.getNumPartitions() > 5
    finally:
        spark.conf.set(key, before)


def test_search_has_no_floor_and_titles_can_be_missed(spark, tmp_path, capsys):
    """The best three by brute force, also where no or few works are similar."""
    titles = ["common alpha beta", "common gamma delta epsilon zeta", "common alpha", "theta iota kappa", "common eta", None, "Zygomorphic petals: flower development under many different conditions everywhere", "common alpha beta gamma"]
    works = spark.createDataFrame([(f"10.1/{k}", t, ["A"], "J", 2000) for k, t in enumerate(titles)], "doi string, title string, authors array<string>, journal string, year int")
    asked = ["common alpha beta", "common unseen words", "gamma iota", "nothing shared here", "zygomorphic petals unheard", "to be"]
    sets = {k: set(re.findall("[a-z]{3,}", (t or "").lower())) for k, t in enumerate(titles)}
    want = set()
    for q in asked:
        a = set(re.findall("[a-z]{3,}", q))
        best = sorted((-len(a & b) / len(a | b), f"10.1/{k}") for k, b in sets.items() if a & b)[:3]
        want |= {(q, n, doi, round(-s, 9)) for n, (s, doi) in enumerate(best, 1)}
    found = registry.search(spark.createDataFrame([(q,) for q in asked], "title string"), works).collect()
    assert {(r.query, r.rank, r.doi, round(r.similarity, 9)) for r in found} == want
    assert all(0 < r.score <= 100 + 1e-9 for r in found)
    items = "".join(f'<li id="bib.{k}">B (2002). {t}. Venue.</li>' for k, t in enumerate(["Zygomorphic petals unheard", "Common alpha beta gamma"]))
    works.write.parquet(f"{tmp_path}/works")
    spark.createDataFrame([("p", f"<html>References{items}")], "paper string, html string").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([("f", "<entry><id>http://arxiv.org/abs/p</id><title>T</title></entry>")], "feed string, xml string").write.parquet(f"{tmp_path}/feeds")
    assert cli.main(["arxiv", f"--snapshot={tmp_path}"], spark) == 1
    assert "── p: T" in capsys.readouterr().out
    assert cli.main(["search", titles[6], f"--snapshot={tmp_path}"], spark) == 0 and "10.1/6" in capsys.readouterr().out
    assert cli.main(["verify", "10.1/1", f"--snapshot={tmp_path}"], spark) == 0 and "Authors: A" in capsys.readouterr().out
    assert cli.main(["verify", "10.1/none", f"--snapshot={tmp_path}"], spark) == 1
    capsys.readouterr()
    assert cli.main(["arxiv", f"--snapshot={tmp_path}", "--json"], spark) == 0
    issues = json.loads(capsys.readouterr().out)["issues"]
    assert [(i["issue"], i["claimed"], i["best_match"]) for i in issues] == [("Title not found in CrossRef", "Zygomorphic petals unheard", titles[6])]


@pytest.fixture
def tree(tmp_path):
    for name, text in {".x.md": "Smith (2010)", "_x.md": "Lee (2011)", "a/b c.md": "Roe (1999) [NB01:K1] [NB01:K7]", "dist/no.md": "No (2000)", "a/no.txt": "No (2000)"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "a/link").symlink_to(tmp_path)
    (tmp_path / "nb").mkdir()
    (tmp_path / "nb/01_one.ipynb").write_text(notebook("## Key Claims\n| K1 | a | b |"))
    (tmp_path / "r.bib").write_text("@article{s, author={Smith, J.}, year={2010}, doi={10.1/s}}")
    return tmp_path


def test_scan(spark, tree):
    assert {r.file for r in corpus.corpus(spark, str(tree)).collect()} == {".x.md", "_x.md", "a/b c.md"}
    assert {r.file for r in corpus.claim_texts(spark, str(tree)).collect()} == {"_x.md", "a/b c.md", "nb/01_one.ipynb"}


def test_commands(spark, tree, capsys):
    assert cli.main(["audit", str(tree), f"--bibtex={tree}/r.bib", "--json"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["stats"]["total"] == 3 and out["stats"]["in_bibtex"] == 1
    assert cli.main(["audit", str(tree), "--bibtex=/none.bib"], spark) == 1
    assert cli.main(["aggregate", f"{tree}/nb", "-o", f"{tree}/catalog.md"], spark) == 0
    assert cli.main(["notebook-audit", str(tree), f"--aggregate={tree}/catalog.md", f"--notebooks={tree}/nb"], spark) == 1
    out = capsys.readouterr().out
    (tree / "a/s.md").write_text("AUC 0.827")
    assert cli.main(["notebook-audit", str(tree), f"--cross-repo={tree}"], spark) == 0 and "a/s.md:1" in capsys.readouterr().out
    assert "K7 not found in NB01" in out and "✓ 01_one.ipynb  (1 claims)" in out
    (tree / "a/n.md").write_text("Smith (2010) has gain 12 and gain 13. " + "x" * 400 + " then 99")
    assert cli.main(["claims", str(tree), "--uncited", "--exit-code"], spark) == 1 and "99" in capsys.readouterr().out
    assert cli.main(["claims", str(tree), "--inconsistent", "--exit-code"], spark) == 1 and "12|13" in capsys.readouterr().out
    spark.createDataFrame([("a/n.md", (tree / "a/n.md").read_text())], "file string, content string").selectExpr("file", "sha2(content, 256) AS digest").write.parquet(f"{tree}/seen")
    assert cli.main(["claims", str(tree), "--unverified", "--json"], spark) == 0 and len(json.loads(capsys.readouterr().out)["claims"]) >= 2
    assert cli.main(["claims", str(tree), "--unverified", f"--verified={tree}/seen"], spark) == 0 and "gain" not in capsys.readouterr().out


def test_a_file_s_citations_are_deduplicated_in_its_row(spark):
    """Nothing is shuffled by file for it; the same as grouping all citations."""
    files = spark.createDataFrame([("f", "Smith (2010), Lee et al. (2011); Smith & Roe (2010). Lee (2011) Smith (2011) However, Smith (2010)"), ("g", "none"), ("h", None), ("i", "Lee (2011)")], "file string, content string")
    found = citations.cited(files)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, citations.dedup(citations.extract(files)).collect()))
    assert {(r.raw, r.mentions) for r in found.where("file = 'f'").collect()} == {("Smith (2010)", 2), ("Lee et al. (2011)", 2), ("Smith (2011)", 1), ("However, Smith (2010)", 1)}
    bib = spark.createDataFrame([("s", ["Smith, J."], "T", 2010, None, 1)], "id string, authors array<string>, title string, year int, doi string, pos long")
    assert "hashpartitioning(file" not in citations.audit(files, bib)._jdf.queryExecution().executedPlan().toString()


def test_the_report_of_an_audit_keeps_no_lists_of_entries(spark, monkeypatch):
    from glosswerk.plans import citation_queries

    held = []
    for name in ("kept", "settled"):
        if hasattr(citation_queries, name):
            monkeypatch.setattr(citation_queries, name, lambda df, *a: held.append(df) or df)
    citation_queries.audit_report(spark, "/root/testdata/sf0.001")
    assert len(held) == 1 and "collect_list" not in held[0]._jdf.queryExecution().optimizedPlan().toString()


def test_et_al_shuffles_citations_before_they_meet_their_entries(spark):
    from glosswerk.operators import consistency

    bib = spark.createDataFrame([("a", ["Lee, J.", "Roe, R."], 2011, 1, None), ("b", ["Lee, K."], 2011, 2, None)], "id string, authors array<string>, year int, pos long, doi string")
    files = spark.createDataFrame([("f", "Lee et al. (2011), Lee (2011), Poe et al. (2012)"), ("g", "Lee et al. (2011)")], "file string, content string")
    found = consistency.et_al(citations.keyed(citations.cited(files)), bib)
    assert sorted((r.file, r.raw, r.id or "", r.authors or []) for r in found.collect()) == [("f", "Lee et al. (2011)", "a", ["Lee, J.", "Roe, R."]), ("f", "Lee et al. (2011)", "b", ["Lee, K."]), ("f", "Poe et al. (2012)", "", []), ("g", "Lee et al. (2011)", "a", ["Lee, J.", "Roe, R."]), ("g", "Lee et al. (2011)", "b", ["Lee, K."])]
    plan = consistency.et_al(citations.audit(files, bib), bib)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    assert lines.index(next(x for x in lines if x.startswith("Generate explode(entries"))) < lines.index(next(x for x in lines if x.startswith("Join")))


def test_cosine_topk_in_blocks_with_ties(spark, monkeypatch):
    """Blocks of two queries and chunks of three rows; equal vectors go by id; no plan holds all queries."""
    import inspect

    from glosswerk.operators import consistency

    rows = [(i, [float(i % 7), float(i % 3) - 1.0, 1.0]) for i in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0]), (42, [1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows if v and any(v) and len(v) == 3}
    cos = lambda a, b: round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 12)
    want = [(a, n, b) for a in sorted(unit) if a % 4 == 0 for n, b in enumerate(sorted((b for b in unit if b != a), key=lambda b: (-cos(a, b), b))[:5], 1)]
    for numbers, chunk in ((6, 3), (1 << 19, 512)):
        monkeypatch.setattr(consistency, "QUERY_NUMBERS", numbers)
        monkeypatch.setattr(consistency, "CHUNK", chunk)
        got = consistency.cosine_topk(df.where("id % 4 = 0"), df)
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == want
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString() and "collect_list" not in inspect.getsource(consistency.cosine_topk)


def test_references_are_summed_up_in_a_paper_s_row(spark):
    """The same as by items, windows and groups, and the pages are read once for a report."""
    from glosswerk.operators import registry
    from glosswerk.plans import reference_queries

    li = lambda n, tail: f'<li id="bib{n}"><b>A.</b> (20{10 + n % 80}). A title of many words {n}. Journal. {tail}</li>'
    doi = lambda n: f'<a href="https://doi.org/10.1/{n}">x</a>'
    long = "".join(li(n, doi(n) if n % 2 else "") for n in range(60)) + li(60, '<a href="https://doi.org/10.48550/a.1">x</a>') + '<li id="bib61">short</li>'
    pages = spark.createDataFrame([("p", f"References {li(0, doi(9))} References<ul>{long}</ul>"), ("q", "no list"), ("r", "References none"), ("s", None), ("t", f"References{li(1, '')}")], "paper string, html string")
    works = spark.createDataFrame([("10.1/1", "A title of many words 1"), ("10.1/3", "Quite other things")], "doi string, title string")
    hits = spark.createDataFrame([("A title of many words 2", 1, "Unlike it", 80.0)], "query string, rank int, title string, score double")
    items, listed = registry.items(pages), spark.createDataFrame([(p,) for p in "pqrstu"], "id string")
    old = registry.issues(registry.check_dois(items, works), registry.check_titles(items, hits))
    found = registry.summaries(pages)
    new = registry.summary_issues(found, works, hits)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(new) == rows(old) and new.count() == 15
    assert rows(registry.summary_stats(listed, found, new)) == rows(registry.paper_stats(listed, registry.references(pages), old))
    plan = reference_queries.arxiv_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan  # the pages' view is gone from the last plan


def test_severities_of_keys_are_those_of_all_issues(spark):
    files = spark.createDataFrame([("f", "Smith (2010) Lee (2011) Roe (2012)")] * 3, "file string, content string")
    bib = spark.createDataFrame([("a", ["Smith, J."], 2010, None, 1), ("b", ["Smith, K."], 2010, None, 2), ("c", ["Lee, J."], 2011, None, 3)], "id string, authors array<string>, year int, doi string, pos long")
    assert {r.severity for r in citations.severities(files, bib).collect()} == {"warn", "info"} == {r.severity for r in citations.issues(citations.audit(files, bib)).collect()}
    assert citations.severities(files.where("false"), bib).count() == 0
