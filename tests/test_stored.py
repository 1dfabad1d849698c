"""The stored index: two sessions, conflicts, compaction, removal, diffs of any two versions."""

import pytest
from pyspark.sql import functions as F

from glosswerk import cli
from glosswerk.operators import stored


def rows(spark, *entries):
    return spark.createDataFrame([(i, t, d) for i, t, d in entries], "id string, title string, doi string")


def titles(df):
    return {r.id: r.title for r in df.collect()}


def test_two_sessions_add_and_any_two_versions_differ_as_they_should(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "DELTAS", 3)
    states, one, two = [{}], stored.CitationIndex(spark, f"{tmp_path}/i"), stored.CitationIndex(spark.newSession(), f"{tmp_path}/i")
    for k in range(9):
        index = (one, two)[k % 2]
        state = dict(states[-1])
        if k % 4 == 3:
            gone = sorted(state)[:2]
            version = index.remove(index.spark.createDataFrame([(g,) for g in [*gone, "never there"]], "id string"))
            for g in gone:
                del state[g]
        else:
            new = {f"e{n}": f"title {k} {n}" if n % 2 else f"title {n}" for n in range(k, k + 4)}
            version = index.upsert(rows(index.spark, *((i, t, None) for i, t in new.items())))
            state |= new
        states.append(state)
        assert version == k + 1
    assert one.versions() == two.versions() == [*range(1, 10)]
    assert any(one._manifest(v)["base"] for v in one.versions()) and all(len(one._manifest(v)["deltas"]) <= 3 for v in one.versions())
    for v, state in enumerate(states):
        assert titles(two.read(v)) == state
    for a, x in enumerate(states):
        for b in (a, 2, 9):
            y = states[b]
            want = {(i, "added" if i not in x else "removed" if i not in y else "changed") for i in x.keys() | y.keys() if x.get(i) != y.get(i)}
            assert {(r.id, r.change) for r in one.diff(a, b).collect()} == want
    with pytest.raises(ValueError):
        one.read(77)


def test_a_version_published_meanwhile_is_built_upon(spark, tmp_path, monkeypatch):
    one, two = stored.CitationIndex(spark, f"{tmp_path}/i"), stored.CitationIndex(spark, f"{tmp_path}/i")
    publish, raced = one._publish, []

    def late(version, manifest):
        if not raced:
            raced.append(two.upsert(rows(spark, ("theirs", "T", None))))
        return publish(version, manifest)

    monkeypatch.setattr(one, "_publish", late)
    assert one.upsert(rows(spark, ("mine", "M", None))) == 2 and raced == [1]
    assert titles(one.read()) == {"mine": "M", "theirs": "T"} and titles(one.read(1)) == {"theirs": "T"}
    assert not [n for n in (tmp_path / "i/versions").iterdir() if n.name.endswith(".draft")]


def test_works_are_added_by_doi(spark, tmp_path):
    index = stored.CitationIndex(spark, f"{tmp_path}/i")
    index.upsert(rows(spark, ("roe2010", "Another", "10.1/other"), ("mine", "Old", "10.1/d")))
    records = [("10.1/a", True, "A", ["Roe, J."], "J", 2010), ("10.1/b", True, "B", ["Doe, J."], "J", 2011), ("10.1/c", True, "C", ["Doe, K."], "J", 2011), ("10.1/d", True, "New", ["Lee, K."], "J", 2012), ("10.1/e", False, None, None, None, None), ("10.1/f", True, "F", [], "J", None), ("10.1/g", True, "G", ["O'Neil, K."], "J", 1999)]
    index.add(spark.createDataFrame(records, "doi string, verified boolean, title string, authors array<string>, journal string, year int"), "2026-01-01")
    assert {r.id: r.doi for r in index.read().collect()} == {"roe2010": "10.1/other", "mine": "10.1/d", "roe2010-10.1/a": "10.1/a", "doe2011-10.1/b": "10.1/b", "doe2011-10.1/c": "10.1/c", "10.1/f": "10.1/f", "oneil1999": "10.1/g"}
    assert {(r.id, r.change, tuple(r.columns or ())) for r in index.diff(1, 2).where("change != 'added'").collect()} == {("mine", "changed", ("authors", "title", "year", "journal", "verified", "verified_source", "added"))}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "r.bib").write_text("@misc{k, author={Roe, J.}, year={2010}, doi={10.1/k}, title={T}} @misc{u, author={Doe, J.}, year={1999}, title={U}}")
    spark.createDataFrame([("10.1/k", "T", ["Roe, J."], "J", 2010), ("10.1/n", "N", ["Lee, J."], "J", 2011)], "doi string, title string, authors array<string>, journal string, year int").write.parquet(f"{tmp_path}/works")
    where = [f"--index={tmp_path}/i", f"--snapshot={tmp_path}"]
    assert cli.main(["index", f"{tmp_path}/r.bib", *where], spark) == 0 and "version 1" in capsys.readouterr().out
    assert cli.main(["add", "10.1/n", *where], spark) == 0 and "version 2" in capsys.readouterr().out
    assert cli.main(["add", "10.1/none", *where], spark) == 1
    capsys.readouterr()
    assert cli.main(["versions", "1", "2", where[0]], spark) == 0
    assert "added  lee2011" in capsys.readouterr().out
    got = {r.id: r.verified for r in stored.CitationIndex(spark, f"{tmp_path}/i").read().collect()}
    assert got == {"k": True, "u": False, "lee2011": True}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("Roe (2010) and Moe (2012)")
    assert cli.main(["diff", f"{tmp_path}/docs", f"--bibtex={tmp_path}/r.bib"], spark) == 1
    out = capsys.readouterr().out
    assert "not in the bibliography: Moe (2012)" in out and "never cited: u" in out and "k" not in out.split("never cited:")[1].split()
    assert F is not None
