"""Scans of trees: levels, links, hidden names, splits by bytes, addresses."""

from glosswerk.sources import tree


def paths(df):
    return sorted(r.file for r in df.select("file").collect())


def test_levels_links_and_names(spark, tmp_path):
    for name in ("a.md", ".b.md", "_c.md", "x/y/z/deep.md", "x/.h/d.md", "skip/e.md", "x/skip/f.md", "x/skip.md", "g.MD", "sp ace/ü%20.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "x/loop").symlink_to(tmp_path)
    (tmp_path / "x/link.md").symlink_to(tmp_path / "a.md")
    (tmp_path / "folder.md").mkdir()
    every = [".b.md", "_c.md", "a.md", "sp ace/ü%20.md", "x/.h/d.md", "x/link.md", "x/skip.md", "x/y/z/deep.md"]
    assert paths(tree.listing(spark, str(tmp_path), ".md", "skip")) == every
    assert paths(tree.listing(spark, f"file://{tmp_path}", ".md", "skip,skip.md", dot=False)) == [p for p in every if "/.h/" not in p and p not in (".b.md", "x/skip.md")]
    assert paths(tree.listing(spark, str(tmp_path), ".md", deep=False)) == [".b.md", "_c.md", "a.md"]
    read = {r.file: (r.name, r.content) for r in tree.scan(spark, str(tmp_path), ".md", "skip").collect()}
    assert read["sp ace/ü%20.md"] == ("ü%20.md", "sp ace/ü%20.md") and read["x/link.md"] == ("link.md", "a.md") and len(read) == len(every)
    (tmp_path / "empty").mkdir()
    assert tree.scan(spark, f"{tmp_path}/empty", ".md").count() == 0


def test_files_are_dealt_out_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "SPLIT_BYTES", 1000)
    monkeypatch.setattr(tree, "FILE_BYTES", 10)
    sizes = [5000, 900, *[100] * 30, *[1] * 50]
    for k, n in enumerate(sizes):
        (tmp_path / f"f{k}.md").write_bytes(b"x" * n)
    dealt = tree._dealt(tree.listing(spark, str(tmp_path), ".md"))
    parts = [sum(r.size for r in p) for p in dealt.rdd.glom().collect()]
    assert sum(parts) == sum(sizes) and sum(p > 0 for p in parts) >= 4
    assert max(parts) <= 1000 + 5000 and sorted(parts)[-2] <= 1000 + 900


def test_broken_bytes_and_line_ends_stay_readable(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"a\r\nb\xffc")
    assert [r.content for r in tree.scan(spark, str(tmp_path), ".md").collect()] == ["a\r\nb�c"]


def test_written_files_come_back(spark, tmp_path):
    rows = [("a/b c.md", "text"), ("a/.d.md", ""), ("_e.md", None)]
    tree.write(spark.createDataFrame(rows, "file string, content string"), f"file://{tmp_path}/t").count()
    assert {(r.file, r.content) for r in tree.scan(spark, f"{tmp_path}/t", ".md").collect()} == {(f, c or "") for f, c in rows}
