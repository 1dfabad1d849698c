"""Command line: ``python -m glosswerk.cli audit|claims|arxiv|verify|search|diff|index|
add|versions|aggregate|notebook-audit``.

Summaries are single rows; lists of any length are printed as they come from the
executors, one partition at a time, and never held whole by the driver.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswerk.operators import bibliography, citations, claims, consistency, registry, report, stored
from glosswerk.operators.settle import new_folder
from glosswerk.plans.claim_queries import STALE_VALUES
from glosswerk.sources import corpus, web

def _rows(df: DataFrame) -> Iterable[dict]:
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def _one(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


def _dump(x: object) -> str:
    return json.dumps(x, indent=2, ensure_ascii=False, default=str)


def _json(**parts: dict | DataFrame) -> None:
    """One JSON object; lists are written row by row."""
    print("{", end="")
    for k, (name, part) in enumerate(parts.items()):
        print(("," if k else "") + f"\n  {json.dumps(name)}: ", end="")
        if isinstance(part, dict):
            print(_dump(part), end="")
            continue
        print("[", end="")
        for n, row in enumerate(_rows(part)):
            print((",\n" if n else "\n") + _dump(row), end="")
        print("]", end="")
    print("\n}")


def _print(lines: DataFrame) -> None:
    for r in lines.orderBy("part", "a", "b").select("line").toLocalIterator():
        print(r.line)


def _failed(issues: DataFrame) -> int:
    return int(bool(issues.where("severity = 'error'").take(1)))


def audit(spark, a) -> int:
    bib = bibliography.last_wins(bibliography.normalise(corpus.bibtex(spark, a.bibtex)))
    files = corpus.corpus(spark, a.dir).select("file", "content")
    found = citations.audit(files, bib)
    found = (citations.match_titles(found, files, bib) if a.titles else found).cache()
    stats, issues = citations.stats(found), citations.issues(found)
    if a.json:
        _json(stats=_one(stats), issues=issues.orderBy("file", "citation"), citations=found.orderBy("file", "pos"))
        return 0
    _print(report.audit(stats, issues, citations.verbose(found) if a.verbose else None))
    return _failed(issues)


def claims_(spark, a) -> int:
    """Quantitative claims of a tree: all near citations, or one of the filters.  With
    ``--exit-code`` the result is 1 if any is left."""
    files = corpus.corpus(spark, a.dir, "cross_repo").select("file", "content")
    verified = spark.read.parquet(a.verified) if a.verified else spark.createDataFrame([], "file string, digest string")
    if a.uncited:
        found = consistency.uncited_numbers(files).orderBy("file", "start")
    elif a.inconsistent:
        found = consistency.conflicts(consistency.parameters(files)).orderBy("param", "citation")
    elif a.unverified:
        found = consistency.unverified(files, verified).orderBy("file", "number_start")
    else:
        found = consistency.claims_near_citations(files).orderBy("file", "number_start")
    found = found.cache()
    if a.json:
        _json(claims=found)
    else:
        for r in _rows(found):
            print("  " + "  ".join(f"{v}" for v in r.values()))
    return int(a.exit_code and bool(found.take(1)))


def notebook_audit(spark, a) -> int:
    refs, issues, statuses = claims.refs(corpus.claim_texts(spark, a.dir)).cache(), None, None
    if a.aggregate and os.path.exists(a.aggregate):
        catalog = spark.read.text(a.aggregate, wholetext=True).selectExpr("'catalog' AS file", "value AS content")
        issues = claims.missing(refs, catalog)
    if a.notebooks and os.path.isdir(a.notebooks):
        statuses = claims.status(corpus.notebooks(spark, a.notebooks)).orderBy("file")
        blockless = claims.missing_blocks(statuses, refs)
        issues = blockless if issues is None else issues.unionByName(blockless, allowMissingColumns=True)
    if issues is None:
        issues = spark.createDataFrame([], "severity string, type string, file string, message string")
    stats = claims.stats(refs, issues)
    if a.json:
        none = spark.createDataFrame([], "file string")
        _json(stats=_one(stats), issues=issues, notebooks=none if statuses is None else statuses)
        return 0
    stale = claims.stale(corpus.corpus(spark, a.cross_repo, "cross_repo").select("file", "content"), STALE_VALUES) if a.cross_repo else None
    _print(report.claims(stats, statuses, issues, stale))
    return _failed(issues)


def aggregate(spark, a) -> int:
    blocks = claims.blocks(corpus.notebooks(spark, a.dir)).cache()
    if a.json:
        _json(stats=_one(claims.block_stats(blocks)), sections=blocks.orderBy("file"))
        return 0
    found = claims.markdown(blocks).orderBy("place")
    text = (("\n" if r["place"] > 1 else "") + r["line"] for r in _rows(found))
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.writelines(text)
        _print(report.stats(claims.block_stats(blocks)))
        print(f"  Written to: {a.output}")
    else:
        for part in text:
            print(part, end="")
        print()
    return 0


def _answers(spark, a, redirects: int = 0) -> web.Answers:
    return web.Answers(spark, a.cache or new_folder(spark, "answers"), web.Limits(redirects=redirects))


def arxiv(spark, a) -> int:
    """The newest papers of a category and what their references come to."""
    if a.snapshot:
        feeds, pages, works = (spark.read.parquet(f"{a.snapshot}/{t}") for t in ("feeds", "pages", "works"))
        listed = registry.newest(registry.papers(feeds), a.count, a.cat).cache()
        pages = pages.join(listed.select(F.col("id").alias("paper")), "paper", "left_semi")
    else:
        follow = _answers(spark, a, redirects=5)
        listed = registry.papers(web.listing(follow, a.count, a.cat or "cs.AI", a.preprints or web.LISTING)).cache()
        pages = web.pages(follow, listed, a.preprints or web.PREPRINTS)
    items, refs = registry.items(pages).cache(), registry.references(pages)
    titles = registry.titles_in_budget(items).select("title")
    if a.snapshot:
        works = works.dropDuplicates(["doi"])
        hits = registry.search(titles, works)
    else:
        answers = _answers(spark, a)
        works = registry.records(web.lookups(answers, registry.dois_in_budget(items).select("doi"), a.registry)).where("verified").cache()
        hits = registry.hit_records(web.searches(answers, titles, a.registry)).cache()
    issues = registry.issues(registry.check_dois(items, works), registry.check_titles(items, hits)).cache()
    per = registry.paper_stats(listed, refs, issues).cache()
    stats = registry.stats(per)
    counts = _one(stats)
    if a.json:
        _json(stats=counts, papers=per.orderBy("id"), issues=issues.orderBy("paper"))
        return 0
    _print(report.papers(listed, per, stats, issues))
    return int(counts["issues_found"] > 0)


def verify(spark, a) -> int:
    dois = spark.createDataFrame([(a.doi,)], "doi string")
    found = registry.verify(dois, spark.read.parquet(f"{a.snapshot}/works")) if a.snapshot else registry.records(web.lookups(_answers(spark, a), dois, a.registry))
    found = found.cache()
    if a.json:
        print(_dump(_one(found)))
        return 0
    _print(report.verified(found))
    return int(not _one(found)["verified"])


def diff(spark, a) -> int:
    """What a tree cites and its bibliography lacks, and the other way round."""
    bib = bibliography.last_wins(bibliography.normalise(corpus.bibtex(spark, a.bibtex)))
    files = corpus.corpus(spark, a.dir).select("file", "content")
    missing, idle = citations.orphans(files, bib).cache(), citations.uncited(files, bib).cache()
    if a.json:
        _json(missing=missing.orderBy("file", "pos"), uncited=idle.orderBy("id"))
        return 0
    for r in _rows(missing.orderBy("file", "pos")):
        print(f"  ✗ {r['file']}  not in the bibliography: {r['raw']}")
    for r in _rows(idle.orderBy("id")):
        print(f"  ℹ never cited: {r['id']}")
    return int(bool(missing.take(1)))


def index(spark, a) -> int:
    """Puts a bibliography into a stored index, verified against a snapshot if given."""
    bib = bibliography.last_wins(bibliography.normalise(corpus.bibtex(spark, a.bibtex)))
    works = spark.read.parquet(f"{a.snapshot}/works") if a.snapshot else None
    print(f"  version {stored.CitationIndex(spark, a.index).index(bib, works, str(date.today()))}")
    return 0


def add(spark, a) -> int:
    """Puts a work into a stored index by its DOI."""
    dois = spark.createDataFrame([(a.doi,)], "doi string")
    found = registry.verify(dois, spark.read.parquet(f"{a.snapshot}/works")) if a.snapshot else registry.records(web.lookups(_answers(spark, a), dois, a.registry))
    one = _one(found)
    if not one["verified"]:
        print(f"  ✗ Not verified: {one['error']}")
        return 1
    print(f"  version {stored.CitationIndex(spark, a.index).add(found, str(date.today()))}")
    return 0


def versions(spark, a) -> int:
    """What changed between two versions of a stored index."""
    found = stored.CitationIndex(spark, a.index).diff(a.old, a.new).orderBy("id")
    if a.json:
        print(_dump(list(_rows(found))))
        return 0
    for r in _rows(found):
        print(f"  {r['change']}  {r['id']}{'  (' + ', '.join(r['columns']) + ')' if r['columns'] else ''}")
    return 0


def search(spark, a) -> int:
    titles = spark.createDataFrame([(a.title,)], "title string")
    found = (registry.search(titles, spark.read.parquet(f"{a.snapshot}/works")) if a.snapshot else registry.hit_records(web.searches(_answers(spark, a), titles, a.registry))).orderBy("rank")
    if a.json:
        print(_dump(list(_rows(found))))
        return 0
    if found.take(1):
        _print(report.hits(found))
    else:
        print("  No results found.")
    return 0


#: A snapshot, or the address of a live registry and of a preprint server, with the folder where answers are kept.
_WHERE = ("--snapshot", "--registry", "--preprints", "--cache")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="glosswerk")
    sub = top.add_subparsers(dest="command", required=True)
    for name, run, positional, options in (
        ("audit", audit, "dir", ("--bibtex",)),
        ("claims", claims_, "dir", ("--verified",)),
        ("arxiv", arxiv, None, (*_WHERE, "--cat")),
        ("verify", verify, "doi", _WHERE),
        ("search", search, "title", _WHERE),
        ("diff", diff, "dir", ("--bibtex",)),
        ("index", index, "bibtex", ("--index", "--snapshot")),
        ("add", add, "doi", ("--index", *_WHERE)),
        ("versions", versions, None, ("--index",)),
        ("aggregate", aggregate, "dir", ()),
        ("notebook-audit", notebook_audit, "dir", ("--aggregate", "--notebooks", "--cross-repo")),
    ):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        if positional:
            p.add_argument(positional)
        for o in options:
            p.add_argument(o, required=o in ("--bibtex", "--index"))
        if name == "arxiv":
            p.add_argument("count", nargs="?", type=int, default=10)
        if name == "versions":
            p.add_argument("old", type=int)
            p.add_argument("new", type=int)
        if name == "audit":
            p.add_argument("--titles", action="store_true")
        if name == "claims":
            for flag in ("--unverified", "--inconsistent", "--uncited", "--exit-code"):
                p.add_argument(flag, action="store_true")
        p.add_argument("--json", action="store_true")
        p.add_argument("--verbose", action="store_true")
        p.add_argument("-o", "--output")
    a = top.parse_args(argv)
    if a.command == "audit" and not os.path.exists(a.bibtex):
        print(f"no such bibliography: {a.bibtex}", file=sys.stderr)
        return 1
    if hasattr(a, "registry") and not (a.snapshot or a.registry):
        print("give --snapshot=FOLDER, or --registry=ADDRESS for live answers", file=sys.stderr)
        return 1
    return a.run(spark or SparkSession.builder.appName("glosswerk").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
