"""Citation audit: extract, deduplicate, resolve against a bibliography, classify.

The bibliography is grouped by (surname, year) before it is joined, so the join has
one match per citation, and citations are deduplicated before it, each file's within its
row.  Neither side is broadcast by hint: a bibliography may be large, and the optimiser
knows its size; with the citations sorted by key, equal lists of entries also follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswerk.functions import patterns as P
from glosswerk.functions import text as X
from glosswerk.operators import fuzzy


def extract(files: DataFrame) -> DataFrame:
    """file, raw, authors, year, pos for every citation of (file, content)."""
    return files.select("file", F.inline(X.inline_citations(F.col("content"))))


def keyed(citations: DataFrame) -> DataFrame:
    name = X.inline_surname(F.col("authors"))
    return citations.withColumn("surname", name).withColumn("lookup_key", X.lookup_key(F.col("surname"), F.col("year")))


def dedup(citations: DataFrame) -> DataFrame:
    """First citation of each key in a file, and how often the key occurs there."""
    first = F.min_by(F.struct("raw", "authors"), F.col("pos")).alias("first")
    return keyed(citations).groupBy("file", "surname", "year").agg(first, F.min("pos").alias("pos"), F.count("*").alias("mentions")).select("file", "surname", "year", "first.raw", "first.authors", "pos", "mentions")


def cited(files: DataFrame) -> DataFrame:
    """``dedup`` of all citations of (file, content), one row for each file: a file's
    citations are sorted by key and place in its row, and none is shuffled for it."""
    keys = F.array_sort(F.transform(X.inline_citations(F.col("content")), lambda c: F.struct(X.inline_surname(c["authors"]).alias("surname"), c["year"].alias("year"), c["pos"].alias("pos"), c["raw"].alias("raw"), c["authors"].alias("authors"))))
    # explode keeps the sorted list from being worked out anew for each of its elements
    held = files.select("file", F.explode(F.array(keys)).alias("cs"))
    new = lambda c, i: (i == 0) | (F.get("cs", i - 1)["surname"] != c["surname"]) | (F.get("cs", i - 1)["year"] != c["year"])
    starts = F.filter(F.transform("cs", lambda c, i: F.when(new(c, i), i)), lambda i: i.isNotNull())
    held = held.select("file", "cs", F.explode(F.array(starts)).alias("starts"))
    mentions = lambda i, k: (F.coalesce(F.get("starts", k + 1), F.size("cs")) - i).cast("long").alias("mentions")
    found = held.select("file", F.inline(F.transform("starts", lambda i, k: F.struct(F.get("cs", i).alias("c"), mentions(i, k)))))
    return found.select("file", "c.surname", "c.year", "c.raw", "c.authors", "c.pos", "mentions")


def lookup(bib: DataFrame) -> DataFrame:
    """Entries grouped by (surname, year): matches, ids in index order, has_doi.

    Entries without an author are left out; a null year never joins.
    """
    named = bib.where(F.size("authors") > 0).withColumn("surname", X.surname(F.col("authors"))).withColumn("doi", X.some(F.col("doi")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids")
    return named.groupBy("surname", "year").agg(F.count("*").alias("matches"), ids, F.bool_or(F.col("doi").isNotNull()).alias("has_doi"))


def audit(files: DataFrame, bib: DataFrame, sep: str | None = None) -> DataFrame:
    """One row per citation key and file, resolved against the bibliography; ids are an
    array, or joined by ``sep``, once for each key."""
    known = lookup(bib)
    if sep is not None:
        known = known.withColumn("ids", F.array_join("ids", sep))
    found = cited(files).join(known, ["surname", "year"], "left")
    return found.select(
        "raw", "authors", "year", "file", "pos", "mentions",
        X.lookup_key(F.col("surname"), F.col("year")).alias("lookup_key"),
        F.col("matches").isNotNull().alias("in_bibtex"),
        F.coalesce("has_doi", F.lit(False)).alias("has_doi"),
        (F.coalesce("matches", F.lit(0)) > 1).alias("ambiguous"),
        F.coalesce("matches", F.lit(0)).cast("long").alias("matches"),
        "ids",
        F.lit(None).cast("string").alias("title_match"),
    )


def match_titles(audited: DataFrame, files: DataFrame, bib: DataFrame, letters: int = fuzzy.LETTERS) -> DataFrame:
    """``audited`` with title_match filled where the file gives a full reference of the
    citation's surname and year: the id of the entry whose title is nearest to the
    reference's, within one edit for ``letters`` characters, whatever their case; ties go
    to the lesser title, then to the first entry."""
    plain = lambda t: F.lower(X.strip(t))
    given = files.select("file", F.posexplode(X.full_references(F.col("content"))).alias("at", "r")).select("file", "at", X.inline_surname(F.col("r.authors")).alias("surname"), F.col("r.year").cast("int").alias("year"), plain(F.col("r.title")).alias("mine"))
    given = given.groupBy("file", X.lookup_key(F.col("surname"), F.col("year")).alias("lookup_key")).agg(F.min_by("mine", "at").alias("mine"))
    named = bib.groupBy(plain(F.col("title")).alias("theirs")).agg(F.min_by("id", F.struct("pos", "id")).alias("id"))
    near = fuzzy.pairs(given.select(F.col("mine").alias("text")), named.select(F.col("theirs").alias("text")), letters)
    best = near.groupBy("mine").agg(F.min(F.struct("distance", "theirs")).alias("b")).select("mine", F.col("b.theirs").alias("theirs"))
    found = given.join(best, "mine").join(named, "theirs").select("file", "lookup_key", F.col("id").alias("__id"))
    columns = [F.col("__id").alias("title_match") if c == "title_match" else c for c in audited.columns]
    return audited.join(found, ["file", "lookup_key"], "left").select(*columns)


def issues(audited: DataFrame) -> DataFrame:
    """Ambiguous citations (warn) and orphans (info)."""
    quoted = F.concat(F.lit('"'), "raw", F.lit('"'))
    ambiguous = F.concat(quoted, F.lit(" matches "), "matches", F.lit(" BibTeX entries — disambiguate with DOI or journal"))
    return audited.where(F.col("ambiguous") | ~F.col("in_bibtex")).select(
        _severity(F.col("ambiguous")).alias("severity"),
        F.when(F.col("ambiguous"), "ambiguous").otherwise("orphan").alias("type"),
        F.col("raw").alias("citation"),
        "file",
        F.when(F.col("ambiguous"), ambiguous).otherwise(F.concat(quoted, F.lit(" has no BibTeX entry"))).alias("message"),
        F.when(F.col("ambiguous"), F.col("ids")).alias("bib_entries"),
    )


def severities(files: DataFrame, bib: DataFrame) -> DataFrame:
    """Distinct severities of the issues of an audit; they depend on a citation's key alone,
    so each key is looked up once, however many files cite it."""
    keys = keyed(extract(files)).select("surname", "year").distinct().join(lookup(bib), ["surname", "year"], "left")
    return keys.where("matches IS NULL OR matches > 1").select(_severity(F.col("matches") > 1).alias("severity")).distinct()


def _severity(ambiguous: Column) -> Column:
    return F.when(ambiguous, "warn").otherwise("info")


def orphans(files: DataFrame, bib: DataFrame) -> DataFrame:
    return cited(files).join(lookup(bib), ["surname", "year"], "left_anti")


def resolved(files: DataFrame, bib: DataFrame) -> DataFrame:
    return cited(files).join(lookup(bib), ["surname", "year"], "left_semi")


def uncited(files: DataFrame, bib: DataFrame) -> DataFrame:
    """id, title, surname, year of the entries that no file cites by surname and year;
    entries without an author or year can't be cited so and are among them."""
    cited = keyed(extract(files)).select("surname", "year").distinct()
    named = bib.withColumn("surname", F.when(F.size("authors") > 0, X.surname(F.col("authors"))))
    return named.join(cited, ["surname", "year"], "left_anti").select("id", "title", "surname", "year")


def stats(audited: DataFrame) -> DataFrame:
    """One row of counts over an audit."""
    n = lambda test, name: F.count_if(test).alias(name)
    return audited.agg(
        F.count("*").alias("total"),
        n(F.col("in_bibtex"), "in_bibtex"),
        n(~F.col("in_bibtex"), "orphans"),
        n(F.col("has_doi"), "with_doi"),
        n(F.col("ambiguous"), "ambiguous"),
        n(F.col("ambiguous") | ~F.col("in_bibtex"), "issue_count"),
    )


def verbose(audited: DataFrame) -> DataFrame:
    """Status mark of each citation: in the bibliography with a DOI, without, or not."""
    mark = F.when(~F.col("in_bibtex"), "?").when(F.col("has_doi"), "✓").otherwise("~")
    return audited.select("file", "raw", mark.alias("status"))


def labels(audited: DataFrame, bib: DataFrame, works: DataFrame) -> DataFrame:
    """Review label of each citation: ORPHAN without an entry, AMBIGUOUS with several,
    UNVERIFIED without a DOI that the registry has, CONFABULATED if the registry's
    title or authors are others than the entry's (of several works with a DOI the least
    counts, of several entries with an id the last), DRIFT if the citation names another
    co-author or year than the entry and the registry do, else OK.
    """
    entry = bib.groupBy("id").agg(F.max_by(F.struct("authors", "title", X.some(F.col("doi")).alias("doi")), "pos").alias("e"))
    entry = entry.select(F.col("id").alias("__id"), "e", F.col("e.doi").alias("__doi"))
    known = works.groupBy("doi").agg(F.min(F.struct("title", "authors", "year")).alias("w")).withColumnRenamed("doi", "__doi")
    found = audited.withColumn("__id", F.when(F.col("in_bibtex") & ~F.col("ambiguous"), F.get("ids", F.lit(0)))).join(entry, "__id", "left").join(known, "__doi", "left")
    mine, theirs = F.col("e.title"), F.col("w.title")
    other_title = (X.title_similarity(mine, theirs) < 0.5) & ~X.title_contains_all(mine, theirs) & ~X.title_contains_all(theirs, mine)
    named = F.filter(F.transform(F.split(F.col("raw"), P.CO_AUTHORS, -1), lambda x: F.lower(X.first(x, f"^{P.SPACE}*({P.NAME})"))), lambda x: x.isNotNull())
    stranger = F.size(F.array_except(F.slice(named, F.lit(2), F.size(named)), X.surnames(F.col("e.authors")))) > 0
    label = (
        F.when(~F.col("in_bibtex"), "ORPHAN")
        .when(F.col("ambiguous"), "AMBIGUOUS")
        .when(F.col("w").isNull(), "UNVERIFIED")
        .when(other_title | ~X.share_surname(F.col("e.authors"), F.col("w.authors")), "CONFABULATED")
        .when(stranger | (F.col("w.year") != F.col("year")), "DRIFT")
        .otherwise("OK")
    )
    return found.select("file", "raw", "lookup_key", label.alias("label"))
