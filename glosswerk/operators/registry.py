"""Verification of reference lists against a bibliographic registry snapshot.

A snapshot table stands for the remote registry, so a lookup is an equi-join; the
per-paper budgets are ``row_number() <= k``, which Spark limits before its shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswerk.functions import patterns as P
from glosswerk.functions import text as X
from glosswerk.operators.settle import settled
from glosswerk.operators.titles import TitleIndex

DOI_BUDGET = 15
TITLE_BUDGET = 5
MISMATCH_BELOW = 0.5
NOT_FOUND_BELOW = 0.3
LEAST_SCORE = 50
HITS = 3
ENTRY, FEED = "<entry>", "<feed"


def papers(feeds: DataFrame) -> DataFrame:
    """id, title, authors, published, categories of every entry in (feed, xml) that has an
    id and a title."""
    parts = F.split("xml", ENTRY, -1)
    return _papers(feeds.select(F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("e")))


def papers_in(spark: SparkSession, *paths: str) -> DataFrame:
    """``papers`` of feed files (or folders of them) of any size.

    Spark's text source takes the entry tag for the end of a line, so a file is split over
    tasks at any byte, and an entry that crosses a split is read once, by the task in whose
    split it begins.  What stands before a file's first entry is no entry: it holds the
    feed's own tag.
    """
    pieces = spark.read.option("lineSep", ENTRY).text(list(paths)).withColumnRenamed("value", "e")
    return _papers(pieces.where(~F.contains("e", F.lit(FEED))))


def _papers(entry: DataFrame) -> DataFrame:
    found = entry.select(
        F.regexp_replace(F.regexp_extract("e", P.ENTRY_ID, 1), r"v\d+\z", "").alias("id"),
        X.strip(F.regexp_extract("e", P.ENTRY_TITLE, 1)).alias("title"),
        F.regexp_extract_all("e", F.lit(P.ENTRY_NAME), F.lit(1)).alias("authors"),
        X.first(F.col("e"), P.ENTRY_PUBLISHED).alias("published"),
        F.regexp_extract_all("e", F.lit(P.ENTRY_CATEGORY), F.lit(1)).alias("categories"),
    )
    return found.where("id != '' AND title != ''")


def newest(papers_: DataFrame, count: int, category: str | None = None) -> DataFrame:
    """The ``count`` papers submitted last, of one category or all; undated ones come
    last, ties by id.  ISO dates sort as text."""
    chosen = papers_ if category is None else papers_.where(F.array_contains("categories", F.lit(category)))
    return chosen.orderBy(F.col("published").desc_nulls_last(), "id").limit(count)


def items(pages: DataFrame) -> DataFrame:
    """paper, pos (from 0), item, doi of the reference items of (paper, html).

    Only what follows the last ``References`` counts; without it there are none.
    """
    section = F.when(F.contains("html", F.lit("References")), F.substring_index("html", "References", -1))
    found = pages.select("paper", F.posexplode(F.regexp_extract_all(section, F.lit(P.REFERENCE_ITEM), F.lit(1))).alias("pos", "item"))
    return found.select("paper", "pos", "item", _item_doi(F.col("item")).alias("doi"))


def _item_doi(item: Column) -> Column:
    return X.some(F.regexp_replace(F.regexp_extract(item, P.REFERENCE_DOI, 1), "['\"]+\\z", ""))


def _item_clean(item: Column) -> Column:
    """Without tags."""
    return X.strip(F.regexp_replace(F.regexp_replace(item, "<[^>]+>", " "), f"{P.SPACE}+", " "))


def _item_title(item: Column, clean: Column) -> Column:
    return F.coalesce(X.first(item, P.REFERENCE_CITE), X.some(X.strip(F.regexp_extract(clean, P.REFERENCE_TITLE, 1))), X.some(X.strip(F.regexp_extract(item, P.REFERENCE_ITALIC, 1))))


def parsed(found: DataFrame) -> DataFrame:
    """``items`` with title, year and raw in the place of the item."""
    item, clean = F.col("item"), F.col("clean")
    found = found.withColumn("clean", _item_clean(item))
    found = found.withColumns({"title": _item_title(item, clean), "year": X.first(clean, P.REFERENCE_YEAR).try_cast("int"), "raw": F.left(clean, F.lit(200))})
    return found.drop("item", "clean")


def references(pages: DataFrame) -> DataFrame:
    """paper, pos (from 0), doi, title, year, raw of the reference items of (paper, html)."""
    return parsed(items(pages)).select("paper", "pos", "doi", "title", "year", "raw")


def _journal():
    return F.col("doi").isNotNull() & ~F.startswith("doi", F.lit(P.PREPRINT_DOI))


def _kind():
    return F.when(_journal(), "doi").when(F.col("doi").isNull() & F.col("title").isNotNull(), "title")


def _first_of(rows: DataFrame, most: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("paper").orderBy("pos"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most)


def budget(refs: DataFrame) -> DataFrame:
    """The references that are checked: kind ``doi`` or ``title``, nth of its kind."""
    nth = F.row_number().over(Window.partitionBy("paper", "kind").orderBy("pos"))
    ranked = refs.withColumn("kind", _kind()).where("kind IS NOT NULL").withColumn("nth", nth)
    return ranked.where(F.col("nth") <= F.when(F.col("kind") == "doi", DOI_BUDGET).otherwise(TITLE_BUDGET))


def dois_in_budget(found: DataFrame) -> DataFrame:
    """The ``DOI_BUDGET`` first items with a DOI to look up, of each paper; titles, years
    and texts are parsed for these alone."""
    return parsed(_first_of(found.where(_journal()), DOI_BUDGET))


def titles_in_budget(found: DataFrame) -> DataFrame:
    """The ``TITLE_BUDGET`` first items with a title alone, of each paper."""
    return _first_of(parsed(found.where("doi IS NULL")).where("title IS NOT NULL"), TITLE_BUDGET)


def check_dois(found: DataFrame, works: DataFrame) -> DataFrame:
    """Outcome of each DOI in budget of ``items``: ``ok``, ``DOI not found`` or ``DOI-title
    mismatch``.  The similarity is kept unrounded; it is what thresholds look at.
    """
    return _doi_outcomes(dois_in_budget(found), works)


def _doi_outcomes(asked: DataFrame, works: DataFrame) -> DataFrame:
    known = works.select("doi", F.col("title").alias("actual"), F.lit(True).alias("verified"))
    checked = asked.join(known, "doi", "left").withColumn("similarity", X.title_similarity(F.col("title"), F.col("actual")))
    mismatch = F.col("title").isNotNull() & (F.col("similarity") < MISMATCH_BELOW) & ~X.title_contains_all(F.col("title"), F.col("actual"))
    outcome = F.when(F.col("verified").isNull(), "DOI not found").when(mismatch, "DOI-title mismatch").otherwise("ok")
    return checked.select("paper", "pos", "doi", "title", "raw", "actual", "similarity", outcome.alias("outcome"))


def check_titles(found: DataFrame, hits: DataFrame) -> DataFrame:
    """Outcome of each title in budget of ``items`` against its best hit (query, rank,
    title, score)."""
    return _title_outcomes(titles_in_budget(found), hits)


def _title_outcomes(asked: DataFrame, hits: DataFrame) -> DataFrame:
    best = hits.where("rank = 1").select(F.col("query").alias("title"), F.col("title").alias("best_match"), "score")
    checked = asked.join(best, "title", "left").withColumn("similarity", X.title_similarity(F.col("title"), F.col("best_match")))
    bad = (F.coalesce("score", F.lit(0.0)) > LEAST_SCORE) & (F.col("similarity") < NOT_FOUND_BELOW)
    return checked.select("paper", "pos", "title", "raw", "best_match", "score", "similarity", F.when(bad, "Title not found in CrossRef").otherwise("ok").alias("outcome"))


def summaries(pages: DataFrame) -> DataFrame:
    """paper, refs, verified, skipped_arxiv, dois, titles of (paper, html), one row for each
    paper that has references: counts, and what is checked of them (pos, doi, title, raw).

    A paper's items stay in its row, so none is shuffled and each is parsed once; what is
    left of a paper is at most ``DOI_BUDGET`` and ``TITLE_BUDGET`` of its references.
    """
    section = F.when(F.contains("html", F.lit("References")), F.substring_index("html", "References", -1))
    found = F.transform(F.regexp_extract_all(section, F.lit(P.REFERENCE_ITEM), F.lit(1)), lambda x, i: F.struct(i.alias("pos"), x.alias("item"), _item_doi(x).alias("doi")))
    # explode keeps a list from being worked out anew for each of its uses
    listed = pages.select("paper", F.explode(F.array(found)).alias("items")).where(F.size("items") > 0)
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    parts = lambda x: bound(_item_clean(x["item"]), lambda c: F.struct(x["pos"].alias("pos"), x["doi"].alias("doi"), _item_title(x["item"], c).alias("title"), F.left(c, F.lit(200)).alias("raw")))
    journal = F.filter("items", lambda x: x["doi"].isNotNull() & ~F.startswith(x["doi"], F.lit(P.PREPRINT_DOI)))
    titled = F.filter(F.transform(F.filter("items", lambda x: x["doi"].isNull()), parts), lambda x: x["title"].isNotNull())
    listed = listed.select("paper", F.size("items").cast("long").alias("refs"), F.size(F.filter("items", lambda x: F.startswith(x["doi"], F.lit(P.PREPRINT_DOI)))).cast("long").alias("skipped_arxiv"), F.explode(F.array(F.struct(journal.alias("journal"), titled.alias("titled")))).alias("k"))
    first = lambda c, n: F.slice(c, 1, n)
    verified = F.least(F.size("k.journal"), F.lit(DOI_BUDGET)) + F.least(F.size("k.titled"), F.lit(TITLE_BUDGET))
    return listed.select("paper", "refs", verified.cast("long").alias("verified"), "skipped_arxiv", F.transform(first("k.journal", DOI_BUDGET), parts).alias("dois"), first("k.titled", TITLE_BUDGET).alias("titles"))


def summary_issues(found: DataFrame, works: DataFrame, hits: DataFrame) -> DataFrame:
    """``issues`` of ``summaries``."""
    return issues(_doi_outcomes(found.select("paper", F.inline("dois")), works), _title_outcomes(found.select("paper", F.inline("titles")), hits))


def issues(doi_checks: DataFrame, title_checks: DataFrame) -> DataFrame:
    """All issues with their texts cut to display length."""
    cut = lambda c, n: F.left(F.col(c), F.lit(n))
    bad = lambda df: df.where("outcome != 'ok'")
    mismatch = F.col("outcome") == "DOI-title mismatch"
    one = bad(doi_checks).select("paper", cut("raw", 150).alias("ref"), F.col("outcome").alias("issue"), F.when(mismatch, cut("title", 100)).alias("claimed"), F.when(mismatch, cut("actual", 100)).alias("actual"), F.when(mismatch, F.round("similarity", 2)).alias("similarity"), "doi")
    two = bad(title_checks).select("paper", cut("raw", 150).alias("ref"), F.col("outcome").alias("issue"), cut("title", 100).alias("claimed"), cut("best_match", 100).alias("best_match"), F.round("similarity", 2).alias("similarity"))
    return one.unionByName(two, allowMissingColumns=True)


def paper_stats(listed: DataFrame, refs: DataFrame, found: DataFrame) -> DataFrame:
    """Per paper (id): refs, verified, issues, skipped_arxiv, skipped (``no HTML``)."""
    per = refs.withColumn("kind", _kind()).groupBy(F.col("paper").alias("id")).agg(
        F.count("*").alias("refs"),
        (F.least(F.count_if(F.col("kind") == "doi"), F.lit(DOI_BUDGET)) + F.least(F.count_if(F.col("kind") == "title"), F.lit(TITLE_BUDGET))).alias("verified"),
        F.count_if(F.startswith("doi", F.lit(P.PREPRINT_DOI))).alias("skipped_arxiv"),
    )
    return _paper_stats(listed, per, found)


def summary_stats(listed: DataFrame, found: DataFrame, issues_: DataFrame) -> DataFrame:
    """``paper_stats`` of ``summaries``."""
    return _paper_stats(listed, found.select(F.col("paper").alias("id"), "refs", "verified", "skipped_arxiv"), issues_)


def _paper_stats(listed: DataFrame, per: DataFrame, issues_: DataFrame) -> DataFrame:
    bad = issues_.groupBy(F.col("paper").alias("id")).agg(F.count("*").alias("issues"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return listed.select("id").join(per, "id", "left").join(bad, "id", "left").select("id", zero("refs"), zero("verified"), zero("issues"), zero("skipped_arxiv"), F.when(F.col("refs").isNull(), "no HTML").alias("skipped"))


def stats(papers_: DataFrame) -> DataFrame:
    """One row over per-paper statistics; skipped papers count as audited."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return papers_.agg(F.count("*").alias("papers_audited"), total("refs").alias("total_refs"), total("verified").alias("refs_checked"), total("issues").alias("issues_found"), F.coalesce(F.try_divide(total("issues").cast("double"), total("verified").cast("double")), F.lit(0.0)).alias("issue_rate"))


def verify(dois: DataFrame, works: DataFrame, *fallbacks: DataFrame) -> DataFrame:
    """Each doi with its record and the number of the snapshot that has it (from 1),
    the first that does; verified false and null otherwise."""
    tables = [w.select("doi", F.struct("title", "authors", "journal", "year").alias("w")) for w in (works, *fallbacks)]
    joined = reduce(lambda df, kw: df.join(kw[1].withColumnRenamed("w", f"w{kw[0]}"), "doi", "left"), enumerate(tables, 1), dois)
    numbers = range(1, len(tables) + 1)
    record = F.coalesce(*(F.col(f"w{k}") for k in numbers))
    source = F.coalesce(*(F.when(F.col(f"w{k}").isNotNull(), k) for k in numbers))
    return joined.select("doi", source.isNotNull().alias("verified"), source.alias("snapshot"), record["title"].alias("title"), record["authors"].alias("authors"), record["journal"].alias("journal"), record["year"].alias("year"), F.when(source.isNull(), "not in the snapshot").alias("error"))


def matches(queries: DataFrame, works: DataFrame, hits: int = HITS, floor: float = 0.0) -> DataFrame:
    """The ``hits`` works most similar to each query title among those that share a word
    with it and reach ``floor``: query, rank, doi, title, similarity."""
    return TitleIndex.build(works).search(queries, hits, floor)


def search(queries: DataFrame, works: DataFrame, hits: int = HITS) -> DataFrame:
    """``matches`` without a floor, with authors, journal and year of the work and
    score (0 to 100): how much of the query the work holds, by rarity.  Words weigh ln(1 + works / works with the word); those of the
    query that no work has weigh nothing.  Unlike the similarity it does not fall
    with what else the titles say, so a high score and a low similarity can meet.
    """
    index = TitleIndex.build(works)
    found = settled(index.search(queries, hits))
    weights = index.frequencies.select("w", F.log1p(F.lit(float(works.count())) / F.col("df")).alias("weight"))
    asked = found.select("query").distinct().select("query", F.explode(X.words(F.col("query"))).alias("w"))
    known = asked.join(weights, "w").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("w", "weight"))).alias("known"))
    total = lambda ks: F.aggregate(ks, F.lit(0.0), lambda s, k: s + k["weight"])
    shared = F.filter("known", lambda k: F.array_contains(X.words(F.col("title")), k["w"]))
    scored = found.join(known, "query").select("query", "rank", "doi", "title", (100 * total(shared) / total(F.col("known"))).alias("score"), "similarity")
    about = works.groupBy("doi").agg(F.min(F.struct("authors", "journal", "year")).alias("about"))
    return scored.join(about, "doi").select("query", "rank", "doi", "title", "about.authors", "about.journal", "about.year", "score", "similarity")


# Where a registry's answer keeps what is needed of a work.
_WORK = "struct<DOI:string,score:double,author:array<struct<family:string,given:string>>,title:array<string>,`container-title`:array<string>,published:struct<`date-parts`:array<array<int>>>>"


def _projected(work):
    """title, authors (``family, given``), journal, year of a registry record; a missing
    name reads ``undefined``, as such records are printed elsewhere."""
    name = lambda x: F.coalesce(x, F.lit("undefined"))
    first = lambda x: F.coalesce(F.get(x, F.lit(0)), F.lit(""))
    year = F.nullif(F.get(F.get(work["published"]["date-parts"], F.lit(0)), F.lit(0)), F.lit(0))
    authors = F.transform(F.coalesce(work["author"], F.array().cast("array<struct<family:string,given:string>>")), lambda a: F.concat_ws(", ", name(a["family"]), name(a["given"])))
    return {"title": first(work["title"]), "authors": authors, "journal": first(work["container-title"]), "year": year}


def records(answers: DataFrame) -> DataFrame:
    """doi, verified, title, authors, journal, year, error of a registry's raw answers
    (doi, status, body, and error where no answer came); a ``works`` snapshot is the
    verified ones of them."""
    body = F.from_json("body", f"struct<message:{_WORK}>")["message"]
    error = F.when(F.coalesce(F.col("status") != 200, F.lit(True)), F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("none")))).when(body.isNull(), "parse error")
    error = F.coalesce("error", error) if "error" in answers.columns else error
    found = answers.select("doi", error.alias("error"), body.alias("work"))
    kept = {n: F.when(F.col("error").isNull(), c) for n, c in _projected(F.col("work")).items()}
    return found.select("doi", F.col("error").isNull().alias("verified"), *(c.alias(n) for n, c in kept.items()), "error")


def hit_records(answers: DataFrame) -> DataFrame:
    """query, rank, doi, title, authors, year, score of a registry's raw search answers
    (query, status, body); failed or broken answers have no hits."""
    body = F.from_json("body", f"struct<message:struct<items:array<{_WORK}>>>")["message"]["items"]
    found = answers.where("status = 200").select("query", F.posexplode(body).alias("pos", "work"))
    p = _projected(F.col("work"))
    return found.select("query", (F.col("pos") + 1).alias("rank"), F.col("work.DOI").alias("doi"), p["title"].alias("title"), p["authors"].alias("authors"), p["year"].alias("year"), F.coalesce("work.score", F.lit(0.0)).alias("score"))
