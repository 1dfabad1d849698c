"""Column functions over text: extraction, keys and title similarity.

Everything here is an expression of built-in functions, so it stays inside code
generation.  A pattern is searched once for whole matches; groups are then taken
from the short matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswerk.functions import patterns as P


def strip(x: Column) -> Column:
    """Without white space (any of ``patterns.SPACE``) at either end."""
    return F.btrim(x, F.lit(P.SPACES))


def some(x: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(x, F.lit(""))


def first(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return some(F.regexp_extract(x, pattern, group))


def inline_citations(content: Column) -> Column:
    """array<struct<raw, authors, year, pos>> in text order."""
    found = F.regexp_extract_all(content, F.lit(P.INLINE), F.lit(0))
    return F.transform(
        found,
        lambda m, i: F.struct(
            m.alias("raw"),
            strip(F.regexp_extract(m, P.INLINE, 1)).alias("authors"),
            F.regexp_extract(m, P.INLINE, 2).cast("int").alias("year"),
            i.alias("pos"),
        ),
    )


def dois(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(P.DOI), F.lit(1))


def arxiv_ids(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(P.ARXIV), F.lit(1))


def full_references(content: Column) -> Column:
    """array<struct<raw, authors, year, title, venue, volume>> of bullet lines."""
    found = F.regexp_extract_all(content, F.lit(P.FULL_REFERENCE), F.lit(0))
    names = ("authors", "year", "title", "venue", "volume")
    return F.transform(found, lambda m: F.struct(m.alias("raw"), *(first(m, P.FULL_REFERENCE, k).alias(n) for k, n in enumerate(names, 1))))


def inline_surname(authors: Column) -> Column:
    return F.lower(strip(F.get(F.split(authors, P.AUTHOR_BREAK, -1), F.lit(0))))


def first_three(names: Column, sep: str) -> Column:
    """Up to three names, and whether there are more."""
    return F.concat(F.array_join(F.slice(names, 1, 3), sep), F.when(F.size(names) > 3, " et al.").otherwise(""))


def surname(authors: Column) -> Column:
    """Of a bibliography entry: its first author up to the comma."""
    return F.lower(strip(F.get(F.split(F.get(authors, F.lit(0)), ",", -1), F.lit(0))))


def surnames(authors: Column) -> Column:
    """Lower-case surnames of ``Surname, Given`` names."""
    return F.transform(authors, lambda x: F.lower(strip(F.get(F.split(x, ",", -1), F.lit(0)))))


def share_surname(claimed: Column, actual: Column) -> Column:
    """Do two author lists share a surname?"""
    return F.coalesce(F.arrays_overlap(surnames(claimed), surnames(actual)), F.lit(False))


def lookup_key(name: Column, year: Column) -> Column:
    return F.concat(name, F.lit("_"), year.cast("string"))


def words(title: Column) -> Column:
    """Distinct words of three ASCII word characters or more; other characters vanish."""
    plain = F.regexp_replace(F.lower(title), f"[^A-Za-z0-9_{P.SPACE[1:]}", "")
    return F.array_distinct(F.filter(F.split(plain, f"{P.SPACE}+", -1), lambda w: F.length(w) > 2))


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets, 0 if either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0)) * ((F.size(a) > 0) & (F.size(b) > 0)).cast("double")


def title_similarity(a: Column, b: Column) -> Column:
    return word_similarity(words(F.coalesce(a, F.lit(""))), words(F.coalesce(b, F.lit(""))))


def title_contains_all(claimed: Column, actual: Column) -> Column:
    """Are all words of ``actual`` in ``claimed``?  False without any word."""
    have, need = words(F.coalesce(claimed, F.lit(""))), words(F.coalesce(actual, F.lit("")))
    return (F.size(need) > 0) & (F.size(F.array_except(need, have)) == 0)


def notebook_label(file: Column) -> Column:
    """``14_2_x.ipynb`` to ``NB14.2``; null where the name starts with no digit."""
    minor = first(file, P.NOTEBOOK_NAME, 2)
    return F.concat(F.lit("NB"), F.concat_ws(".", first(file, P.NOTEBOOK_NAME, 1), minor))


def anchor(label: Column, stem: Column) -> Column:
    """Heading anchor; only the first dot of a label goes."""
    return F.concat(F.regexp_replace(F.lower(label), r"^([^.]*)\.", "$1"), F.lit("-"), F.replace(stem, F.lit("_"), F.lit("-")))
