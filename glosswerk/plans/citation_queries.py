"""Queries of the citation audit: extraction, bibliography, resolution, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswerk.functions import patterns as P
from glosswerk.functions import text as X
from glosswerk.operators import bibliography, citations, fuzzy, report
from glosswerk.operators.settle import kept
from glosswerk.plans import sql as S
from glosswerk.plans.synth import view, with_views


def _files(spark, sf_dir):
    return view(spark, sf_dir, "prose_files")


def _bib(spark, sf_dir):
    return view(spark, sf_dir, "bib_entries")


def _audited(spark, sf_dir, sep=None):
    return citations.audit(_files(spark, sf_dir), _bib(spark, sf_dir), sep)


def extract_inline(spark, sf_dir):
    return citations.extract(_files(spark, sf_dir))


def citation_keys(spark, sf_dir):
    return citations.keyed(citations.extract(_files(spark, sf_dir))).select("file", "pos", "surname", "year", "lookup_key")


def citation_dedup(spark, sf_dir):
    return citations.dedup(citations.extract(_files(spark, sf_dir)))


def bib_lookup(spark, sf_dir):
    return citations.lookup(_bib(spark, sf_dir)).withColumn("ids", F.array_join("ids", ","))


def audit_citations(spark, sf_dir):
    return _audited(spark, sf_dir, ",")


def audit_orphans(spark, sf_dir):
    return citations.orphans(_files(spark, sf_dir), _bib(spark, sf_dir)).select("file", "surname", "year", "raw")


def audit_in_bib(spark, sf_dir):
    return citations.resolved(_files(spark, sf_dir), _bib(spark, sf_dir)).select("file", "surname", "year", "raw")


def audit_ambiguous(spark, sf_dir):
    return _audited(spark, sf_dir, ",").where("ambiguous").select("file", "raw", "lookup_key", "matches", "ids")


def audit_issues(spark, sf_dir):
    return citations.issues(_audited(spark, sf_dir, ","))


def audit_stats(spark, sf_dir):
    return citations.stats(_audited(spark, sf_dir))


def audit_verbose_status(spark, sf_dir):
    return citations.verbose(_audited(spark, sf_dir))


def audit_report(spark, sf_dir):
    """The printed report of the audit with all citations."""
    audited = kept(_audited(spark, sf_dir).drop("ids", "title_match").withColumn("ids", F.lit(None).cast("array<string>")), "audited")
    return report.audit(citations.stats(audited), citations.issues(audited), citations.verbose(audited))


def status_labels(spark, sf_dir):
    return citations.labels(_audited(spark, sf_dir), _bib(spark, sf_dir), view(spark, sf_dir, "registry_works"))


def fuzzy_titles(spark, sf_dir):
    """Mistyped titles and the works within one edit for ten characters of them."""
    typed, works = (view(spark, sf_dir, v).select(F.col("title").alias("text")) for v in ("typed_titles", "works"))
    return fuzzy.pairs(typed, works)


def audit_title_match(spark, sf_dir):
    """Title matches of the citations whose file also has their full reference."""
    files, bib = view(spark, sf_dir, "referenced_prose"), view(spark, sf_dir, "bib_titled")
    return citations.match_titles(citations.audit(files, bib), files, bib).select("file", "lookup_key", "in_bibtex", "title_match")


def uncited_entries(spark, sf_dir):
    return citations.uncited(view(spark, sf_dir, "referenced_prose"), view(spark, sf_dir, "bib_titled"))


def bibtex_entries(spark, sf_dir):
    """Entries of BibTeX texts with nesting, comments, joined values and macros."""
    found = bibliography.parse(view(spark, sf_dir, "bib_text"))
    tag = lambda n: F.col("tags").getItem(n).alias(n)
    return found.select("file", "citation_key", "entry_type", *map(tag, ("title", "author", "journal", "note", "year")), "pos")


def extract_dois(spark, sf_dir):
    return view(spark, sf_dir, "ref_lines").select("file", F.posexplode(X.dois(F.col("content"))).alias("pos", "doi"))


def extract_arxiv_ids(spark, sf_dir):
    return view(spark, sf_dir, "ref_lines").select("file", F.posexplode(X.arxiv_ids(F.col("content"))).alias("pos", "arxiv_id"))


def extract_full_refs(spark, sf_dir):
    return view(spark, sf_dir, "ref_lines").select("file", F.inline(X.full_references(F.col("content"))))


def bib_normalize(spark, sf_dir):
    return bibliography.normalise(view(spark, sf_dir, "bib_raw")).withColumn("authors", F.array_join("authors", "|"))


def bib_last_wins(spark, sf_dir):
    return bibliography.last_wins(bibliography.normalise(view(spark, sf_dir, "bib_raw"))).withColumn("authors", F.array_join("authors", "|"))


_SURNAME = f"lower({S.strip(f"regexp_split_to_array(authors, '{P.AUTHOR_BREAK}')[1]")})"
_CITES = f"""WITH cites AS (
  SELECT file, raw, {S.strip(f"regexp_extract(raw, '{P.INLINE}', 1)")} AS authors, regexp_extract(raw, '{P.INLINE}', 2)::INT AS year, pos
  FROM (SELECT file, unnest(m) AS raw, unnest(range(len(m)))::INT AS pos FROM (SELECT file, {S.found("content", P.INLINE)} AS m FROM prose_files) x) y),
keyed AS (SELECT *, {_SURNAME} AS surname FROM cites),
firsts AS (
  SELECT file, surname, year, arg_min(raw, pos) AS raw, arg_min(authors, pos) AS authors, min(pos) AS pos, count(*) AS mentions FROM keyed GROUP BY file, surname, year)"""
_LOOKUP = f"""lookup AS (
  SELECT lower({S.strip("string_split(authors[1], ',')[1]")}) AS surname, year, count(*) AS matches, string_agg(id, ',' ORDER BY pos) AS ids, bool_or(doi IS NOT NULL) AS has_doi
  FROM bib_entries WHERE len(authors) > 0 GROUP BY ALL)"""
_AUDIT = f"""{_CITES}, {_LOOKUP},
audited AS (
  SELECT raw, authors, f.year, file, pos, mentions, f.surname || '_' || f.year AS lookup_key, matches IS NOT NULL AS in_bibtex, coalesce(has_doi, false) AS has_doi,
         coalesce(matches, 0) > 1 AS ambiguous, coalesce(matches, 0) AS matches, ids, NULL::VARCHAR AS title_match
  FROM firsts f LEFT JOIN lookup l ON f.surname = l.surname AND f.year = l.year)"""


def audit_sql(select: str) -> str:
    return with_views("prose_files bib_entries", f"{_AUDIT} {select}")


def _per_line(pattern: str, name: str) -> str:
    return with_views("ref_lines", f"SELECT file, unnest(m) AS {name}, unnest(range(len(m)))::INT AS pos FROM (SELECT file, {S.found('content', pattern, 1)} AS m FROM ref_lines) x")


def _tag(name: str) -> str:
    return f"nullif(tags['{name}'], '')"


def _bare(x: str) -> str:
    return f"nullif({S.strip(f"regexp_replace({x}, '[{{}}]', '', 'g')")}, '')"


_NORMAL = f"""WITH entries AS (
  SELECT lower(coalesce(citation_key, '')) AS id,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce({_tag("author")}, ''), '[{{}}]', '', 'g'), '(?i){P.SPACE}+and{P.SPACE}+'), lambda a: {S.strip("a")}), lambda a: a <> '') AS authors,
    coalesce({_bare(_tag("title"))}, '') AS title, try_cast(regexp_extract(coalesce({_tag("year")}, '0'), '^{P.SPACE}*([+-]?\\d+)', 1) AS INT) AS year,
    coalesce({_bare(f"coalesce({_tag('journal')}, {_tag('booktitle')})")}, '') AS journal, {_bare(_tag("doi"))} AS doi,
    {S.first(f"coalesce({_tag('url')}, '')", P.PREPRINT_URL)} AS arxiv, {_bare(_tag("volume"))} AS volume, {_bare(_tag("pages"))} AS pages, pos
  FROM bib_raw)"""

_QUERIES = {
    extract_inline: with_views("prose_files", f"{_CITES} SELECT file, raw, authors, year, pos FROM cites"),
    citation_keys: with_views("prose_files", f"{_CITES} SELECT file, pos, surname, year, surname || '_' || year AS lookup_key FROM keyed"),
    citation_dedup: with_views("prose_files", f"{_CITES} SELECT * FROM firsts"),
    bib_lookup: with_views("bib_entries", f"WITH {_LOOKUP} SELECT * FROM lookup"),
    audit_citations: audit_sql("SELECT * FROM audited"),
    audit_orphans: with_views("prose_files bib_entries", f"{_CITES}, {_LOOKUP} SELECT file, surname, year, raw FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM lookup l WHERE l.surname = f.surname AND l.year = f.year)"),
    audit_in_bib: with_views("prose_files bib_entries", f"{_CITES}, {_LOOKUP} SELECT file, surname, year, raw FROM firsts f WHERE EXISTS (SELECT 1 FROM lookup l WHERE l.surname = f.surname AND l.year = f.year)"),
    audit_ambiguous: audit_sql("SELECT file, raw, lookup_key, matches, ids FROM audited WHERE ambiguous"),
    audit_issues: audit_sql("""SELECT CASE WHEN ambiguous THEN 'warn' ELSE 'info' END AS severity, CASE WHEN ambiguous THEN 'ambiguous' ELSE 'orphan' END AS type, raw AS citation, file,
        CASE WHEN ambiguous THEN '"' || raw || '" matches ' || matches || ' BibTeX entries — disambiguate with DOI or journal' ELSE '"' || raw || '" has no BibTeX entry' END AS message,
        CASE WHEN ambiguous THEN ids END AS bib_entries FROM audited WHERE ambiguous OR NOT in_bibtex"""),
    audit_stats: audit_sql("""SELECT count(*) AS total, count(*) FILTER (in_bibtex) AS in_bibtex, count(*) FILTER (NOT in_bibtex) AS orphans, count(*) FILTER (has_doi) AS with_doi,
        count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (ambiguous OR NOT in_bibtex) AS issue_count FROM audited"""),
    audit_verbose_status: audit_sql("SELECT file, raw, CASE WHEN NOT in_bibtex THEN '?' WHEN has_doi THEN '✓' ELSE '~' END AS status FROM audited"),
    audit_report: audit_sql(f"""
        SELECT 0 AS part, '' AS a, printf('%02d', k) AS b, '  ' || name || ': ' || value AS line FROM (SELECT unnest(['total', 'in_bibtex', 'orphans', 'with_doi', 'ambiguous', 'issue_count']) AS name, unnest(range(6)) AS k,
          unnest([count(*), count(*) FILTER (in_bibtex), count(*) FILTER (NOT in_bibtex), count(*) FILTER (has_doi), count(*) FILTER (ambiguous), count(*) FILTER (ambiguous OR NOT in_bibtex)]) AS value FROM audited) s
        UNION ALL SELECT 1, file, raw, '  ' || CASE WHEN ambiguous THEN '⚠ [ambiguous] ' ELSE 'ℹ [orphan] ' END || raw || chr(10) || '    ' || file || chr(10) || '    "' || raw || '"' || CASE WHEN ambiguous THEN ' matches ' || matches || ' BibTeX entries — disambiguate with DOI or journal' ELSE ' has no BibTeX entry' END
        FROM audited WHERE ambiguous OR NOT in_bibtex
        UNION ALL SELECT 2, file, raw, '  ' || CASE WHEN NOT in_bibtex THEN '?' WHEN has_doi THEN '✓' ELSE '~' END || ' ' || raw || '  (' || file || ')' FROM audited"""),
    status_labels: with_views("prose_files bib_entries registry_works", f"""{_AUDIT},
        known AS (SELECT a.file, a.raw, a.lookup_key, a.in_bibtex, a.ambiguous, a.year, e.authors AS mine, w.authors AS theirs, w.year AS actual, w.doi IS NOT NULL AS found, {S.words("coalesce(e.title, '')")} AS x, {S.words("coalesce(w.title, '')")} AS y,
            list_filter(list_transform(regexp_split_to_array(a.raw, '{P.CO_AUTHORS}'), lambda p: lower(nullif(regexp_extract(p, '^{P.SPACE}*({P.NAME})', 1), ''))), lambda n: n IS NOT NULL) AS named
          FROM audited a LEFT JOIN bib_entries e ON a.in_bibtex AND NOT a.ambiguous AND e.id = a.ids LEFT JOIN registry_works w ON w.doi = e.doi),
        surnames AS (SELECT *, list_transform(mine, lambda n: lower({S.strip("string_split(n, ',')[1]")})) AS m, list_transform(theirs, lambda n: lower({S.strip("string_split(n, ',')[1]")})) AS t FROM known)
        SELECT file, raw, lookup_key, CASE WHEN NOT in_bibtex THEN 'ORPHAN' WHEN ambiguous THEN 'AMBIGUOUS' WHEN NOT found THEN 'UNVERIFIED'
          WHEN ({S.similarity("x", "y")} < 0.5 AND NOT {S.contains_all("x", "y")} AND NOT {S.contains_all("y", "x")}) OR len(list_intersect(m, t)) = 0 THEN 'CONFABULATED'
          WHEN len(list_filter(named[2:], lambda n: NOT list_contains(m, n))) > 0 OR actual <> year THEN 'DRIFT' ELSE 'OK' END AS label FROM surnames"""),
    fuzzy_titles: with_views("typed_titles works", """WITH a AS (SELECT DISTINCT title AS mine FROM typed_titles), b AS (SELECT DISTINCT title AS theirs FROM works)
        SELECT mine, theirs, levenshtein(mine, theirs)::INT AS distance FROM a JOIN b ON abs(length(mine) - length(theirs)) <= greatest(length(mine), length(theirs)) // 10 WHERE levenshtein(mine, theirs) <= greatest(length(mine), length(theirs)) // 10"""),
    audit_title_match: with_views("referenced_prose bib_titled", _AUDIT.replace("prose_files", "referenced_prose").replace("bib_entries", "bib_titled") + f""",
        given AS (SELECT file, {_SURNAME} || '_' || year AS lookup_key, arg_min(lower({S.strip("title")}), place) AS mine FROM (
          SELECT file, place, {S.first("raw", P.FULL_REFERENCE, 1)} AS authors, {S.first("raw", P.FULL_REFERENCE, 2)} AS year, {S.first("raw", P.FULL_REFERENCE, 3)} AS title
          FROM (SELECT file, unnest(m) AS raw, unnest(range(len(m))) AS place FROM (SELECT file, {S.found("content", P.FULL_REFERENCE)} AS m FROM referenced_prose) x) y) z GROUP BY ALL),
        near AS (SELECT file, lookup_key, b.id, row_number() OVER (PARTITION BY file, lookup_key ORDER BY levenshtein(mine, lower(b.title)), lower(b.title), pos) AS n FROM given JOIN bib_titled b
          ON levenshtein(mine, lower(b.title)) <= greatest(length(mine), length(b.title)) // 10)
        SELECT a.file, a.lookup_key, a.in_bibtex, n.id AS title_match FROM audited a LEFT JOIN near n ON n.file = a.file AND n.lookup_key = a.lookup_key AND n.n = 1"""),
    uncited_entries: with_views("referenced_prose bib_titled", _CITES.replace("prose_files", "referenced_prose") + f""" SELECT id, title, lower({S.strip("string_split(authors[1], ',')[1]")}) AS surname, year FROM bib_titled b
        WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.surname = lower({S.strip("string_split(b.authors[1], ',')[1]")}) AND f.year = b.year)"""),
    bibtex_entries: with_views("part_files", """SELECT file, 'P' || p_partkey AS citation_key, 'article' AS entry_type, 'C# in ' || p_name AS title, 'A {"Q"} Author and {B} ' || p_brand AS author,
        'Journal of Parts ' || p_type AS journal, 'see @misc{b, title={X}} there' AS note, CAST(1970 + p_size AS VARCHAR) AS year, row_number() OVER (PARTITION BY file ORDER BY p_partkey) - 1 AS pos FROM part_files"""),
    extract_dois: _per_line(P.DOI, "doi"),
    extract_arxiv_ids: _per_line(P.ARXIV, "arxiv_id"),
    extract_full_refs: with_views("ref_lines", f"""SELECT file, raw, {", ".join(f"{S.first('raw', P.FULL_REFERENCE, k)} AS {n}" for k, n in enumerate(("authors", "year", "title", "venue", "volume"), 1))}
        FROM (SELECT file, unnest({S.found("content", P.FULL_REFERENCE)}) AS raw FROM ref_lines) x"""),
    bib_normalize: with_views("bib_raw", f"{_NORMAL} SELECT * REPLACE (array_to_string(authors, '|') AS authors) FROM entries"),
    bib_last_wins: with_views("bib_raw", f"""{_NORMAL}, ends AS (SELECT id, min(pos) AS a, max(pos) AS b FROM entries GROUP BY id)
        SELECT e.id, array_to_string(authors, '|') AS authors, title, year, journal, doi, arxiv, volume, pages, a AS pos FROM ends JOIN entries e ON e.id = ends.id AND e.pos = b"""),
}
QUERIES = {f.__name__: f for f in _QUERIES}
ORACLES = {f.__name__: sql for f, sql in _QUERIES.items()}
