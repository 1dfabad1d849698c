"""Queries of reference lists against a registry snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswerk.functions import patterns as P
from glosswerk.functions import text as X
from glosswerk.operators import registry as R
from glosswerk.operators import citations, report
from glosswerk.operators.settle import kept
from glosswerk.plans import claim_queries
from glosswerk.plans import sql as S
from glosswerk.plans.synth import table, view, with_views


def atom_entries(spark, sf_dir):
    found = R.papers(view(spark, sf_dir, "feed_xml"))
    return found.select("id", "title", F.array_join("authors", "|").alias("authors"), "published", F.array_join("categories", "|").alias("categories"))


def arxiv_listing(spark, sf_dir):
    """The ten papers of one category that were submitted last: a top-k report."""
    found = R.newest(R.papers(view(spark, sf_dir, "feed_xml")), 10, "cs.AI")
    return found.select("id", F.left("title", F.lit(70)).alias("title"), X.first_three(F.col("authors"), ", ").alias("authors"), "published")


def html_refs(spark, sf_dir):
    return R.references(view(spark, sf_dir, "paper_html"))


def ref_budget(spark, sf_dir):
    return R.budget(html_refs(spark, sf_dir)).select("paper", "pos", "kind", "nth")


def _items(spark, sf_dir):
    return R.items(view(spark, sf_dir, "paper_html"))


def _doi_checks(spark, sf_dir):
    return R.check_dois(_items(spark, sf_dir), view(spark, sf_dir, "works"))


def _title_checks(spark, sf_dir):
    return R.check_titles(_items(spark, sf_dir), view(spark, sf_dir, "search_hits"))


def doi_checks(spark, sf_dir):
    return _doi_checks(spark, sf_dir).select("paper", "pos", "doi", F.round("similarity", 9).alias("similarity"), "outcome")


def doi_mismatch(spark, sf_dir):
    return _doi_checks(spark, sf_dir).where("outcome = 'DOI-title mismatch'").select("paper", "pos", "doi", "title", "actual")


def doi_not_found(spark, sf_dir):
    return _doi_checks(spark, sf_dir).where("outcome = 'DOI not found'").select("paper", "pos", "doi", "title")


def title_not_found(spark, sf_dir):
    return _title_checks(spark, sf_dir).where("outcome != 'ok'").select("paper", "pos", "title", "best_match", "score")


def _summaries(spark, sf_dir):
    return kept(R.summaries(view(spark, sf_dir, "paper_html")), "papers")


def _summary_issues(spark, sf_dir, found):
    return R.summary_issues(found, view(spark, sf_dir, "works"), view(spark, sf_dir, "search_hits"))


def reference_issues(spark, sf_dir):
    return _summary_issues(spark, sf_dir, _summaries(spark, sf_dir))


def arxiv_paper_stats(spark, sf_dir):
    found = _summaries(spark, sf_dir)
    listed = R.papers(view(spark, sf_dir, "feed_xml")).select("id")
    return R.summary_stats(listed, found, _summary_issues(spark, sf_dir, found))


def arxiv_stats(spark, sf_dir):
    return R.stats(arxiv_paper_stats(spark, sf_dir)).withColumn("issue_rate", F.round("issue_rate", 9))


def verify_dois(spark, sf_dir):
    """Every DOI cited anywhere, looked up in a first and then a second snapshot."""
    dois = _items(spark, sf_dir).where("doi IS NOT NULL").select("doi").distinct()
    found = R.verify(dois, view(spark, sf_dir, "works"), view(spark, sf_dir, "works2"))
    return found.withColumn("authors", F.array_join("authors", "|"))


def _title_hits(spark, sf_dir, floor):
    found = R.matches(view(spark, sf_dir, "works2"), view(spark, sf_dir, "works"), floor=floor)
    return found.select("query", "rank", "doi", "title", F.round(F.col("similarity") * 100, 6).alias("score"))


def title_search_top3(spark, sf_dir):
    """The three most similar works, however far they are."""
    return _title_hits(spark, sf_dir, 0.0)


def title_search_close(spark, sf_dir):
    """Of the three most similar works those of similarity 0.5 or more."""
    return _title_hits(spark, sf_dir, 0.5)


def registry_search(spark, sf_dir):
    """Hits without a floor, scored by rarity, with what is known of each work."""
    found = R.search(view(spark, sf_dir, "asked_titles"), view(spark, sf_dir, "works"))
    return found.withColumns({"authors": X.first_three(F.col("authors"), "; "), "score": F.round("score", 6), "similarity": F.round("similarity", 9)})


def verify_report(spark, sf_dir):
    """What the command prints of every DOI cited anywhere."""
    dois = _items(spark, sf_dir).where("doi IS NOT NULL").select("doi").distinct()
    return report.verified(R.verify(dois, view(spark, sf_dir, "works"), view(spark, sf_dir, "works2")))


def search_report(spark, sf_dir):
    """What the command prints of the hits of every title asked for."""
    return report.hits(R.search(view(spark, sf_dir, "asked_titles"), view(spark, sf_dir, "works")))


def arxiv_report(spark, sf_dir):
    """The printed report on all papers of the feeds."""
    listed, found = kept(R.papers(view(spark, sf_dir, "feed_xml")), "listed"), _summaries(spark, sf_dir)
    issues = kept(_summary_issues(spark, sf_dir, found), "issues")
    per = kept(R.summary_stats(listed.select("id"), found, issues), "stats")
    return report.papers(listed, per, R.stats(per), issues)


def exit_codes(spark, sf_dir):
    """Of the commands on the derived inputs."""
    claims_ = claim_queries.missing_claim(spark, sf_dir).select("severity")
    audited = citations.severities(view(spark, sf_dir, "prose_files"), view(spark, sf_dir, "bib_entries"))
    return report.exit_codes(audited, claims_, arxiv_stats(spark, sf_dir), verify_dois(spark, sf_dir))


def registry_records(spark, sf_dir):
    return R.records(view(spark, sf_dir, "registry_json")).withColumn("authors", F.array_join("authors", "; "))


def registry_hit_records(spark, sf_dir):
    return R.hit_records(view(spark, sf_dir, "search_json")).withColumn("authors", X.first_three(F.col("authors"), "; "))


def _neighbours(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    mine = docs.select("doc_id", X.words(F.coalesce("text", F.lit(""))).alias("a"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), X.words(F.coalesce("text", F.lit(""))).alias("b"))
    return mine.join(following, "doc_id")


def title_similarity(spark, sf_dir):
    """Word similarity of each document and the one that follows it."""
    return _neighbours(spark, sf_dir).select("doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.round(X.word_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


def title_contains_all(spark, sf_dir):
    works, bib = view(spark, sf_dir, "works"), view(spark, sf_dir, "bib_entries")
    return bib.select("id", "doi", F.col("title").alias("claimed")).join(works.select("doi", F.col("title").alias("actual")), "doi").select("id", X.title_contains_all(F.col("claimed"), F.col("actual")).alias("actual_in_claimed"), X.title_contains_all(F.col("actual"), F.col("claimed")).alias("claimed_in_actual"))


_TITLE = f"coalesce({S.first('item', P.REFERENCE_CITE)}, nullif({S.strip(f"regexp_extract(clean, '{P.REFERENCE_TITLE}', 1)")}, ''), nullif({S.strip(f"regexp_extract(item, '{P.REFERENCE_ITALIC}', 1)")}, ''))"
_REFS = f"""refs AS (
  SELECT paper, pos, nullif(regexp_replace(regexp_extract(item, '{P.REFERENCE_DOI}', 1), '[''"]+\\z', ''), '') AS doi, {_TITLE} AS title,
    try_cast({S.first("clean", P.REFERENCE_YEAR)} AS INT) AS year, substr(clean, 1, 200) AS raw FROM (
    SELECT *, {S.strip(f"regexp_replace(regexp_replace(item, '<[^>]+>', ' ', 'g'), '{P.SPACE}+', ' ', 'g')")} AS clean FROM (
      SELECT paper, unnest(m) AS item, unnest(range(len(m)))::INT AS pos FROM (
        SELECT paper, CASE WHEN contains(html, 'References') THEN {S.found("string_split(html, 'References')[-1]", P.REFERENCE_ITEM, 1)} ELSE [] END AS m FROM paper_html) x) y) z),
kinds AS (SELECT *, CASE WHEN doi IS NOT NULL AND NOT starts_with(doi, '{P.PREPRINT_DOI}') THEN 'doi' WHEN doi IS NULL AND title IS NOT NULL THEN 'title' END AS kind FROM refs),
budget AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper, kind ORDER BY pos)::INT AS nth FROM kinds WHERE kind IS NOT NULL) k WHERE nth <= CASE kind WHEN 'doi' THEN {R.DOI_BUDGET} ELSE {R.TITLE_BUDGET} END)"""
_CHECKS = f"""WITH {_REFS},
matched AS (SELECT b.*, w.title AS actual, w.doi IS NOT NULL AS verified, {S.words("coalesce(b.title, '')")} AS x, {S.words("coalesce(w.title, '')")} AS y FROM budget b LEFT JOIN works w ON w.doi = b.doi WHERE kind = 'doi'),
scored AS (SELECT *, {S.similarity("x", "y")} AS similarity FROM matched),
doi_checks AS (
  SELECT *, CASE WHEN NOT verified THEN 'DOI not found' WHEN title IS NOT NULL AND similarity < {R.MISMATCH_BELOW} AND NOT {S.contains_all("x", "y")} THEN 'DOI-title mismatch' ELSE 'ok' END AS outcome FROM scored)"""
_TITLES = f"""best AS (SELECT b.*, h.title AS best_match, h.score, {S.words("coalesce(b.title, '')")} AS x, {S.words("coalesce(h.title, '')")} AS y FROM budget b LEFT JOIN search_hits h ON h.query = b.title AND h.rank = 1 WHERE kind = 'title'),
title_checks AS (
  SELECT *, CASE WHEN coalesce(score, 0) > {R.LEAST_SCORE} AND similarity < {R.NOT_FOUND_BELOW} THEN 'Title not found in CrossRef' ELSE 'ok' END AS outcome FROM (SELECT *, {S.similarity("x", "y")} AS similarity FROM best) s)"""
_ISSUES = f"""{_CHECKS}, {_TITLES},
issues AS (
  SELECT paper, left(raw, 150) AS ref, outcome AS issue, CASE WHEN bad THEN left(title, 100) END AS claimed, CASE WHEN bad THEN left(actual, 100) END AS actual,
    CASE WHEN bad THEN round(similarity, 2) END AS similarity, doi, NULL::VARCHAR AS best_match FROM (SELECT *, outcome = 'DOI-title mismatch' AS bad FROM doi_checks WHERE outcome <> 'ok') d
  UNION ALL SELECT paper, left(raw, 150), outcome, left(title, 100), NULL, round(similarity, 2), NULL, left(best_match, 100) FROM title_checks WHERE outcome <> 'ok')"""
_ENTRIES = f"""entries AS (
  SELECT regexp_replace(regexp_extract(e, '{P.ENTRY_ID}', 1), 'v\\d+\\z', '') AS id, {S.strip(f"regexp_extract(e, '{P.ENTRY_TITLE}', 1)")} AS title, {S.found("e", P.ENTRY_NAME, 1)} AS names,
    nullif(regexp_extract(e, '{P.ENTRY_PUBLISHED}', 1), '') AS published, {S.found("e", P.ENTRY_CATEGORY, 1)} AS tags
  FROM (SELECT unnest(string_split(xml, '<entry>')[2:]) AS e FROM feed_xml) x),
papers AS (SELECT * FROM entries WHERE id <> '' AND title <> '')"""
_PAPERS = f"""{_ISSUES}, {_ENTRIES},
per AS (
  SELECT paper, count(*) AS refs, least(count(*) FILTER (kind = 'doi'), {R.DOI_BUDGET}) + least(count(*) FILTER (kind = 'title'), {R.TITLE_BUDGET}) AS verified,
    count(*) FILTER (starts_with(doi, '{P.PREPRINT_DOI}')) AS skipped_arxiv FROM kinds GROUP BY paper),
bad AS (SELECT paper, count(*) AS issues FROM issues GROUP BY paper),
paper_stats AS (
  SELECT id, coalesce(refs, 0)::BIGINT AS refs, coalesce(verified, 0)::BIGINT AS verified, coalesce(issues, 0)::BIGINT AS issues, coalesce(skipped_arxiv, 0)::BIGINT AS skipped_arxiv, CASE WHEN refs IS NULL THEN 'no HTML' END AS skipped
  FROM papers LEFT JOIN per ON per.paper = id LEFT JOIN bad ON bad.paper = id)"""
_WORK_SQL = """CASE WHEN error IS NULL THEN coalesce(json_extract_string(work, '$.title[0]'), '') END AS title,
        CASE WHEN error IS NULL THEN array_to_string(list_transform(json_extract(work, '$.author[*]'), lambda a: coalesce(json_extract_string(a, '$.family'), 'undefined') || ', ' || coalesce(json_extract_string(a, '$.given'), 'undefined')), '; ') END AS authors,
        CASE WHEN error IS NULL THEN nullif(json_extract(work, '$.published."date-parts"[0][0]')::INT, 0) END AS year"""


def _hits(least: str) -> str:
    return f"""WITH ask AS (SELECT DISTINCT title AS query, {S.words("title")} AS x FROM works2), have AS (SELECT doi, title, {S.words("title")} AS y FROM works),
        scored AS (SELECT query, doi, title, {S.similarity("x", "y")} AS s FROM ask, have), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, doi)::INT AS rank FROM scored WHERE {least})
        SELECT query, rank, doi, title, round(s * 100, 6) AS score FROM ranked WHERE rank <= {R.HITS}"""


_VERIFIED = f"""WITH {_REFS}, v AS (SELECT d.doi, coalesce(a.doi, b.doi) IS NOT NULL AS verified, CASE WHEN a.doi IS NOT NULL THEN 1 WHEN b.doi IS NOT NULL THEN 2 END AS snapshot,
        CASE WHEN a.doi IS NOT NULL THEN a.title ELSE b.title END AS title, array_to_string(CASE WHEN a.doi IS NOT NULL THEN a.authors ELSE b.authors END, '|') AS authors,
        CASE WHEN a.doi IS NOT NULL THEN a.journal ELSE b.journal END AS journal, CASE WHEN a.doi IS NOT NULL THEN a.year ELSE b.year END AS year, CASE WHEN coalesce(a.doi, b.doi) IS NULL THEN 'not in the snapshot' END AS error
        FROM (SELECT DISTINCT doi FROM refs WHERE doi IS NOT NULL) d LEFT JOIN works a ON a.doi = d.doi LEFT JOIN works2 b ON b.doi = d.doi)"""
#: The claims audit's issues beside the names used here; the citation audit never has an error.
_MISSED = claim_queries._MISSING.removeprefix("WITH ").replace("refs AS", "claim_refs AS", 1).replace("FROM refs r", "FROM claim_refs r")
_SEARCH = f"""WITH ask AS (SELECT DISTINCT title AS query, {S.words("title")} AS x FROM asked_titles), have AS (SELECT *, {S.words("title")} AS y FROM works),
        df AS (SELECT w, ln(1 + (SELECT count(*) FROM works) / count(*)) AS weight FROM (SELECT unnest(y) AS w FROM have) u GROUP BY w),
        scored AS (SELECT query, x, doi, title, authors, journal, year, y, {S.similarity("x", "y")} AS s FROM ask, have WHERE len(list_intersect(x, y)) > 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, doi)::INT AS rank FROM scored),
        weighed AS (SELECT *, unnest(x) AS w FROM ranked WHERE rank <= {R.HITS})
        SELECT query, rank, doi, any_value(title) AS title, array_to_string(any_value(authors)[:3], '; ') || CASE WHEN len(any_value(authors)) > 3 THEN ' et al.' ELSE '' END AS authors, any_value(journal) AS journal, any_value(year) AS year,
        round(100 * sum(CASE WHEN list_contains(y, w) THEN weight ELSE 0 END) / sum(weight), 6) AS score, round(any_value(s), 9) AS similarity FROM weighed JOIN df USING (w) GROUP BY query, rank, doi"""
_ALL = "paper_html works search_hits feed_xml"

_QUERIES = {
    atom_entries: with_views("feed_xml", f"WITH {_ENTRIES} SELECT id, title, array_to_string(names, '|') AS authors, published, array_to_string(tags, '|') AS categories FROM papers"),
    arxiv_listing: with_views("feed_xml", f"""WITH {_ENTRIES} SELECT id, left(title, 70) AS title, array_to_string(names[:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END AS authors, published
        FROM papers WHERE list_contains(tags, 'cs.AI') ORDER BY published DESC NULLS LAST, id LIMIT 10"""),
    html_refs: with_views("paper_html", f"WITH {_REFS} SELECT * FROM refs"),
    ref_budget: with_views("paper_html", f"WITH {_REFS} SELECT paper, pos, kind, nth FROM budget"),
    doi_checks: with_views("paper_html works", f"{_CHECKS} SELECT paper, pos, doi, round(similarity, 9) AS similarity, outcome FROM doi_checks"),
    doi_mismatch: with_views("paper_html works", f"{_CHECKS} SELECT paper, pos, doi, title, actual FROM doi_checks WHERE outcome = 'DOI-title mismatch'"),
    doi_not_found: with_views("paper_html works", f"{_CHECKS} SELECT paper, pos, doi, title FROM doi_checks WHERE outcome = 'DOI not found'"),
    title_not_found: with_views("paper_html search_hits", f"WITH {_REFS}, {_TITLES} SELECT paper, pos, title, best_match, score FROM title_checks WHERE outcome <> 'ok'"),
    reference_issues: with_views("paper_html works search_hits", f"{_ISSUES} SELECT * FROM issues"),
    arxiv_paper_stats: with_views(_ALL, f"{_PAPERS} SELECT * FROM paper_stats"),
    arxiv_stats: with_views(_ALL, f"""{_PAPERS} SELECT count(*) AS papers_audited, coalesce(sum(refs), 0)::BIGINT AS total_refs, coalesce(sum(verified), 0)::BIGINT AS refs_checked,
        coalesce(sum(issues), 0)::BIGINT AS issues_found, round(coalesce(sum(issues)::DOUBLE / nullif(sum(verified), 0), 0), 9) AS issue_rate FROM paper_stats"""),
    verify_dois: with_views("paper_html works works2", f"{_VERIFIED} SELECT * FROM v"),
    title_search_top3: with_views("works works2", _hits("s > 0")),
    title_search_close: with_views("works works2", _hits("s >= 0.5")),
    registry_search: with_views("asked_titles works", _SEARCH),
    verify_report: with_views("paper_html works works2", _VERIFIED + """ SELECT 0 AS part, doi AS a, '' AS b, CASE WHEN verified THEN '  ✓ Verified' || chr(10) || '  Title:   ' || title || chr(10) || '  Authors: ' || replace(authors, '|', '; ') || chr(10) || '  Journal: ' || journal || chr(10) || '  Year:    ' || year
        ELSE '  ✗ Not verified: not in the snapshot' END AS line FROM v"""),
    search_report: with_views("asked_titles works", f"""WITH h AS ({_SEARCH}) SELECT 0 AS part, query AS a, printf('%03d', rank) AS b, '  ' || doi || chr(10) || '  ' || title || chr(10) || '  ' || authors || chr(10) || '  ' || year AS line FROM h"""),
    arxiv_report: with_views(_ALL, f"""{_PAPERS}, totals AS (SELECT count(*) AS p, coalesce(sum(refs), 0)::BIGINT AS r, coalesce(sum(verified), 0)::BIGINT AS v, coalesce(sum(issues), 0)::BIGINT AS i FROM paper_stats)
        SELECT 0 AS part, coalesce(translate(published, '0123456789', '9876543210'), '~') AS a, p.id AS b, '── ' || p.id || ': ' || left(title, 70) || chr(10) || '   ' || array_to_string(names[:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END || chr(10) || '   ' ||
          CASE WHEN skipped IS NOT NULL THEN '(' || skipped || ')' ELSE refs || ' references | Verified: ' || verified || ' | Issues: ' || issues || CASE WHEN skipped_arxiv > 0 THEN ' (' || skipped_arxiv || ' arXiv DOIs skipped)' ELSE '' END END AS line FROM papers p JOIN paper_stats s ON s.id = p.id
        UNION ALL SELECT 1, '', printf('%02d', k), '  ' || name || ': ' || value FROM (SELECT unnest(['papers_audited', 'total_refs', 'refs_checked', 'issues_found', 'issue_rate']) AS name, unnest(range(5)) AS k,
          unnest([p::VARCHAR, r::VARCHAR, v::VARCHAR, i::VARCHAR, printf('%.1f', 100 * coalesce(i::DOUBLE / nullif(v, 0), 0)) || '%']) AS value FROM totals) t
        UNION ALL SELECT 2, paper, ref, '  ✗ [' || issue || '] ' || paper || chr(10) || '    ' || ref || coalesce(chr(10) || '    claimed: ' || claimed, '') || coalesce(chr(10) || '    actual: ' || actual, '') ||
          coalesce(chr(10) || '    best match: ' || best_match, '') || coalesce(chr(10) || '    DOI: ' || doi, '') || coalesce(chr(10) || '    similarity: ' || similarity, '') FROM issues"""),
    exit_codes: with_views("paper_html works works2 search_hits feed_xml claim_prose aggregate_md", f"""{_PAPERS}, v AS ({_VERIFIED.split("v AS (", 1)[1]}, {_MISSED}
        SELECT 'audit' AS command, 0 AS code UNION ALL SELECT 'notebook-audit', (count(*) > 0)::INT FROM missing UNION ALL SELECT 'arxiv', (sum(issues) > 0)::INT FROM paper_stats UNION ALL SELECT 'verify ' || doi, (NOT verified)::INT FROM v"""),
    registry_records: with_views("registry_json", f"""WITH b AS (SELECT *, CASE WHEN status IS DISTINCT FROM 200 THEN 'HTTP ' || coalesce(status::VARCHAR, 'none') WHEN NOT json_valid(body) OR json_extract(body, '$.message') IS NULL THEN 'parse error' END AS error FROM registry_json),
        w AS (SELECT doi, error, CASE WHEN error IS NULL THEN json_extract(body, '$.message') END AS work FROM b)
        SELECT doi, error IS NULL AS verified, {_WORK_SQL}, CASE WHEN error IS NULL THEN coalesce(json_extract_string(work, '$."container-title"[0]'), '') END AS journal, error FROM w"""),
    registry_hit_records: with_views("search_json", f"""WITH w AS (SELECT query, unnest(json_extract(body, '$.message.items[*]')) AS work, generate_subscripts(json_extract(body, '$.message.items[*]'), 1)::INT AS rank, NULL AS error
          FROM search_json WHERE status = 200 AND json_valid(body))
        SELECT query, rank, json_extract_string(work, '$.DOI') AS doi, title, CASE WHEN len(string_split(authors, '; ')) > 3 THEN array_to_string(string_split(authors, '; ')[:3], '; ') || ' et al.' ELSE authors END AS authors, year, score
        FROM (SELECT query, rank, work, {_WORK_SQL}, coalesce(json_extract(work, '$.score')::DOUBLE, 0) AS score FROM w) x"""),
    title_similarity: f"""WITH w AS (SELECT doc_id, {S.words("coalesce(text, '')")} AS ws FROM documents)
        SELECT a.doc_id, len(list_intersect(a.ws, b.ws))::BIGINT AS shared, round({S.similarity("a.ws", "b.ws")}, 9) AS similarity FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""",
    title_contains_all: with_views("works bib_entries", f"""WITH p AS (SELECT id, {S.words("b.title")} AS c, {S.words("w.title")} AS a FROM bib_entries b JOIN works w ON w.doi = b.doi)
        SELECT id, {S.contains_all("c", "a")} AS actual_in_claimed, {S.contains_all("a", "c")} AS claimed_in_actual FROM p"""),
}
QUERIES = {f.__name__: f for f in _QUERIES}
ORACLES = {f.__name__: sql for f, sql in _QUERIES.items()}
