"""Queries of the notebook claims: references, catalog, blocks, status, stale values."""

from __future__ import annotations

from glosswerk.functions import patterns as P
from glosswerk.operators import claims, report
from glosswerk.plans import sql as S
from glosswerk.plans.synth import view, with_views

# Numbers known to be out of date, with what to say about them.
STALE_VALUES = [
    ("0.827", "Pre-fix M3 AUC (corrected to 0.792)", "0.792"),
    ("0.821", "Pre-fix M4 AUC (corrected to 0.792)", "0.792"),
    ("994", "Pre-fix evaluated-rejected N (corrected to 344)", "344"),
]


def _prose(spark, sf_dir):
    return view(spark, sf_dir, "claim_prose")


def _catalog(spark, sf_dir):
    return view(spark, sf_dir, "aggregate_md")


def _notebooks(spark, sf_dir):
    return view(spark, sf_dir, "notebooks_json")


def claim_refs(spark, sf_dir):
    return claims.refs(_prose(spark, sf_dir))


def claim_catalog(spark, sf_dir):
    return claims.claims(_catalog(spark, sf_dir))


def claim_notebooks(spark, sf_dir):
    return claims.notebooks(_catalog(spark, sf_dir))


def _missing(spark, sf_dir):
    return claims.missing(claims.refs(_prose(spark, sf_dir)), _catalog(spark, sf_dir))


def missing_notebook(spark, sf_dir):
    return _missing(spark, sf_dir).where("type = 'missing_notebook'")


def missing_claim(spark, sf_dir):
    return _missing(spark, sf_dir).where("type = 'missing_claim'")


def notebook_prose(spark, sf_dir):
    return claims.prose(_notebooks(spark, sf_dir))


def notebook_blocks(spark, sf_dir):
    return claims.blocks(_notebooks(spark, sf_dir))


def notebook_status(spark, sf_dir):
    return claims.status(_notebooks(spark, sf_dir))


def _blockless(spark, sf_dir):
    return claims.missing_blocks(claims.status(_notebooks(spark, sf_dir)), claims.refs(view(spark, sf_dir, "notebook_prose")))


def missing_block(spark, sf_dir):
    return _blockless(spark, sf_dir)


def claim_stats(spark, sf_dir):
    """Over the claim issues and the notebooks without a block."""
    issues = _missing(spark, sf_dir).select("severity").unionAll(_blockless(spark, sf_dir).select("severity"))
    return claims.stats(claims.refs(_prose(spark, sf_dir)), issues)


def claims_report(spark, sf_dir):
    """The printed report of the claims audit, stale values included."""
    issues = _missing(spark, sf_dir).unionByName(_blockless(spark, sf_dir), allowMissingColumns=True)
    counts = claims.stats(claims.refs(_prose(spark, sf_dir)), issues)
    return report.claims(counts, claims.status(_notebooks(spark, sf_dir)), issues, stale_scan(spark, sf_dir))


def aggregate_stats(spark, sf_dir):
    return claims.block_stats(claims.blocks(_notebooks(spark, sf_dir)))


def aggregate_markdown(spark, sf_dir):
    return claims.markdown(claims.blocks(_notebooks(spark, sf_dir)))


def catalog_round_trip(spark, sf_dir):
    """The claims read back from the catalog document that the notebooks give."""
    return claims.claims_of(aggregate_markdown(spark, sf_dir).selectExpr("'catalog.md' AS file", "place AS line", "line AS text"))


def stale_scan(spark, sf_dir):
    return claims.stale(view(spark, sf_dir, "stale_prose"), STALE_VALUES)


def stale_scan_many(spark, sf_dir):
    """Five values for each part, found by automata."""
    return claims.stale(view(spark, sf_dir, "stale_prose"), view(spark, sf_dir, "stale_rules"))


def _refs(prose: str) -> str:
    return f"""SELECT raw, regexp_extract(raw, '{P.CLAIM_REFERENCE}', 1) AS notebook, regexp_extract(raw, '{P.CLAIM_REFERENCE}', 2) AS claim_id, file, line
      FROM (SELECT file, line, unnest({S.found("text", P.CLAIM_REFERENCE)}) AS raw FROM ({S.lines(prose)}) l) r"""


def _catalog_sql(catalog: str) -> str:
    """CTEs ``sections`` and ``claims`` of a (file, content) relation."""
    cells = f"list_filter(list_transform(string_split(text, '|'), lambda c: {S.strip('c')}), lambda c: c <> '')"
    return f"""opened AS (SELECT *, {S.first("text", P.CATALOG_HEADING)} AS nb FROM ({S.lines(catalog)}) l),
    placed AS (SELECT file, line, text, nb AS heading, max(CASE WHEN nb IS NOT NULL THEN line END) OVER (PARTITION BY file ORDER BY line) AS at FROM opened),
    sections AS (SELECT file, heading AS nb, max(line) AS at FROM placed WHERE heading IS NOT NULL GROUP BY ALL),
    cells AS (SELECT nb, line, {cells} AS cs FROM placed p JOIN sections s ON p.file = s.file AND p.at = s.at WHERE heading IS NULL AND starts_with(text, '|')),
    claims AS (
      SELECT nb, claim_id, arg_max(text, line) AS text FROM (
        SELECT nb, line, regexp_extract(cs[1], '{P.CATALOG_CLAIM.replace("$", chr(92) + "z")}', 1) AS claim_id, array_to_string(cs[2:], ' | ') AS text FROM cells WHERE len(cs) >= 2) c
      WHERE claim_id <> '' GROUP BY ALL)"""


_MISSING = f"""WITH refs AS ({_refs("claim_prose")}), {_catalog_sql("aggregate_md")},
missing AS (
  SELECT 'error' AS severity, CASE WHEN s.nb IS NULL THEN 'missing_notebook' ELSE 'missing_claim' END AS type, raw AS ref, r.file, r.line,
    CASE WHEN s.nb IS NULL THEN notebook || ' not found in aggregate Key Claims' ELSE raw || ' — claim ' || r.claim_id || ' not found in ' || notebook END AS message
  FROM refs r LEFT JOIN (SELECT DISTINCT nb FROM sections) s ON s.nb = r.notebook LEFT JOIN claims c ON c.nb = r.notebook AND c.claim_id = r.claim_id WHERE c.nb IS NULL)"""
_SOURCE = "CASE json_type(c, '$.source') WHEN 'ARRAY' THEN array_to_string(CAST(json_extract(c, '$.source') AS VARCHAR[]), '') ELSE json_extract_string(c, '$.source') END"
_CELLS = f"""cells AS (
  SELECT file, json_valid(json) AS good, CASE WHEN json_valid(json) THEN
    list_transform(list_filter(CAST(json_extract(json, '$.cells') AS JSON[]), lambda c: json_extract_string(c, '$.cell_type') = 'markdown'), lambda c: {_SOURCE}) END AS cs
  FROM notebooks_json),
named AS (SELECT *, 'NB' || regexp_extract(file, '{P.NOTEBOOK_NAME}', 1) || CASE WHEN regexp_extract(file, '{P.NOTEBOOK_NAME}', 2) <> '' THEN '.' || regexp_extract(file, '{P.NOTEBOOK_NAME}', 2) ELSE '' END AS label FROM cells)"""
_BLOCKS = f"""{_CELLS},
cut AS (
  SELECT file, label, replace(file, '.ipynb', '') AS stem, regexp_extract(list_filter(coalesce(cs, []), lambda s: regexp_matches(s, '(?m){P.BLOCK_HEADING}'))[1], '(?ms){P.BLOCK_HEADING}[^\\n]*\\n(.*?)(?:{P.NEXT_HEADING}|\\z)', 1) AS body FROM named),
blocks AS (SELECT file, label, stem, nullif({S.strip("body")}, '') AS block FROM cut),
counted AS (SELECT *, CASE WHEN block IS NULL THEN 0 ELSE len({S.found("block", P.CLAIM_ROW)}) END::BIGINT AS claim_count FROM blocks)"""
_STATUS = f"""{_CELLS},
marked AS (SELECT *, list_filter(coalesce(cs, []), lambda s: contains(s, '{P.BLOCK_MARKER}'))[1] AS cell FROM named),
status AS (
  SELECT file, label, cell IS NOT NULL AS has_block, {S.first("cell", P.VERIFIED)} AS verified_date,
    coalesce(len({S.found("cell", P.CLAIM_ROW)}), 0)::BIGINT AS claim_count, CASE WHEN NOT good THEN 'parse error' END AS error FROM marked)"""
_BLOCKLESS = f"""{_STATUS},
blockless AS (SELECT 'warn' AS severity, 'missing_key_claims_block' AS type, file, label || ' is cited in prose but has no Key Claims block' AS message
  FROM status WHERE NOT has_block AND label IN (SELECT notebook FROM ({_refs("notebook_prose")}) n))"""
_ANCHOR = "regexp_replace(lower(label), '\\.', '') || '-' || replace(stem, '_', '-')"
_MARKDOWN = f"""{_BLOCKS},
ordered AS (SELECT *, regexp_extract(file, '^(\\d+)', 1)::INT AS n FROM counted WHERE block IS NOT NULL),
document AS (
  SELECT concat_ws(chr(10), '# Notebook Key Claims' || chr(10), '> Auto-generated by `glosswerk aggregate`. Do not edit manually.',
    '> ' || count(*) || ' notebooks, ' || coalesce(sum(claim_count), 0)::BIGINT || ' claims.' || chr(10),
    '**Contract:** If prose cites a value that disagrees with a row below, the prose is wrong — not the notebook.' || chr(10), '## Contents' || chr(10),
    string_agg('- [' || label || ': `' || stem || '`](#' || {_ANCHOR} || ') (' || claim_count || ' claims)', chr(10) ORDER BY n, file), '',
    string_agg('## ' || label || ': `' || stem || '`' || chr(10) || chr(10) || block || chr(10), chr(10) ORDER BY n, file)) AS markdown
  FROM ordered)"""
_STALE = ", ".join(f"('{v}', '{m}', '{c}')" for v, m, c in STALE_VALUES)

_QUERIES = {
    claim_refs: with_views("claim_prose", _refs("claim_prose")),
    claim_catalog: with_views("aggregate_md", f"WITH {_catalog_sql('aggregate_md')} SELECT * FROM claims"),
    claim_notebooks: with_views("aggregate_md", f"WITH {_catalog_sql('aggregate_md')} SELECT DISTINCT nb FROM sections"),
    missing_notebook: with_views("claim_prose aggregate_md", f"{_MISSING} SELECT * FROM missing WHERE type = 'missing_notebook'"),
    missing_claim: with_views("claim_prose aggregate_md", f"{_MISSING} SELECT * FROM missing WHERE type = 'missing_claim'"),
    notebook_prose: with_views("notebooks_json", f"WITH {_CELLS} SELECT file, array_to_string(cs, chr(10)) AS content FROM named WHERE good"),
    notebook_blocks: with_views("notebooks_json", f"WITH {_BLOCKS} SELECT * FROM counted"),
    notebook_status: with_views("notebooks_json", f"WITH {_STATUS} SELECT * FROM status"),
    missing_block: with_views("notebooks_json notebook_prose", f"WITH {_BLOCKLESS} SELECT * FROM blockless"),
    claim_stats: with_views("claim_prose aggregate_md notebooks_json notebook_prose", f"""{_MISSING}, {_BLOCKLESS.replace("cells AS", "nbcells AS", 1).replace("FROM cells", "FROM nbcells", 1)},
        found AS (SELECT severity FROM missing UNION ALL SELECT severity FROM blockless)
        SELECT (SELECT count(*) FROM refs) AS total_refs, (SELECT count(DISTINCT notebook) FROM refs) AS unique_notebooks, (SELECT count(DISTINCT (notebook, claim_id)) FROM refs) AS unique_claims,
          count(*) AS issue_count, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings FROM found"""),
    claims_report: with_views("claim_prose aggregate_md notebooks_json notebook_prose stale_prose", f"""{_MISSING}, {_BLOCKLESS.replace("cells AS", "nbcells AS", 1).replace("FROM cells", "FROM nbcells", 1)},
        rules(value, message, correction) AS (VALUES {_STALE}),
        every AS (SELECT severity, type, ref, file, line, message FROM missing UNION ALL SELECT severity, type, NULL, file, NULL, message FROM blockless)
        SELECT 0 AS part, '' AS a, printf('%02d', k) AS b, '  ' || name || ': ' || value AS line FROM (SELECT unnest(['total_refs', 'unique_notebooks', 'unique_claims', 'issue_count', 'errors', 'warnings']) AS name, unnest(range(6)) AS k,
          unnest([(SELECT count(*) FROM refs), (SELECT count(DISTINCT notebook) FROM refs), (SELECT count(DISTINCT (notebook, claim_id)) FROM refs), count(*), count(*) FILTER (severity = 'error'), count(*) FILTER (severity = 'warn')]) AS value FROM every) s
        UNION ALL SELECT 1, file, '', '  ' || CASE WHEN has_block THEN '✓ ' ELSE '✗ ' END || file || '  (' || CASE WHEN has_block THEN claim_count || ' claims' || coalesce(', verified ' || verified_date, '') ELSE 'no Key Claims block' END || ')' FROM status
        UNION ALL SELECT 2, concat_ws(':', file, line), ref, '  ' || CASE severity WHEN 'error' THEN '✗' ELSE '⚠' END || ' [' || type || '] ' || coalesce(ref, '') || chr(10) || '    ' || concat_ws(':', file, line) || chr(10) || '    ' || message FROM every
        UNION ALL SELECT 3, file || ':' || line, value, '  ⚠ ' || file || ':' || line || ' — ' || message || coalesce(chr(10) || '    → should be: ' || correction, '') FROM ({S.lines("stale_prose")}) l JOIN rules ON contains(text, value)"""),
    aggregate_stats: with_views("notebooks_json", f"""WITH {_BLOCKS} SELECT count(*) AS notebooks_scanned, count(block) AS notebooks_with_claims,
        count(*) FILTER (block IS NULL) AS notebooks_without, coalesce(sum(claim_count), 0)::BIGINT AS total_claims FROM counted"""),
    aggregate_markdown: with_views("notebooks_json", f"WITH {_MARKDOWN} SELECT unnest(range(1, len(ls) + 1)) AS place, unnest(ls) AS line FROM (SELECT string_split(markdown, chr(10)) AS ls FROM document) d"),
    catalog_round_trip: with_views("notebooks_json", f"""WITH {_MARKDOWN.replace("cells AS", "nbcells AS", 1).replace("FROM cells", "FROM nbcells", 1)},
        md AS (SELECT 'catalog.md' AS file, markdown AS content FROM document), {_catalog_sql("md")} SELECT * FROM claims"""),
    stale_scan_many: with_views("stale_prose stale_rules", f"""SELECT 'warn' AS severity, 'potentially_stale' AS type, file, line, value, coalesce(message, '"' || value || '" may be stale (pre-fix)') AS message, correction
        FROM ({S.lines("stale_prose")}) l JOIN stale_rules ON contains(text, value)"""),
    stale_scan: with_views("stale_prose", f"""WITH rules(value, message, correction) AS (VALUES {_STALE})
        SELECT 'warn' AS severity, 'potentially_stale' AS type, file, line, value, message, correction FROM ({S.lines("stale_prose")}) l JOIN rules ON contains(text, value)"""),
}
QUERIES = {f.__name__: f for f in _QUERIES}
ORACLES = {f.__name__: sql for f, sql in _QUERIES.items()}
