"""Queries of claim consistency: proximity, conflicts, changes, index, similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswerk.functions import patterns as P
from glosswerk.operators import citations, claims, consistency, stored
from glosswerk.operators.settle import new_folder
from glosswerk.plans import sql as S
from glosswerk.plans.synth import table, view, with_views


def claims_near_citation(spark, sf_dir):
    return consistency.claims_near_citations(view(spark, sf_dir, "mechanism_prose"))


def uncited_numbers(spark, sf_dir):
    return consistency.uncited_numbers(view(spark, sf_dir, "mechanism_prose"))


def mechanism_claims(spark, sf_dir):
    return consistency.mechanism_claims(view(spark, sf_dir, "mechanism_prose"))


def param_conflicts(spark, sf_dir):
    return consistency.conflicts(view(spark, sf_dir, "measured"))


def changed_claims(spark, sf_dir):
    """Documents whose text is not the one verified, which had its lines joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    verified = docs.select("doc_id", F.sha2(F.coalesce(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("")), 256).alias("digest"))
    return consistency.changed(docs, verified, "doc_id", "text")


def validation_rules(spark, sf_dir):
    return consistency.validate(view(spark, sf_dir, "checks")).select("id", "failure", F.array_join("warnings", "; ").alias("warnings"), "level")


def confidence_levels(spark, sf_dir):
    return consistency.confidence(view(spark, sf_dir, "evidence")).select("id", "score", "confidence")


def value_drift(spark, sf_dir):
    prose = view(spark, sf_dir, "drift_prose")
    return consistency.drift(claims.refs(prose), claims.claims(view(spark, sf_dir, "aggregate_md")), prose)


def et_al_authors(spark, sf_dir):
    bib = view(spark, sf_dir, "bib_entries")
    found = citations.keyed(citations.cited(view(spark, sf_dir, "prose_files")))
    return consistency.et_al(found, bib).withColumn("authors", F.array_join("authors", "|"))


def cited_parameters(spark, sf_dir):
    return consistency.parameters(view(spark, sf_dir, "mechanism_prose"))


def unverified_claims(spark, sf_dir):
    """Claims of files whose text is not the one verified, in which one word was other."""
    files = view(spark, sf_dir, "mechanism_prose")
    verified = files.select("file", F.sha2(F.replace("content", F.lit("in 12.5% of"), F.lit("in 13% of")), 256).alias("digest"))
    return consistency.unverified(files, verified)


def index_upsert(spark, sf_dir):
    return consistency.upsert(view(spark, sf_dir, "index_old"), view(spark, sf_dir, "index_new"), "id", "version")


def index_diff(spark, sf_dir):
    return consistency.diff(view(spark, sf_dir, "index_old"), view(spark, sf_dir, "index_new"), "id", "title")


def _stored(spark, sf_dir):
    """A stored index of four versions: written, overwritten, thinned out, written again."""
    index = stored.CitationIndex(spark, new_folder(spark, "index"))
    old, new = (view(spark, sf_dir, v).select(F.concat(F.lit("p"), "id").alias("id"), "title", F.when(F.col("id") % 2 == 0, F.concat(F.lit("10.1000/p."), "id")).alias("doi")) for v in ("index_old", "index_new"))
    index.upsert(old)
    index.upsert(new)
    index.remove(old.where("substr(id, 2) % 11 = 0").select("id"))
    index.upsert(old.where("substr(id, 2) % 22 = 0"))
    return index


def stored_index(spark, sf_dir):
    return _stored(spark, sf_dir).read().select("id", "title", "doi")


def stored_index_diff(spark, sf_dir):
    return _stored(spark, sf_dir).diff(1, 4).withColumn("columns", F.array_join("columns", ","))


def cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    found = consistency.cosine_topk(rows.where(F.pmod("id", F.lit(100)) == 0), rows)
    return found.withColumn("score", F.round("score", 9))


_GAP = "greatest(a.s - b.e, b.s - a.e, 0)"
_NEAR = f"WITH cites AS ({S.spans('mechanism_prose', P.INLINE)}), numbers AS ({S.spans('mechanism_prose', S.NUMBERS)})"

_VERSIONS = """one AS (SELECT 'p' || id AS id, title, CASE WHEN id % 2 = 0 THEN '10.1000/p.' || id END AS doi, id AS n FROM index_old),
        two AS (SELECT 'p' || id AS id, title, CASE WHEN id % 2 = 0 THEN '10.1000/p.' || id END AS doi, id AS n FROM index_new),
        merged AS (SELECT * FROM two UNION ALL SELECT * FROM one WHERE id NOT IN (SELECT id FROM two)),
        four AS (SELECT * FROM merged WHERE id NOT IN (SELECT id FROM one WHERE n % 11 = 0) UNION ALL SELECT * FROM one WHERE n % 22 = 0)"""

_QUERIES = {
    claims_near_citation: with_views("mechanism_prose", f"""{_NEAR} SELECT a.file, a.raw AS number, a.s AS number_start, b.raw AS citation, b.s AS citation_start, {_GAP}::BIGINT AS gap
        FROM numbers a JOIN cites b ON a.file = b.file AND {_GAP} <= {consistency.NEAR} WHERE NOT (a.s >= b.s AND a.e <= b.e)"""),
    uncited_numbers: with_views("mechanism_prose", f"{_NEAR} SELECT a.file, a.raw AS number, a.s AS start FROM numbers a WHERE NOT EXISTS (SELECT 1 FROM cites b WHERE a.file = b.file AND {_GAP} <= {consistency.UNCITED})"),
    mechanism_claims: with_views("mechanism_prose", f'SELECT file, raw, s AS start, e AS "end" FROM ({S.spans("mechanism_prose", "(?i)" + consistency.MECHANISM)}) m'),
    unverified_claims: with_views("mechanism_prose", f"""{_NEAR} SELECT a.file, a.raw AS number, a.s AS number_start, b.raw AS citation, b.s AS citation_start, {_GAP}::BIGINT AS gap
        FROM numbers a JOIN cites b ON a.file = b.file AND {_GAP} <= {consistency.NEAR} WHERE NOT (a.s >= b.s AND a.e <= b.e) AND a.file IN (SELECT file FROM mechanism_prose WHERE contains(content, 'in 12.5% of'))"""),
    cited_parameters: with_views("mechanism_prose", f"""WITH cites AS ({S.spans('mechanism_prose', P.INLINE)}), named AS ({S.spans('mechanism_prose', consistency.PARAMETER)}),
        pairs AS (SELECT a.file, a.raw, a.s, a.e, b.raw AS citation, b.s AS place, {_GAP} AS gap FROM named a JOIN cites b ON a.file = b.file AND {_GAP} <= {consistency.NEAR} WHERE NOT (a.s < b.e AND b.s < a.e)),
        best AS (SELECT *, row_number() OVER (PARTITION BY file, s ORDER BY gap, place) AS n, regexp_extract(raw, '({consistency.NUMBER})\\z', 1) AS value FROM pairs)
        SELECT file, lower(regexp_extract(raw, '{consistency.PARAMETER}', 1)) AS param, value, (e - length(value))::BIGINT AS value_start, citation FROM best WHERE n = 1"""),
    param_conflicts: with_views("measured", "SELECT param, citation, count(DISTINCT value) AS n_values, count(DISTINCT file) AS files, array_to_string(list_sort(list_distinct(list(value))), '|') AS found FROM measured GROUP BY ALL HAVING count(DISTINCT value) > 1"),
    changed_claims: "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE sha256(coalesce(text, '')) <> sha256(coalesce(replace(text, chr(10), ' '), ''))",
    validation_rules: with_views("checks", """WITH f AS (SELECT *, CASE WHEN NOT verified OR (NOT in_index AND NOT has_doi) THEN 'unverified citation' WHEN lower(string_split(claimed[1], ',')[1]) <> lower(string_split(actual[1], ',')[1]) THEN 'author mismatch' WHEN similarity < 0.8 THEN 'title mismatch' WHEN year <> actual_year THEN 'year mismatch' END AS failure,
          array_to_string(list_filter([CASE WHEN ambiguous THEN 'ambiguous: add DOI or journal' END, CASE WHEN et_al AND NOT listed THEN 'expand authors' END, CASE WHEN in_index AND NOT has_doi THEN 'add DOI for verification' END,
            CASE WHEN number IS NOT NULL AND number IS DISTINCT FROM index_number THEN 'verify article number' END, CASE WHEN coalesce(similarity <= 0.95, true) THEN 'title only similar or not compared' END], lambda w: w IS NOT NULL), '; ') AS warnings FROM checks)
        SELECT id, failure, warnings, CASE WHEN failure IS NOT NULL THEN 'error' WHEN warnings <> '' THEN 'warning' ELSE 'pass' END AS level FROM f"""),
    confidence_levels: with_views("evidence", """WITH s AS (SELECT id, CASE WHEN has_number AND ((year >= 2020 AND NOT has_doi) OR NOT peer_reviewed) THEN 0 WHEN textbook THEN 2 ELSE 1 END + in_log::INT + verified::INT + in_abstract::INT AS score FROM evidence)
        SELECT id, score, CASE WHEN score >= 2 THEN 'HIGH' WHEN score = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s"""),
    index_upsert: with_views("index_old index_new", "WITH u AS (SELECT * FROM index_old UNION ALL SELECT * FROM index_new) SELECT id, arg_max(title, version) AS title, max(version) AS version FROM u GROUP BY id"),
    index_diff: with_views("index_old index_new", """SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, a.title AS old, b.title AS new,
        CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.title IS DISTINCT FROM b.title THEN 'changed' END AS change FROM index_old a FULL JOIN index_new b ON a.id = b.id) d WHERE change IS NOT NULL"""),
    stored_index: with_views("index_old index_new", f"WITH {_VERSIONS} SELECT id, title, doi FROM four"),
    stored_index_diff: with_views("index_old index_new", f"""WITH {_VERSIONS} SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.title IS DISTINCT FROM b.title THEN 'changed' END AS change,
        CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'title' END AS columns, a.title AS old_title, b.title AS new_title FROM one a FULL JOIN four b ON a.id = b.id) d WHERE change IS NOT NULL"""),
    cosine_topk: f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT id, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS x FROM v WHERE list_sum(list_transform(x, lambda z: z * z)) > 0),
        s AS (SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.x, c.x) AS score FROM n q JOIN n c ON q.id <> c.id WHERE q.id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 9) AS score FROM r WHERE rank <= 5""",
}
QUERIES = {f.__name__: f for f in (*_QUERIES, value_drift, et_al_authors)}
ORACLES = {f.__name__: sql for f, sql in _QUERIES.items()}


def _borrowed() -> dict[str, str]:
    """Oracles that rest on the other modules' SQL."""
    from glosswerk.plans.citation_queries import audit_sql
    from glosswerk.plans.claim_queries import _catalog_sql, _refs

    values = S.found(f"regexp_replace(text, '{P.CLAIM_REFERENCE}', '', 'g')", S.NUMBERS)
    drift = f"""WITH refs AS ({_refs("drift_prose")}), {_catalog_sql("aggregate_md")},
        v AS (SELECT r.file, r.line, notebook, claim_id, unnest({values}) AS value FROM refs r JOIN ({S.lines("drift_prose")}) l ON l.file = r.file AND l.line = r.line)
        SELECT v.* FROM v JOIN claims c ON c.nb = v.notebook AND c.claim_id = v.claim_id WHERE NOT list_contains({S.found("c.text", S.NUMBERS)}, value)"""
    return {"value_drift": with_views("drift_prose aggregate_md", drift), "et_al_authors": audit_sql("""SELECT a.file, a.raw, a.lookup_key, a.id, array_to_string(e.authors, '|') AS authors
        FROM (SELECT file, raw, lookup_key, unnest(CASE WHEN ids IS NULL THEN [NULL] ELSE string_split(ids, ',') END) AS id FROM audited WHERE contains(raw, 'et al.')) a LEFT JOIN bib_entries e ON e.id = a.id""")}


ORACLES |= _borrowed()
