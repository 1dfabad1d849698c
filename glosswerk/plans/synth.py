"""Derived inputs: citation corpora made of the test tables by plain SQL.

One text serves both engines; ``{lineitem}`` and the like stand for tables, and the
few differences between the dialects are the functions of ``Dialect``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"


@dataclass(frozen=True)
class Dialect:
    name: str

    def join_up(self, x: str, sep: str, order: str) -> str:
        if self.name == "spark":
            return f"listagg({x}, {sep}) WITHIN GROUP (ORDER BY {order})"
        return f"string_agg({x}, {sep} ORDER BY {order})"

    def map_of(self, *pairs: str) -> str:
        keys, values = ", ".join(pairs[::2]), ", ".join(pairs[1::2])
        return f"map_from_arrays(array({keys}), array({values}))" if self.name == "spark" else f"map([{keys}], [{values}])"

    def list_of(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.name == "spark" else f"[{', '.join(items)}]"


_NOUN, _ADJ = "split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 1)"
_UPPER = lambda x: f"upper(substr({x}, 1, 1)) || substr({x}, 2)"
_YEAR = "(1970 + p_size)"
_TITLE = "p_name || ' ' || lower(p_type) || ' for ' || lower(replace(p_brand, '#', ' ')) || ' number' || p_size"
_BS = "chr(92)"


def _json(text: str) -> str:
    """SQL of a JSON string literal from SQL text with real line ends."""
    return f"""'"' || replace({text}, {NL}, {_BS} || 'n') || '"'"""


_AUTHOR = """'{{"family": "' || p_brand || '"' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ', "given": "A. B."' END || '}}'"""
_work = f"""'{{{{"DOI": "10.1000/p.' || p_partkey || '"' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ', "score": ' || (p_size + 0.5) END || ', "title": ["' || p_name || '"], "author": [' || CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN {_AUTHOR} || ', ' || {_AUTHOR} || ', ' || {_AUTHOR} || ', ' || {_AUTHOR} ELSE {_AUTHOR} END ||
        ']' || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE ', "container-title": ["' || p_type || '"]' END || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ', "published": {{{{"date-parts": [[' || {_YEAR} || ', 1]]}}}}' END || '}}}}'"""


def views(d: Dialect) -> dict[str, str]:
    noun, adj = _UPPER(_NOUN), _UPPER(_ADJ)
    sentence = f"""CASE l_partkey % 5 WHEN 0 THEN {noun} || ' (' || {_YEAR} || ')' WHEN 1 THEN {noun} || ' et al. (' || {_YEAR} || ')'
        WHEN 2 THEN {noun} || ' & ' || {adj} || ' (' || {_YEAR} || ')' WHEN 3 THEN 'However, ' || {noun} || ' (' || {_YEAR} || ')'
        ELSE '(' || {noun} || ', ' || {_YEAR} || ')' END"""
    item = f"""'<li id="bib.bib' || l_linenumber || '"><b>A. Author</b> (' || {_YEAR} || '). ' || {_TITLE} || '. Journal of Parts. ' ||
        CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '<a href="https://doi.org/10.48550/a.' || l_partkey || '">link</a>'
        WHEN 2 THEN '<a href="https://doi.org/10.1000/p.' || l_partkey || '">link</a>' ELSE '<a href="https://doi.org/10.1000/p.' || (l_partkey + 1) || '">link</a>' END || '</li>'"""
    claims = f"'| ID | Claim | Value |' || {NL} || '|----|----|----|' || {NL} || " + d.join_up("'| **K' || (r_regionkey + 1) || '** | ' || r_name || ' | 1 |'", NL, "r_regionkey")
    table = f"(SELECT {claims} FROM {{region}} WHERE r_regionkey <= n_nationkey % 5)"
    head = "CASE n_nationkey % 5 WHEN 2 THEN '### Key Claims' WHEN 4 THEN '##Key Claims' ELSE '## Key Claims' END"
    body = f"{head} || {NL} || '<!-- Verified: 2026-04-' || lpad(CAST(n_nationkey + 1 AS VARCHAR(2)), 2, '0') || ' -->' || {NL} || claims || {NL} || '## Notes' || {NL} || '| K9 | not counted | 1 |'"
    source = f"CASE WHEN n_nationkey % 2 = 0 THEN '[' || {_json('body')} || ']' ELSE {_json('body')} END"
    number = "lpad(CAST(n_nationkey AS VARCHAR(2)), 2, '0')"
    entry = """'<entry><id>http://arxiv.org/abs/s' || s_suppkey || 'v' || (s_suppkey % 3 + 1) || '</id>' || CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE '<published>2024-0' || (s_suppkey % 9 + 1) || '-1' || (s_suppkey % 7) || 'T00:00:00Z</published>' END || '<category term="cs.' || CASE WHEN s_suppkey % 2 = 0 THEN 'AI' ELSE 'CL' END || '"/><title>' || chr(10) || ' ' || s_name || ' </title><author><name>' || s_name || '</name></author><author><name>B. N' || s_nationkey || '</name></author>' || CASE WHEN s_suppkey % 4 = 0 THEN '<author><name>C. C</name></author><author><name>D. D</name></author>' ELSE '' END || '</entry>'"""
    typed = f"CASE p_partkey % 4 WHEN 0 THEN {_TITLE} WHEN 1 THEN substr({_TITLE}, 1, 5) || substr({_TITLE}, 7) WHEN 2 THEN substr({_TITLE}, 1, 9) || 'xq' || substr({_TITLE}, 10) ELSE replace({_TITLE}, 'o', '0') END"
    return {
        "prose_files": f"""SELECT 'docs/o' || l_orderkey || '.md' AS file, {d.join_up("sentence", "'. '", "l_linenumber, l_partkey, sentence")} AS content
            FROM (SELECT l_orderkey, l_linenumber, l_partkey, {sentence} AS sentence FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey) s GROUP BY l_orderkey""",
        "bib_entries": f"""SELECT 'p' || p_partkey AS id, {d.list_of(_NOUN + " || ', X.'", "'Other, Y.'")} AS authors, p_name AS title, CAST({_YEAR} AS INT) AS year,
            CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '10.1000/p.' || p_partkey END AS doi, CAST(p_partkey AS BIGINT) AS pos FROM {{part}} WHERE p_partkey % 7 = 0""",
        "bib_raw": f"""SELECT 'P' || (p_partkey % 500) AS citation_key, {d.map_of("'author'", "'{{' || p_brand || ', A.}} and  B. ' || p_brand || ' AND '", "'title'", "'{{' || p_name || '}} '", "'year'", "CASE p_partkey % 4 WHEN 0 THEN '{{2010}}' WHEN 1 THEN '2010a' WHEN 2 THEN '' ELSE CAST(1970 + p_size AS VARCHAR(8)) END", "'journal'", "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END", "'booktitle'", "p_type", "'doi'", "CASE WHEN p_partkey % 3 = 0 THEN ' {{}} ' ELSE '{{10.1000/p.' || p_partkey || '}}' END", "'url'", "'http://arxiv.org/abs/1234.' || (10000 + p_size)")} AS tags,
            CAST(p_partkey AS BIGINT) AS pos FROM {{part}}""",
        "part_files": f"""SELECT 'bib/s' || p_size || '.bib' AS file, p_partkey, p_name, p_brand, p_type, p_size FROM {{part}}""",
        "bib_text": f"""SELECT 'bib/s' || p_size || '.bib' AS file, '@string{{{{jop = "Journal of Parts"}}}}' || {NL} || '@comment{{{{@article{{{{old, title={{{{Old}}}}}}}}}}}}' || {NL} || {d.join_up("entry", NL, "p_partkey")} AS content
            FROM (SELECT p_size, p_partkey, '@Article{{{{P' || p_partkey || ', Title = {{{{C# in ' || p_name || '}}}},' || {NL} || ' author = "A {{{{"Q"}}}} Author and {{{{B}}}} ' || p_brand || '",' || {NL} || ' journal = jop # " " # {{{{' || p_type || '}}}}, note={{{{see @misc{{{{b, title={{{{X}}}}}}}} there}}}}, year = ' || {_YEAR} || {NL} || '}}}}' AS entry FROM {{part}}) s GROUP BY p_size""",
        "registry_works": f"""SELECT '10.1000/p.' || p_partkey AS doi, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_name END AS title, {d.list_of("CASE WHEN p_partkey % 5 = 0 THEN 'Nobody, X.' ELSE " + _NOUN + " || ', X.' END", "'Further, F.'")} AS authors,
            CAST({_YEAR} + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS year FROM {{part}} WHERE p_partkey % 13 <> 0""",
        "ref_lines": f"""SELECT 'refs/s' || p_size || '.md' AS file, {d.join_up("line", NL, "p_partkey, line")} AS content
            FROM (SELECT p_size, p_partkey, '- ' || p_name || ' (' || {_YEAR} || '). ' || p_type || '. *' || p_brand || '*, ' || p_size || '. doi:10.1000/p.' || p_partkey || ', https://doi.org/10.1000/(q' || p_partkey || ') arXiv: 2101.' || lpad(CAST(p_partkey % 100000 AS VARCHAR(5)), 5, '0') AS line FROM {{part}}) s GROUP BY p_size""",
        "claim_prose": f"""SELECT 'docs/u' || user_id || '.md' AS file, {d.join_up("'Effect ' || event_type || ' [NB' || (user_id % 25) || ':K' || (event_id % 7 + 1) || ']'", NL, "event_id")} AS content FROM {{events}} GROUP BY user_id""",
        "aggregate_md": f"""SELECT 'catalog.md' AS file, {d.join_up("section", f"{NL} || {NL}", "n_nationkey")} AS content
            FROM (SELECT n_nationkey, '## NB' || n_nationkey || ': `' || n_name || '`' || {NL} || {NL} || {table} AS section FROM {{nation}} WHERE n_nationkey < 20) s""",
        "notebooks_json": f"""SELECT {number} || CASE WHEN n_nationkey % 3 = 1 THEN '_5_' ELSE '_' END || lower(replace(n_name, ' ', '_')) || '.ipynb' AS file,
            CASE WHEN n_nationkey % 5 = 3 THEN '{{{{"cells": [' WHEN n_nationkey % 7 = 6 THEN '{{{{"cells": []}}}}' ELSE '{{{{"cells": [{{{{"cell_type": "code", "source": "## Key Claims"}}}}, {{{{"cell_type": "markdown", "source": ["intro"]}}}}, {{{{"cell_type": "markdown", "source": ' || {source} || '}}}}]}}}}' END AS json
            FROM (SELECT n_nationkey, n_name, {body} AS body FROM (SELECT n_nationkey, n_name, {table} AS claims FROM {{nation}}) c) b""",
        "notebook_prose": f"""SELECT 'docs/n' || r_regionkey || '.md' AS file, {d.join_up("'See [NB' || " + number + " || CASE WHEN n_nationkey % 3 = 1 THEN '.5' ELSE '' END || ':K1] and [NB77:K2].'", NL, "n_nationkey")} AS content FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
        "stale_prose": f"""SELECT 'docs/v' || user_id || '.md' AS file, {d.join_up("'Value ' || event_id || ' was 0.' || (800 + event_id % 40) || ' in ' || (1990 + event_id % 10)", NL, "event_id")} AS content FROM {{events}} GROUP BY user_id""",
        "stale_rules": """SELECT value, CASE WHEN p_partkey % 2 = 0 THEN 'superseded' END AS message, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR(9)) END AS correction FROM (
            SELECT p_partkey, p_size, '0.' || p_partkey AS value FROM {part} UNION ALL SELECT p_partkey, p_size, p_partkey || ' was' FROM {part} UNION ALL SELECT p_partkey, p_size, 'in ' || p_partkey FROM {part}
            UNION ALL SELECT p_partkey, p_size, 'Value ' || p_partkey FROM {part} UNION ALL SELECT p_partkey, p_size, p_name FROM {part}) s""",
        "paper_html": f"""SELECT 's' || l_suppkey AS paper, '<html>References<ul>' || {d.join_up("item", "''", "l_orderkey, l_linenumber, l_partkey, item")} || '</ul>' AS html
            FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, {item} AS item FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey) s GROUP BY l_suppkey""",
        "works": f"""SELECT '10.1000/p.' || p_partkey AS doi, {_TITLE} AS title, {d.list_of("p_brand || ', A.'")} AS authors, p_type AS journal, CAST({_YEAR} AS INT) AS year FROM {{part}} WHERE p_partkey % 10 <> 0""",
        "works2": f"""SELECT '10.1000/p.' || p_partkey AS doi, {_TITLE} AS title, {d.list_of("p_brand || ', B.'")} AS authors, p_type AS journal, CAST({_YEAR} AS INT) AS year FROM {{part}} WHERE p_partkey % 20 = 0""",
        "asked_titles": f"""SELECT CASE p_partkey % 3 WHEN 0 THEN {_TITLE} WHEN 1 THEN p_name || ' unheard of things' ELSE lower(p_type) || ' number' || p_size END AS title FROM {{part}} WHERE p_partkey % 25 = 0""",
        "typed_titles": f"""SELECT p_partkey AS id, {typed} AS title FROM {{part}} WHERE p_partkey % 3 = 0""",
        "bib_titled": f"""SELECT 'p' || p_partkey AS id, {d.list_of(_NOUN + " || ', X.'")} AS authors, upper(substr({_TITLE}, 1, 1)) || substr({_TITLE}, 2) AS title, CAST({_YEAR} AS INT) AS year, CAST(NULL AS VARCHAR(9)) AS doi, CAST(p_partkey AS BIGINT) AS pos FROM {{part}} WHERE p_partkey % 7 = 0""",
        "referenced_prose": f"""SELECT 'docs/r' || p_size || '.md' AS file, {d.join_up("line", NL, "p_partkey, line")} AS content
            FROM (SELECT p_size, p_partkey, {noun} || ' (' || {_YEAR} || ') says so.' || {NL} || CASE WHEN p_partkey % 2 = 0 THEN '- ' || {noun} || ', X. (' || {_YEAR} || '). ' || {typed} || '. *Journal*, 3.' ELSE 'No source.' END AS line FROM {{part}} WHERE p_partkey % 9 <> 1) s GROUP BY p_size""",
        "tree_files": """SELECT CASE c_custkey % 7 WHEN 0 THEN 'docs/' WHEN 1 THEN 'docs/.hidden/' WHEN 2 THEN 'node_modules/' WHEN 3 THEN 'docs/dist/' WHEN 4 THEN '.git/x/' WHEN 5 THEN 'a b/' || (c_custkey % 40) || '/' ELSE '' END || CASE c_custkey % 5 WHEN 0 THEN '.' WHEN 1 THEN '_' ELSE '' END || 'c' || c_custkey || CASE c_custkey % 11 WHEN 0 THEN '.html' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' WHEN 3 THEN '.MD' WHEN 4 THEN '.tex' WHEN 5 THEN '.ipynb' WHEN 6 THEN '.js' ELSE '.md' END AS file,
            c_name || ' said Smith (2010) of ' || c_nationkey || chr(10) || 'and ' || c_custkey AS content FROM {customer}""",
        "registry_json": f"""SELECT '10.1000/p.' || p_partkey AS doi, CAST(CASE WHEN p_partkey % 13 = 0 THEN 404 ELSE 200 END AS INT) AS status, CASE WHEN p_partkey % 17 = 0 THEN '{{{{"mess' ELSE '{{{{"message": ' || {_work} || '}}}}' END AS body FROM {{part}}""",
        "search_json": f"""SELECT 'q' || p_size AS query, CAST(CASE WHEN p_size % 10 = 0 THEN 500 ELSE 200 END AS INT) AS status, '{{{{"message": {{{{"items": [' || {d.join_up("work", "','", "p_partkey")} || ']}}}}}}}}' AS body
            FROM (SELECT p_size, p_partkey, {_work} AS work FROM {{part}} WHERE p_partkey % 10 = 1) s GROUP BY p_size""",
        "search_hits": f"""SELECT query, CAST(1 AS INT) AS rank, min(title) AS title, CAST(min(score) AS DOUBLE) AS score FROM (
            SELECT q.query, q.score, w.title FROM (SELECT {_TITLE} AS query, p_partkey % 60 + 20 AS score, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE (p_partkey * 7) % 1000 + 1 END AS hit FROM {{part}} WHERE p_partkey % 4 = 0) q
            JOIN (SELECT p_partkey, {_TITLE} AS title FROM {{part}}) w ON w.p_partkey = q.hit) s GROUP BY query""",
        "feed_xml": f"""SELECT 'f' || s_nationkey AS feed, '<feed>' || {d.join_up(entry, "''", "s_suppkey")} || '</feed>' AS xml FROM {{supplier}} GROUP BY s_nationkey""",
        "mechanism_prose": f"""SELECT 'docs/m' || p_size || '.md' AS file, {d.join_up("line", NL, "p_partkey")} AS content
            FROM (SELECT p_size, p_partkey, CASE p_partkey % 4 WHEN 0 THEN {noun} || ' (' || {_YEAR} || ') shows that ' || {_ADJ} || ' causes ' || {_NOUN} || ' in 12.5% of cases'
            WHEN 1 THEN {_NOUN} || ' modulates ' || {_ADJ} || ' by ' || (p_partkey % 97) || '%' ELSE 'a long passage without any finding, source or figure, that only fills the space between two claims of this text' END AS line FROM {{part}}) s GROUP BY p_size""",
        "drift_prose": f"""SELECT 'docs/d' || user_id || '.md' AS file, {d.join_up("'Value ' || (event_id % 3) || ' at [NB' || (user_id % 25) || ':K' || (event_id % 7 + 1) || ']'", NL, "event_id")} AS content FROM {{events}} GROUP BY user_id""",
        "checks": f"""SELECT p_partkey AS id, p_partkey % 10 <> 0 AS verified, p_partkey % 3 <> 0 AS in_index, p_partkey % 4 <> 0 AS has_doi, CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_partkey % 41 AS DOUBLE) / 40 END AS similarity, {_YEAR} AS year, {_YEAR} + CASE WHEN p_partkey % 5 = 1 THEN 1 ELSE 0 END AS actual_year,
            {d.list_of(_NOUN + " || ', X.'")} AS claimed, {d.list_of("CASE WHEN p_partkey % 7 = 0 THEN 'Nobody, X.' ELSE " + _NOUN + " || ', Y.' END")} AS actual, p_partkey % 19 = 0 AS ambiguous, p_partkey % 6 = 0 AS et_al, p_partkey % 12 = 0 AS listed,
            CASE WHEN p_partkey % 8 = 0 THEN p_size END AS number, CASE WHEN p_partkey % 16 = 0 THEN p_size END AS index_number FROM {{part}}""",
        "evidence": """SELECT p_partkey AS id, p_partkey % 2 = 0 AS has_number, 1990 + p_size AS year, p_partkey % 3 = 0 AS has_doi, p_partkey % 4 <> 0 AS peer_reviewed, p_partkey % 9 = 0 AS textbook, p_partkey % 5 = 0 AS verified, p_partkey % 7 = 0 AS in_log, p_partkey % 8 = 1 AS in_abstract FROM {part}""",
        "index_old": """SELECT p_partkey AS id, p_name AS title, CAST(1 AS BIGINT) AS version FROM {part} WHERE p_partkey % 5 <> 0""",
        "index_new": """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS title, CAST(2 AS BIGINT) AS version FROM {part} WHERE p_partkey % 7 <> 0""",
        "measured": """SELECT 'docs/u' || user_id || '.md' AS file, event_type AS param, 'NB' || (user_id % 25) AS citation, CAST(event_id % 3 AS VARCHAR(4)) AS value FROM {events}""",
    }


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_SPARK, _DUCK = views(Dialect("spark")), views(Dialect("duckdb"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a lazy DataFrame over the tables it needs."""
    sql = _SPARK[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def with_views(names: str, sql: str) -> str:
    """DuckDB query with the named derived inputs as leading common table expressions."""
    ctes = [f"{n} AS ({_DUCK[n].format(**{t: t for t in TABLES})})" for n in names.split()]
    body = sql.strip()
    recursive = body.upper().startswith("WITH ")
    return "WITH " + ",\n".join(ctes) + (",\n" + body[5:] if recursive else "\n" + body)
