"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from glosswerk.functions import patterns as P
from glosswerk.operators.consistency import NUMBER


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{P.SPACE}+|{P.SPACE}+\\z', '', 'g')"


def first(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def found(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, '{pattern}', {group})"


def words(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '[^A-Za-z0-9_{P.SPACE[1:]}', '', 'g')"
    return f"list_distinct(list_filter(regexp_split_to_array({plain}, '{P.SPACE}+'), lambda w: length(w) > 2))"


def similarity(a: str, b: str) -> str:
    """Of two word lists."""
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


def contains_all(a: str, b: str) -> str:
    return f"(len({b}) > 0 AND len(list_intersect({a}, {b})) = len({b}))"


def lines(view: str) -> str:
    """file, line, text of a (file, content) relation."""
    return f"SELECT file, unnest(ls) AS text, unnest(range(1, len(ls) + 1))::INT AS line FROM (SELECT file, string_split(content, chr(10)) AS ls FROM {view}) x"


def spans(view: str, pattern: str) -> str:
    """file, raw, s, e (code points, end exclusive) of every match in (file, content)."""
    return f"""SELECT file, raw, (e - length(raw))::BIGINT AS s, e FROM (
      SELECT file, raw, sum(length(raw) + length(gap)) OVER (PARTITION BY file ORDER BY pos)::BIGINT AS e FROM (
        SELECT file, unnest(m) AS raw, unnest(g[:len(m)]) AS gap, unnest(range(len(m))) AS pos FROM (
          SELECT file, {found("content", pattern)} AS m, regexp_split_to_array(content, '{pattern}') AS g FROM {view}) x) y) z"""


NUMBERS = NUMBER
