"""Quality rules: a threshold table compiled into one projection of text ratios.

All measures are Spark expressions over one row; nothing is shuffled and no Python
runs.  Words are ``[^\\x20\\x09-\\x0D]+``, lines the pieces between ``\\n``.

Odd input: a null or empty text has no words and fails the base; ratios over zero
words or lines count as 0.  A text of any length is measured whole, in the memory of
its words.  Repeated rows are judged alike, and an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswerk.llm.shared import WS, WS_CLASS, aside

MIN_WORDS = 50
#: Percent of words that may stand in repeated three-word windows.
MAX_REPEAT = 50
SYMBOLS = "#*$%&|<>"

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "für", "im", "ist", "mit", "sich", "und", "von", "zu",
    "au", "aux", "ce", "de", "du", "en", "est", "et", "la", "le", "les", "par", "pour", "que", "sur", "un", "une",
    "al", "con", "del", "el", "las", "los", "no", "por", "se", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """``low`` <= sum of ``over`` / ``under`` <= ``high``; either bound may be None."""

    name: str
    over: str
    under: str
    low: float | None
    high: float | None


#: The method's verdict: every rule must hold.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.3),
    Rule("shouting_ratio", "n_shouted", "n_words", None, 0.3),
)


def ratio(rule: Rule) -> Column:
    return F.coalesce(F.try_divide(F.col(rule.over), F.col(rule.under)), F.lit(0.0))


def verdict(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression for the whole table."""
    tests = [test for r in rules for test in ([ratio(r) >= r.low] if r.low is not None else []) + ([ratio(r) <= r.high] if r.high is not None else [])]
    return reduce(Column.__and__, tests, F.lit(True))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop_words and n_shouted (all long); columns of these names are
    replaced, all others stay."""
    made = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_shouted")
    docs, back = aside(docs.drop(*made), text)
    own = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(WS))
    out = docs.withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WS_CLASS}+")))
    # Three-word windows as (hash, place), sorted, so that equal windows are neighbours.
    windows = F.transform(F.slice("__words", 1, F.greatest(F.size("__words") - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i")))
    out = out.withColumn("__lines", F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WS)) != ""))
    out = out.withColumn("__windows", F.sort_array(windows))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    places = F.transform("__windows", lambda x, i: F.when(same(x, F.get("__windows", i - 1)) | same(x, F.get("__windows", i + 1)), x["i"]))
    out = out.withColumn("__places", F.array_sort(F.filter(places, lambda p: p.isNotNull())))
    # A repeated window adds the words that the one before it doesn't cover.
    added = F.transform("__places", lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get("__places", i - 1), p - 3)))
    count = lambda array, test: F.size(F.filter(array, test)).cast("long")
    return out.select(
        *own,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        count("__words", lambda w: F.lower(w).isin(*STOP_WORDS)).alias("n_stop_words"),
        count("__words", lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))).alias("n_shouted"),
    ).withColumnsRenamed(back)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measure`` with base_failed and kept (false if the base failed)."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    return measure(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def digests(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).drop("text")


_SQL_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL_RULES = " AND ".join(
    test
    for r in RULES
    for test in ([f"coalesce({r.over} / nullif({r.under}, 0), 0) >= {r.low}"] if r.low is not None else []) + ([f"coalesce({r.over} / nullif({r.under}, 0), 0) <= {r.high}"] if r.high is not None else [])
)
ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
split AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_SQL_WS}) <> '') AS ls FROM docs),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split),
threes AS (
  SELECT rid, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS t FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, t, count(*) OVER (PARTITION BY rid, t) AS n FROM threes WHERE t IS NOT NULL) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM repeated, range(3) r(k) GROUP BY rid),
counted AS (
  SELECT rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(list_filter(ws, lambda w: lower(w) IN {STOP_WORDS}))::BIGINT AS n_stop_words,
    len(list_filter(ws, lambda w: length(w) > 1 AND w = upper(w) AND w <> lower(w)))::BIGINT AS n_shouted
  FROM split),
measured AS (SELECT c.*, coalesce(v.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM counted c LEFT JOIN covered v USING (rid)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_shouted, base_failed,
       NOT base_failed AND {_SQL_RULES} AS kept
FROM based
"""
