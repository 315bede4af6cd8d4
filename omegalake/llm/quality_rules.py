"""Line-first quality rules in DataFrame functions only.

Each line is judged by itself (punctuation, shouting, navigation, boilerplate), failing lines
are removed, and a document that loses too much of its text is rejected. All counts are made
within a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words.
_SPACE = " \t\n\x0b\f\r"
_SPACE_RUN = r"[\x20\x09-\x0D]+"
_VISIBLE = r"[^\x20\x09-\x0D]"
_SYMBOL, _SEPARATOR = "[#*$%&|<>]", "[|»›•]"

#: A line with more symbols than this percentage of its visible characters fails.
MAX_SYMBOL_PERCENT = 20
#: A line with at least LEAST_SHOUTED words fails if this percentage of words has an exclamation or question mark.
MAX_SHOUT_PERCENT, LEAST_SHOUTED = 50, 4
#: A line with at least this many separators, standing for a third of its words, fails as navigation.
LEAST_SEPARATORS = 4
#: A document that keeps less than this percentage of its visible characters is rejected.
MIN_KEPT_PERCENT = 50

#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "enable javascript",
    "log in",
    "privacy policy",
    "share this",
    "sign up",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
)
_BOILERPLATE_LINE = r"(?:^|[^a-z])(?:" + "|".join(BOILERPLATE) + r")(?:[^a-z]|$)"
#: A boilerplate line has at most this many words: prose may mention such a phrase.
MAX_BOILERPLATE_WORDS = 12


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _visible(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(text) - _count(text, r"[\x20\x09-\x0D]")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE_RUN))


def window_hashes(words: Column) -> Column:
    """The 64-bit hash of each three-word window; ``words`` must be a stored column."""
    at = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window found at least twice; ``hashes`` (of all windows) must be a stored column.

    Where all windows differ there are none; else the windows are sorted, so that equal ones are neighbours.
    """

    def starts(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def covered(begin: Column) -> Column:
        each = F.transform(begin, lambda b, k: F.least(F.lit(3), F.coalesce(F.get(begin, k + 1) - b, F.lit(3))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x)

    windows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    found = _let(F.sort_array(windows), lambda s: _let(starts(s), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails one of the rules."""
    counts = F.struct(
        _visible(line).alias("visible"),
        _count(line, r"[^\x20\x09-\x0D]+").alias("words"),
        _count(line, r"[!?](?:[\x20\x09-\x0D]|\z)").alias("marked"),
        _count(line, _SEPARATOR).alias("separators"),
        _count(line, _SYMBOL).alias("symbols"),
    )
    return _let(
        counts,
        lambda c: (100 * c["symbols"] > MAX_SYMBOL_PERCENT * c["visible"])
        | ((c["words"] >= LEAST_SHOUTED) & (100 * c["marked"] > MAX_SHOUT_PERCENT * c["words"]))
        | ((c["separators"] >= LEAST_SEPARATORS) & (3 * c["separators"] >= c["words"]))
        | ((c["words"] <= MAX_BOILERPLATE_WORDS) & F.lower(line).rlike(_BOILERPLATE_LINE)),
    )


def _judged(docs: DataFrame, text: str, *carried: Column) -> DataFrame:
    """``_row`` (a struct of the carried columns), what the rules find, and ``_n``.

    ``_n`` is there so that a filter on the findings stays above the projection that makes
    them: pushed below, it would split the text into words anew for every window.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*carried).alias("_row")
    base = docs.select(row, t.alias("_text"), words_of(t).alias("_words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(_VISIBLE)).alias("_lines"))
    hashed = base.withColumn("_windows", window_hashes(F.col("_words")))
    counted = hashed.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        _visible(F.col("_text")).cast("long").alias("word_chars"),
        _count(F.col("_text"), _SYMBOL).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).alias("n_repeat_words"),
        F.filter("_lines", lambda x: ~line_fails(x)).alias("_passed"),
        F.monotonically_increasing_id().alias("_n"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.aggregate("_passed", F.lit(0).cast("long"), lambda n, x: n + _visible(x))
    return counted.select(
        "_row", "_n", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * left >= MIN_KEPT_PERCENT * F.col("word_chars"))).alias("kept"),
        F.array_join("_passed", "\n").alias("clean_text"),
    )


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, the counts, ``base_failed``, ``kept`` and ``clean_text``.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words are counts over the whole text.
    base_failed: fewer than 50 words, or more than half of them in repeated windows. kept:
    neither that nor too much text lost with failing lines. clean_text: the lines that passed.
    Null text has no words and fails; rows with the same key each get a row. No rows: no rows.
    """
    found = _judged(docs, text, F.col(key).alias("doc_id"))
    return found.select("_row.doc_id", *(c for c in found.columns if c not in ("_row", "_n")))


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with their columns as they are (the whole text too)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    return _judged(docs, text, *own).where("kept and _n >= 0").select("_row.*")


_BOILERPLATE_SQL = _BOILERPLATE_LINE.replace("'", "''")

#: The same result in DuckDB SQL, without the cleaned text.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT rowid, i, count(*) OVER (PARTITION BY rowid, a, b, c) AS times
  FROM (SELECT rowid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT row_number() OVER () AS rowid, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT w, doc_id FROM d ORDER BY doc_id)))),
covered AS (
  SELECT rowid, count(DISTINCT i + k) AS n FROM windows, range(3) AS r(k) WHERE times > 1 GROUP BY rowid),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, lines
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rowid FROM d) d LEFT JOIN covered c USING (rowid)),
judged AS (
  SELECT *, coalesce(list_sum(list_transform(list_filter(lines, lambda x: NOT (
      100 * (length(x) - length(translate(x, '#*$%&|<>', ''))) > {MAX_SYMBOL_PERCENT} * length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))
      OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {LEAST_SHOUTED}
          AND 100 * len(regexp_extract_all(x, '[!?][\x20\x09-\x0D]|[!?]$')) > {MAX_SHOUT_PERCENT} * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
      OR (length(x) - length(translate(x, '|»›•', '')) >= {LEAST_SEPARATORS}
          AND 3 * (length(x) - length(translate(x, '|»›•', ''))) >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
      OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= {MAX_BOILERPLATE_WORDS} AND regexp_matches(lower(x), '{_BOILERPLATE_SQL}')))),
    lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')))), 0) AS kept_chars,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * kept_chars >= {MIN_KEPT_PERCENT} * word_chars AS kept
FROM judged
"""
