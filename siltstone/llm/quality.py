"""Quality rules as a short-circuit cascade (operator 2), DataFrame functions only.

A rule is a Boolean expression over the text that is true where a document must go.
On a sample, each rule's cost (time per row) and selectivity (share rejected) are
measured, and the rules are ordered by rejections per cost (of equal ones the cheaper first). The verdict is one nested
CASE in that order, so an expensive rule only runs on rows that the cheaper and more
selective ones before it have left. The order changes the cost, never the verdict.

Null text counts as empty: it has no words and is rejected as too short. Equal rows get equal
rows; an empty table gives an empty table. Only doc_id and text are read by the query;
``quality_filter`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_SPACES = "[ \t\n\x0b\f\r]+"

#: Fixed values of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MAX_SYMBOLS_PER_WORD, MIN_MEAN_WORD, MAX_MEAN_WORD, MAX_DUP_LINES = 0.1, 3.0, 12.0, 0.5
SYMBOLS = "[#*$%&|<>]"
MIN_LETTERED_WORDS, MAX_CAPITALS, MAX_DIGITS = 0.6, 0.6, 0.3

#: Rows (about) on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (a lambda's variable is bound to it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t\n\x0b\f\r]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(worded_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` (a power of two) words that the text has twice or more.

    Window hashes come from doubling: a hash of 2k words is a hash of two of k words. Only
    where two are equal are they sorted with their places, and the covered words
    are counted from the places in order.
    """
    none = F.lit(0).cast("long")

    def shifted(k: int) -> Callable[[Column], Column]:
        return lambda h: F.slice(F.zip_with(h, F.slice(h, k + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)), 1, F.size(h) - k)

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        places = lambda s: F.array_sort(F.filter(F.transform(s, lambda e, k: F.when((e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"]), e["i"])), lambda p: p.isNotNull()))
        counted = lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - v, F.lit(window)))), none, lambda a, n: a + n)
        return let(ordered, lambda s: let(places(s), counted))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    k = 1
    while k < window:
        hashes, k = let(hashes, shifted(k)), 2 * k
    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
    return F.when(F.size(w) <= window, none).otherwise(repeated)


@dataclass(frozen=True)
class Rule:
    """``fails`` takes the text and gives the Boolean that rejects it."""

    name: str
    fails: Callable[[Column], Column]


def _words_of(text: Column) -> Column:
    return F.size(words(text))


#: Rules that need more than the base metrics.
EXTRA = (
    Rule("lettered_words", lambda t: let(words(t), lambda w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))) < MIN_LETTERED_WORDS * F.size(w))),
    Rule("capitals", lambda t: F.regexp_count(t, F.lit(r"\p{Lu}")) > MAX_CAPITALS * F.regexp_count(t, F.lit(r"\p{L}"))),
    Rule("digits", lambda t: F.regexp_count(t, F.lit("[0-9]")) > MAX_DIGITS * F.char_length(t)),
)

RULES = (
    Rule("too_short", lambda t: _words_of(t) < MIN_WORDS),
    Rule("repeats", lambda t: let(words(t), lambda w: 100 * n_repeat_words(w) > MAX_REPEAT_PERCENT * F.size(w))),
    Rule("symbols", lambda t: F.regexp_count(t, F.lit(SYMBOLS)) > MAX_SYMBOLS_PER_WORD * _words_of(t)),
    Rule("word_length", lambda t: let(words(t), lambda w: ~(F.char_length(F.array_join(w, "")) / F.greatest(F.size(w), F.lit(1))).between(MIN_MEAN_WORD, MAX_MEAN_WORD))),
    Rule("duplicate_lines", lambda t: let(worded_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x)) > MAX_DUP_LINES * F.size(x))),
    *EXTRA,
)


def measured_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of about ``rows`` rows, most first."""
    total = docs.count()
    sample = docs.select(_text().alias("text")).sample(min(1.0, rows / max(1, total)), seed=7).persist()
    try:
        share = sample.agg(*(F.avg(r.fails(F.col("text")).cast("double")).alias(r.name) for r in rules)).first()
        cost = {}
        for r in rules:
            began = time.perf_counter()
            sample.agg(F.count_if(r.fails(F.col("text")))).first()
            cost[r.name] = time.perf_counter() - began
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: (-(share[r.name] or 0.0) / cost[r.name], cost[r.name], r.name))


def cascade(rules: list[Rule], text: Column | None = None) -> Column:
    """True where no rule rejects; later rules aren't computed once one has."""
    text = _text() if text is None else text
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(r.fails(text), False).otherwise(out)
    return out


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    return docs.where(cascade(measured_order(docs, rules)))


def quality_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), and text (never null)."""
    w = docs.select("doc_id", _text().alias("text")).withColumn("w", words(F.col("text")))
    return w.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(worded_lines(F.col("text")), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        n_repeat_words(F.col("w")).alias("n_repeat_words"),
        "text",
    ).select("*", F.col("lines.dup").alias("n_dup_lines"), F.col("lines.n").alias("n_lines")).drop("lines")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """The base metrics of all rows; the verdict asks those first, as they are there, and then ``EXTRA`` in measured order, until one rejects."""
    docs = common.table(spark, sf_dir, "documents")
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    known = (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * n) | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
    known |= ~(F.col("word_chars") / F.greatest(n, F.lit(1))).between(MIN_MEAN_WORD, MAX_MEAN_WORD)
    kept = F.when(base | known, False).otherwise(cascade(measured_order(docs, EXTRA), F.col("text")))
    return quality_metrics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"))


OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM d),
x AS (SELECT r, p, array_to_string(w[p:p+7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM w)),
c AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM x),
k AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM c WHERE n > 1),
s AS (SELECT r, sum(least(8, coalesce(q - p, 8))) AS n FROM k GROUP BY r),
l AS (SELECT r, count(*) AS n, count(DISTINCT line) AS u FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]') GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n - l.u, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(s.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}'))) AS lettered, length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) AS capitals,
  length(regexp_replace(t, '\\P{L}', '', 'g')) AS letters, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(t) AS chars
  FROM d JOIN w USING (r) LEFT JOIN s USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > 0.1 * n_words
    OR word_chars / greatest(n_words, 1) NOT BETWEEN 3 AND 12 OR n_dup_lines > 0.5 * n_lines
    OR lettered < 0.6 * n_words OR capitals > 0.6 * letters OR digits > 0.3 * chars) AS kept
FROM m
"""
