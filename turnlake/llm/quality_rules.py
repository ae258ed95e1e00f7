"""Quality rules: a threshold table compiled into one Spark projection.

Length, symbol, capital, stop-word and line ratios of a whole text are columns of built-in functions, and each row of
THRESHOLDS becomes one comparison of integer sums. No user function runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, words_of

#: Function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this at are an from he his which or had not but have "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es werden aus hat dass "
    "de la le et les un une du en que est pour qui dans par plus pas au sur ne se ce il sont avec "
    "el y los del las por con no su para al lo como más o pero sus"
).split()

#: name, measure, factor, other measure, bound, fewest words: a text of so many words fails if factor * measure > bound * other.
THRESHOLDS = (
    ("symbols", "n_symbols", 10, "n_words", 1, 0),
    ("capitals", "n_capitals", 100, "word_chars", 40, 0),
    ("short_words", "n_words", 2, "word_chars", 1, 0),
    ("long_words", "word_chars", 1, "n_words", 25, 0),
    ("few_stop_words", "n_words", 2, "n_stop_words", 100, 60),
    ("repeated_lines", "n_dup_lines", 100, "n_lines", 30, 0),
)
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5


def measures(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with _m, a struct of n_words, word_chars, n_symbols, n_capitals, n_stop_words, n_lines, n_dup_lines and n_repeat_words.

    A column named _m is replaced; the columns that are needed in between have names that docs doesn't have.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.drop("_m")
    words, lines, hashes, windows, ordered, places = made = free_names(docs, "_words", "_lines", "_hashes", "_windows", "_sorted", "_at")
    has_word = lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""
    out = docs.withColumn(words, words_of(F.col("text"))).withColumn(lines, F.filter(F.split(text, "\n"), has_word))
    # A window's hash is that of its words' hashes; each word is hashed once.
    out = out.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    starts = F.slice(hashes, 1, F.greatest(F.size(words) - (window - 1), F.lit(0)))
    out = out.withColumn(windows, F.transform(starts, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, window)))))
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    # Only texts in which some window repeats pay for the sort that finds which.
    out = out.withColumn(ordered, F.when(repeated, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn(
        places,
        F.expr(f"sort_array(transform(filter(transform({ordered}, (e, j) -> named_struct('i', e.i, 'twice', get({ordered}, j - 1).h <=> e.h OR get({ordered}, j + 1).h <=> e.h)), x -> x.twice), x -> x.i))"),
    )
    covered = F.expr(f"aggregate(transform({places}, (p, j) -> least({window}, coalesce(get({places}, j + 1) - p, {window}))), 0L, (s, x) -> s + x)")
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
        "n_capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    return out.withColumn("_m", F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))).drop(*made)


def failed_rules(m: Column, thresholds=THRESHOLDS) -> Column:
    """The names of the rows of the table that a text fails, as an array."""
    hit = [F.when((m["n_words"] >= least) & (factor * m[a] > bound * m[b]), F.lit(name)) for name, a, factor, b, bound, least in thresholds]
    return F.array_compact(F.array(*hit))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """docs plus the struct _m of measures, base_failed, failed_rules (array of names) and kept.

    Null and blank texts have no word and so fail the base rule; a text may be of any length; repeated rows are judged
    alike; an empty table gives an empty result. Columns of docs stay as they are, except that _m, base_failed,
    failed_rules and kept are replaced.
    """
    m = F.col("_m")
    out = measures(docs).withColumn("base_failed", base_failed(m)).withColumn("failed_rules", failed_rules(m, thresholds))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of each whole text of documents. A null text has no words and fails, repeated rows are judged alike, an empty table gives an empty result."""
    from .common import documents

    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    more = ("n_capitals", "n_stop_words", "n_lines")
    return out.select("doc_id", *(F.col("_m")[n].alias(n) for n in names), "base_failed", "kept", *(F.col("_m")[n].alias(n) for n in more))


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT r, i, list_slice(ws, i, i + 4) AS win FROM g),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM h) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(len(list_filter(ws, lambda x: x IN ({", ".join(f"'{s}'" for s in STOP_WORDS)}))) AS BIGINT) AS n_stop_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM w LEFT JOIN cov ON w.r = cov.r),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"(n_words >= {least} AND {factor} * {a} > {bound} * {b})" for _, a, factor, b, bound, least in THRESHOLDS)}) AS kept,
  n_capitals, n_stop_words, n_lines FROM b
"""
