"""Quality rules with line-first cleaning, in DataFrame functions only.

Every line with a word is judged alone; a line fails if it is one of
* punctuation: 0.3 or more of `#*$%&|<>` a word, or `!!` after 0.3 of the words;
* navigation: capitals are most of its letters, or no letter in three words or more;
* repetition: ten words or more of which under 0.3 are different;
* boilerplate: twelve words or fewer with a phrase of `BOILERPLATE`.
Failing lines go (`clean_text`), and a document that loses more than `MOST_LOST` percent of the
characters of such lines is rejected.  The base rules come first: fewer than 20 words, or more
than 30 % of the words inside eight-word windows that the text repeats.

Repeated windows are found inside the row: hashes of all windows are compared, and only where two
agree are they sorted with their positions.  Nothing is shuffled, so no key can be hot.

Edge cases: null and empty texts have no words and fail the base; blank lines never count as
repeated and are not judged; equal windows may overlap; other columns pass through
`judged`, with clashing names taken by the rule's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import own_names
from .staging import read_table

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
SYMBOL = f"[{SYMBOLS}]"
MIN_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8  # a power of two: see repeat_words
MOST_LOST = 50
BOILERPLATE = "all rights reserved|terms of use|terms of service|privacy policy|cookie policy|accept cookies|click here|subscribe now|sign up|log in|enable javascript|released under the|read more"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a column named inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def line_fails(line: Column) -> Column:
    symbols = count(line, SYMBOL)
    bangs = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))
    capitals, letters = count(line, r"\p{Lu}"), count(line, r"\p{L}")
    different = F.size(F.array_distinct(F.regexp_extract_all(line, F.lit(WORD), F.lit(0))))
    return let(
        count(line, WORD),
        lambda words: ((words >= 3) & ((10 * symbols >= 3 * words) | (line.contains("!!") & (5 * bangs >= 3 * words)) | ~line.rlike(r"\p{L}")))
        | ((words >= 5) & (F.length(line) >= 20) & let(letters, lambda n: (n >= 20) & (10 * capitals > 7 * n)))
        | ((words >= 10) & (10 * different < 3 * words))
        | ((words <= 12) & F.lower(line).rlike(BOILERPLATE)),
    )


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a["h"] == b["h"], F.lit(False))


def repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""
    # hashes of 2, 4 and 8 words from those of half as many
    double = lambda h, n: let(h, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - n), F.slice(x, n + 1, F.size(x) - n), lambda a, b: F.xxhash64(a, b)))
    windows = double(double(double(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    places = lambda found: F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = lambda found: let(places(found), lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: _same(F.get(s, i - 1), x) | _same(F.get(s, i + 1), x)), lambda x: x["i"])))
    steps = lambda found: let(starts(found), lambda s: F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))))
    covered = let(windows, lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), F.aggregate(steps(found), F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= WINDOW, covered).otherwise(F.lit(0))


def judged(docs: DataFrame) -> DataFrame:
    """Input columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, lost_chars, kept."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost_chars", "kept"]
    names = own_names((c for c in docs.columns if c not in made), (), ("__text", "__w", "__l", *made))
    own = [F.col(f"`{c}`").alias(name) for c, name in names.items()]
    text = F.col("__text")
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    rows = docs.select(*own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("again")))
    lines = let(
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
        lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("again"), chars(x).alias("all"), chars(F.filter(x, line_fails)).alias("lost")),
    )
    rows = rows.withColumns({"__w": words, "__l": lines}).withColumns({
        "n_words": F.col("__w.n").cast("long"),
        "word_chars": (F.length(text) - count(text, BLANK)).cast("long"),
        "n_symbols": count(text, SYMBOL).cast("long"),
        "n_dup_lines": F.col("__l.again").cast("long"),
        "n_repeat_words": F.col("__w.again").cast("long"),
        "clean_text": F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~line_fails(x)), "\n"),
        "lost_chars": F.col("__l.lost").cast("long"),
    })
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("__l.all")))
    return rows.select(*(F.col(f"`{name}`").alias(c) for c, name in names.items()), *made)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    out = judged(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")


_W = r"[^\x20\x09-\x0D]+"
_FAILS = rf"""(
  (w >= 3 AND (10 * s >= 3 * w OR 5 * b >= 3 * w)) OR (w >= 3 AND l = 0) OR (w >= 5 AND length(x) >= 20 AND l >= 20 AND 10 * u > 7 * l)
  OR (w >= 10 AND 10 * d < 3 * w) OR (w <= 12 AND regexp_matches(lower(x), '{BOILERPLATE}')))"""
ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, regexp_extract_all(t, '{_W}') AS ws FROM docs),
lines AS (SELECT r, x, regexp_extract_all(x, '{_W}') AS ws FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '{_W}')),
measured AS (
  SELECT r, x, len(ws) AS w, length(x) - length(translate(x, '{SYMBOLS}', '')) AS s, length(x) - length(replace(x, '!!', '')) AS b,
    len(regexp_extract_all(x, '\p{{Lu}}')) AS u, len(regexp_extract_all(x, '\p{{L}}')) AS l, len(list_distinct(ws)) AS d
  FROM lines),
by_line AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines, sum(length(x)) AS chars, coalesce(sum(length(x)) FILTER (WHERE {_FAILS}), 0) AS lost_chars FROM measured GROUP BY r),
grams AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
by_word AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM twice, range({WINDOW}) AS v(o) GROUP BY r),
everything AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_chars, 0)::BIGINT AS lost_chars, coalesce(chars, 0) AS chars
  FROM docs d JOIN words USING (r) LEFT JOIN by_line USING (r) LEFT JOIN by_word USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  lost_chars, NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_chars <= {MOST_LOST} * chars AS kept
FROM everything
"""
