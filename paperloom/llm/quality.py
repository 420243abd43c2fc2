"""Quality rules, line first: drop bad lines, then documents that lose too much.

All of it is DataFrame expressions over one row at a time: no shuffle, no
Python. The only per-text arrays are its lines, words and five-word windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A document goes when more than this share of its word characters goes.
MAX_LOST_PERCENT = 50
MIN_LINE_WORDS = 3
# Phrases that mark a line of up to BOILERPLATE_WORDS words as boilerplate.
BOILERPLATE = ("accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "sign in", "subscribe to our newsletter", "terms of service", "terms of use")
BOILERPLATE_WORDS = 12
SYMBOLS = "#*$%&|<>"
LINE_END = r"[.!?:;\x{2026}\x{3002}][\"')\]\x{00BB}\x{201D}\x{2019}]*$"
SEPARATORS = "|\u00bb\u203a\u2022\u00b7\u2192"
SPACES = " \t\n\x0b\x0c\r"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def number_of(text: Column, characters: str) -> Column:
    """How many of its characters are among these; no regular expression runs over them."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; a line without a word never does.

    Punctuation: no ending mark and under three words. Navigation: two or more
    separators, and one to four words or fewer. Symbols: over a tenth of the
    characters. Shouting: doubled exclamation marks after a third of the words.
    Boilerplate: a short line with a fixed phrase.
    """
    words = count_of(line, WORD)
    bars = number_of(line, SEPARATORS)
    phrases = "(?i)" + "|".join(BOILERPLATE)
    return (words > 0) & (
        ((words < MIN_LINE_WORDS) & ~F.trim(line).rlike(LINE_END))
        | ((bars >= 2) & (bars * 4 >= words))
        | (number_of(line, SYMBOLS) * 10 > F.length(line))
        | (line.contains("!!") & (count_of(line, "!!+") * 3 > words))
        | ((words <= BOILERPLATE_WORDS) & line.rlike(phrases))
    )


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts, verdict and cleaned text as the column ``quality``.

    quality: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_bad_lines, lost_chars (long), base_failed, kept (boolean),
    cleaned_text (all lines that don't fail, those without a word too). A null text
    counts as empty, and so has no words and fails. Other columns stay as they are,
    but one named quality is replaced; repeated rows stay too. Texts are judged whole
    however long, windows are compared by 64-bit hashes within one text.
    """
    spare = [c for c in docs.columns]
    staged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in spare]).alias("row"),
        text_of(F.col(f"`{text}`")).alias("t"),
    )
    staged = staged.select("row", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("w") - WINDOW),
        lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]),
    )
    staged = staged.select("*", F.when(F.size("w") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("h"), F.filter(F.split("t", "\n"), lambda x: ~line_fails(x)).alias("good"))
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    ranked = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    staged = staged.select("*", F.when(repeated, ranked).alias("r"))
    staged = staged.select("*", F.sort_array(F.filter(
        F.transform("r", lambda s, k: F.when((s["x"] == F.get("r", k - 1)["x"]) | (s["x"] == F.get("r", k + 1)["x"]), s["i"])),
        lambda i: i.isNotNull(),
    )).alias("p"))
    covered = F.aggregate(F.transform("p", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    chars = F.length(F.translate("t", SPACES, ""))
    kept_chars = F.aggregate("good", F.lit(0), lambda a, x: a + F.length(F.translate(x, SPACES, "")))
    staged = staged.select(
        "row", "good",
        F.size("w").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        number_of(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size(F.split("t", "\n")) - F.size("good")).cast("long").alias("n_bad_lines"),
        (chars - kept_chars).cast("long").alias("lost_chars"),
        # Not deterministic, so that no filter on the result moves below and computes the arrays anew for each element.
        F.monotonically_increasing_id().alias("fence"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    staged = staged.select("*", failed.alias("base_failed"))
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars"))
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "lost_chars", "base_failed")
    others = [F.col("row")[c].alias(c) for c in spare if c != "quality"]
    result = F.struct(*made, kept.alias("kept"), F.array_join("good", "\n").alias("cleaned_text"))
    return staged.select(*others, F.when(F.col("fence") >= 0, result).alias("quality"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM a))),
p AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS c FROM g WHERE n > 1),
r AS (SELECT rid, sum(c) AS n_repeat_words FROM p GROUP BY rid),
l AS (SELECT rid, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(x, '[|\x{00BB}\x{203A}\x{2022}\x{00B7}\x{2192}]')) AS bars FROM (SELECT rid, unnest(lines) AS x FROM a)),
v AS (SELECT rid, length(x) - len(regexp_extract_all(x, '[\x20\x09-\x0D]')) AS chars,
  (words < 3 AND NOT regexp_matches(trim(x, ' '), '[.!?:;\x{2026}\x{3002}]["'')\]\x{00BB}\x{201D}\x{2019}]*$')) OR (bars >= 2 AND bars * 4 >= words)
  OR len(regexp_extract_all(x, '[#*$%&|<>]')) * 10 > length(x) OR len(regexp_extract_all(x, '!!+')) * 3 > words
  OR (words <= 12 AND regexp_matches(x, '(?i)accept cookies|all rights reserved|back to top|click here|cookie policy|enable javascript|lorem ipsum|privacy policy|sign in|subscribe to our newsletter|terms of service|terms of use')) AS bad FROM l),
s AS (SELECT rid, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost, count_if(bad) AS n_bad FROM v GROUP BY rid),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_bad, 0) AS BIGINT) AS n_bad_lines,
  CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM a LEFT JOIN r USING (rid) LEFT JOIN s USING (rid))
SELECT *, base_failed_ AS base_failed, NOT base_failed_ AND 100 * lost_chars <= 50 * word_chars AS kept FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed_ FROM f)
""".replace("SELECT *, base_failed_ AS base_failed", "SELECT * EXCLUDE (base_failed_), base_failed_ AS base_failed")
