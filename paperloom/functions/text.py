"""Text functions of the document model as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything str.isprintable() refuses, but for the white space that stays.
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ \n\r\t]]"
HANGUL = "[가-힣]"
ASCII_WORD = "[A-Za-z0-9]"
#: Characters outside of the meaningful ones: Hangul, ASCII letters, digits, punctuation and white space.
NOT_MEANINGFUL = r"[^가-힣\x21-\x7e \n\t]+"
PUNCTUATION = r"[!-/:-@\[-`{-~·…“”‘’]"
#: Scores are twentieths, so that they are whole numbers. A record's text counts from here on.
ACCEPTED = 120
# What lines of image metadata start with.
ORIGINAL_NAME = "원본 그림의 이름:"
ORIGINAL_SIZE = "원본 그림의 크기:"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_of(text: str | Column, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern))


def visible_lines(text: str | Column) -> Column:
    """Printable, trimmed, non-empty lines."""
    kept = F.regexp_replace(col(text), UNPRINTABLE, "")
    lines = F.transform(F.split(kept, r"\r\n|\r|\n"), lambda x: F.trim(x, F.lit(" \t")))
    return F.filter(lines, lambda x: x != "")


def strip_control_codes(text: str | Column) -> Column:
    """visible_lines joined by line feeds."""
    return F.array_join(visible_lines(text), "\n")


def segment_points(hangul: Column, ascii_: Column, size: Column) -> Column:
    bonus = F.least(size, F.lit(80))
    return F.when(hangul >= 2, hangul * 60 + ascii_ * 10 + bonus).when(ascii_ >= 4, ascii_ * 24 + bonus).otherwise(0)


def segment_score(text: Column) -> Column:
    """Twentieths: 60 a Hangul syllable and 10 an ASCII letter or digit; without two syllables 24, from four on."""
    return segment_points(count_of(text, HANGUL), count_of(text, ASCII_WORD), F.length(text))


def text_score(text: Column) -> Column:
    """segment_score with 4 for a space, 6 for punctuation and -60 for a character that isn't meaningful."""
    hangul, ascii_ = count_of(text, HANGUL), count_of(text, ASCII_WORD)
    bad = F.length(F.regexp_replace(text, r"[가-힣\x21-\x7e \n\t]+", ""))
    more = count_of(text, " ") * 4 + count_of(text, PUNCTUATION) * 6 + F.least(F.length(text), F.lit(80)) - bad * 60
    return F.when(hangul >= 2, hangul * 60 + ascii_ * 10 + more).when(ascii_ >= 4, ascii_ * 24 + more).otherwise(0)


def scored_segments(text: str | Column) -> Column:
    """Scoring segments of meaningful characters as (score, size, place, segment), negated so that the best one comes first; each is counted once."""
    parts = F.transform(F.split(strip_control_codes(text), NOT_MEANINGFUL), lambda x: F.trim(x, F.lit(" \t\n")))
    parts = F.filter(parts, lambda x: x != "")
    counted = F.transform(parts, lambda x, i: F.struct(count_of(x, HANGUL).alias("h"), count_of(x, ASCII_WORD).alias("a"), i.alias("place"), x.alias("segment")))
    scored = F.transform(counted, lambda s: F.struct((-segment_points(s["h"], s["a"], F.length(s["segment"]))).alias("score"), (-F.length(s["segment"])).alias("size"), s["place"].alias("place"), s["segment"].alias("segment")))
    return F.filter(scored, lambda s: s["score"] < 0)


def ranked_segments(text: str | Column) -> Column:
    """scored_segments, best first."""
    return F.array_sort(scored_segments(text))


def meaningful_text(text: str | Column) -> Column:
    """The best segment, the longer and then the earlier one on ties; empty without any."""
    return F.coalesce(F.array_min(scored_segments(text))["segment"], F.lit(""))


def has_artifacts(text: Column) -> Column:
    """Whether text has characters beyond Hangul, ASCII letters and plain punctuation."""
    return text.rlike(r"""[^ \n\r\t가-힣A-Za-z0-9.,:;!?\-_()/\[\]{}'"]""")


def is_noise_before_image(text: Column, tags: Column, control_tags: Column) -> Column:
    """No Hangul, and control tags or up to 32 characters without a digit."""
    short = (F.length(F.trim(text, F.lit(" \t\n"))) <= 32) & ~text.rlike("[0-9]")
    return ~text.rlike(HANGUL) & (F.arrays_overlap(tags, control_tags) | short)


def metadata_lines(text: str | Column) -> Column:
    """Lines of image metadata: without marks in front, with a letter or digit."""
    lines = F.transform(F.split(col(text), "\n"), lambda x: F.regexp_replace(F.ltrim(F.trim(x, F.lit(" \t\r")), F.lit("_")), "^[^A-Za-z0-9가-힣]+", ""))
    return F.filter(lines, lambda x: x.rlike("[A-Za-z0-9가-힣]"))


def image_alt_text(lines: Column) -> Column:
    return F.get(image_visible_lines(lines), 0)


def image_visible_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.startswith(ORIGINAL_NAME) & ~x.startswith(ORIGINAL_SIZE))


def image_original_name(lines: Column) -> Column:
    line = F.get(F.filter(lines, lambda x: x.startswith(ORIGINAL_NAME)), 0)
    return F.nullif(F.trim(F.substring(line, len(ORIGINAL_NAME) + 1, 1 << 30)), F.lit(""))


def image_original_size(lines: Column) -> Column:
    return F.get(F.filter(lines, lambda x: x.startswith(ORIGINAL_SIZE)), 0)


def pixel_size(line: Column) -> Column:
    """(width, height) that a metadata line gives, or null."""
    pattern = r"가로\s+(\d+)pixel,\s*세로\s+(\d+)pixel"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).cast("int").alias("width"), F.regexp_extract(line, pattern, 2).cast("int").alias("height")))


def display_text(runs: str | Column) -> Column:
    """Texts of runs (kind, text, resolved_text) on end; fields show what they resolve to."""
    return F.array_join(F.transform(col(runs), lambda r: F.when(r["kind"] == "field", F.coalesce(r["resolved_text"], F.lit(""))).otherwise(F.coalesce(r["text"], F.lit("")))), "")


def every_bold(children: Column) -> Column:
    """Whether there are children (bold, size) and all are bold."""
    return (F.size(children) > 0) & F.forall(children, lambda c: F.coalesce(c["bold"], F.lit(False)))


def first_size(children: Column) -> Column:
    """The first font size that a child has."""
    return F.get(F.filter(F.transform(children, lambda c: c["size"]), lambda s: s.isNotNull()), 0)


def has_mark(marks: Column, kind: str) -> Column:
    """Whether marks (type, value) has one of a type."""
    return F.exists(marks, lambda m: m["type"] == kind)


def replace_mark(marks: Column, kind: str, value: Column) -> Column:
    """marks with one of a type at the end, in place of all that it had of this type."""
    return F.array_append(F.filter(marks, lambda m: m["type"] != kind), F.struct(F.lit(kind).alias("type"), value.alias("value")))


def loads_in_browser(source: str | Column) -> Column:
    """Whether a source is a path from the root or from here, an address, or a data URL."""
    return F.coalesce(col(source).rlike(r"^(/|\./|\.\./|https?:|data:)"), F.lit(False))


def search_roots(explicit: Column, default: Column) -> Column:
    """The folders to search for images: those given explicitly instead of the default ones, each once, in order."""
    return F.array_distinct(F.when(F.size(F.coalesce(explicit, F.array().cast("array<string>"))) > 0, explicit).otherwise(default))
