"""Lookups and joins of the document pipeline.

Dimensions are small per document, but their sum grows with the corpus; so none
is broadcast by hint. Spark's adaptive planner does that where sizes allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Numbering formats that count, and those that show a mark.
NUMBERED_FORMATS = (
    "aiueo", "arabicAbjad", "arabicAlpha", "cardinalText", "chicago", "decimal", "decimalEnclosedCircle", "decimalEnclosedFullstop", "decimalEnclosedParen", "decimalFullWidth",
    "decimalFullWidth2", "decimalHalfWidth", "decimalZero", "ganada", "hebrew1", "hebrew2", "hindiConsonants", "hindiNumbers", "hindiVowels", "ideographDigital",
    "ideographEnclosedCircle", "ideographLegalTraditional", "ideographTraditional", "iroha", "irohaFullWidth", "japaneseCounting", "japaneseDigitalTenThousand", "japaneseLegal",
    "koreanCounting", "koreanDigital", "koreanDigital2", "koreanLegal", "lowerLetter", "lowerRoman", "ordinal", "ordinalText", "russianLower", "russianUpper", "taiwaneseCounting",
    "taiwaneseCountingThousand", "taiwaneseDigital", "thaiCounting", "thaiLetters", "thaiNumbers", "upperLetter", "upperRoman", "vietnameseCounting",
)
BULLETED_FORMATS = ("bullet", "picture")


def style_lookup(df: DataFrame, styles: DataFrame, on: list[str]) -> DataFrame:
    """Left join: a reference without a style keeps the row, with null attributes."""
    return df.join(styles, on, "left")


def not_consumed(df: DataFrame, consumed: DataFrame, on: list[str]) -> DataFrame:
    return df.join(consumed, on, "left_anti")


def numbering_kind(paragraphs: DataFrame, style_numbers: DataFrame, abstracts: DataFrame, formats: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Resolves list kinds: a paragraph's own number, else its style's; its abstract list; the level's format; else the style's name.

    paragraphs: doc, style_id, style_name, num_id, ilvl. Adds kind, level and numbering_ref, and what formats has beside.
    """
    df = paragraphs.join(style_numbers.withColumnsRenamed({"num_id": "_style_num", "ilvl": "_style_level"}), [doc, "style_id"], "left")
    df = df.withColumn("_num", F.coalesce("num_id", "_style_num")).withColumn("level", F.coalesce("ilvl", "_style_level", F.lit(0)))
    df = df.join(abstracts.withColumnRenamed("num_id", "_num"), [doc, "_num"], "left")
    df = df.join(formats.withColumnRenamed("ilvl", "level"), [doc, "abstract_id", "level"], "left")
    name = F.lower(F.coalesce("style_name", F.lit("")))
    by_name = F.when(name.startswith("list number"), "numbered").when(name.startswith("list bullet"), "bulleted")
    by_format = F.when(F.col("format").isin(*BULLETED_FORMATS), "bulleted").when(F.col("format").isin(*NUMBERED_FORMATS), "numbered")
    return df.withColumn("kind", F.coalesce(by_format, by_name)).withColumnRenamed("_num", "numbering_ref").drop("_style_num", "_style_level")


def ordinal_join(left: DataFrame, right: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """Joins the n-th row of each group to the other side's n-th, as template_<value>; without one they are null."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    template = right.withColumn("_n", n).select(*by, "_n", *[F.col(v).alias(f"template_{v}") for v in values])
    return left.withColumn("_n", n).join(template, [*by, "_n"], "left").drop("_n")


def first_stream(streams: DataFrame, by: str, path: str, name: str = "first_path") -> DataFrame:
    """The first path of each document without regard to case."""
    return streams.groupBy(by).agg(F.min_by(path, F.struct(F.lower(path), F.col(path))).alias(name))


def leaf(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def resolve_suffix(wanted: DataFrame, files: DataFrame, suffix: str = "suffix", path: str = "path") -> DataFrame:
    """The one file whose path ends in the suffix at a component; resolved is null with none or several, matches says how many.

    A path stands under each of its endings, which are counted before both sides
    meet by the whole suffix; names that many paths end in form no pairs.
    """
    asked = wanted.select(suffix).distinct()
    held = files.select(path).distinct().withColumn("_parts", F.split(path, "/"))
    endings = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", i, F.size("_parts")), "/"))
    held = held.select(path, F.explode(endings).alias(suffix)).groupBy(suffix).agg(F.count("*").alias("matches"), F.min(path).alias("_path"))
    found = asked.join(held, suffix, "left")
    return found.select(suffix, F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.when(F.col("matches") == 1, F.col("_path")).alias("resolved"))


def row_scaffold(tables: DataFrame, cells: DataFrame, by: list[str], row_count: str = "row_count") -> DataFrame:
    """All rows of each table, with their cells in order; rows without cells have none, cells beyond the count vanish."""
    n = F.col(row_count)
    rows = tables.where(n > 0).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("row_index"))
    held = cells.groupBy(*by, "row_index").agg(F.array_sort(F.collect_list(F.struct("column_index", "text"))).alias("cells"))
    none = F.array().cast("array<struct<column_index:bigint,text:string>>")
    return rows.join(held, [*by, "row_index"], "left").withColumn("cells", F.coalesce(F.col("cells").cast("array<struct<column_index:bigint,text:string>>"), none))
