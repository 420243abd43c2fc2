"""Ordered operators over records and blocks, each one or two window functions.

All take the partition (``by``, a document's or stream's columns) and the order
within it, and return the frame with columns added or rows left out. Documents
are the partitions, so frames of any number of documents spread evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL_TAGS = (71, 73, 74, 75, 76, 85)
EMPTY_TAGS = (66, 68, 69)


def ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def running(by: list[str], order: list[str]):
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def islands(df: DataFrame, by: list[str], order: list[str], start: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0; a row where start holds opens one, unless it is the first."""
    flag = F.when(start & (F.row_number().over(ordered(by, order)) > 1), 1).otherwise(0)
    return df.withColumn("_start", flag).withColumn(name, F.sum("_start").over(running(by, order)).cast("long")).drop("_start")


def numbered_markers(df: DataFrame, by: list[str], order: list[str], reset: Column, keys: list[str], name: str = "marker_text") -> DataFrame:
    """Adds "n." by keys, counted anew after each row where reset holds; rows without keys get none."""
    df = df.withColumn("_segment", F.sum(F.when(reset, 1).otherwise(0)).over(running(by, order)))
    n = F.row_number().over(ordered([*by, "_segment", *keys], order))
    given = F.lit(True)
    for k in keys:
        given = given & F.col(k).isNotNull()
    return df.withColumn(name, F.when(given & ~reset, F.concat(n.cast("string"), F.lit(".")))).drop("_segment")


def style_index(df: DataFrame, by: list[str], tag: str, order: list[str], name: str = "style_index") -> DataFrame:
    """The ordinal of each record among those with its tag."""
    return df.withColumn(name, (F.row_number().over(ordered([*by, tag], order)) - 1).cast("long"))


def table_starts(df: DataFrame, by: list[str], order: list[str], name: str = "table_start") -> DataFrame:
    """A control that a table record of level 2 follows directly."""
    w = ordered(by, order)
    return df.withColumn(name, (F.col("tag_id") == 71) & F.coalesce((F.lead("tag_id").over(w) == 77) & (F.lead("level").over(w) == 2), F.lit(False)))


def image_starts(df: DataFrame, by: list[str], order: list[str], name: str = "image_start", frame: int = 12) -> DataFrame:
    """A level-1 control, no table's, with an image and a shape record among frame rows from it on; not the last two rows."""
    w = ordered(by, order)
    ahead = w.rowsBetween(Window.currentRow, frame - 1)
    seen = lambda c: F.max(F.when(c, 1).otherwise(0)).over(ahead) == 1
    table = F.coalesce((F.lead("tag_id").over(w) == 77) & (F.lead("level").over(w) == 2), F.lit(False))
    found = (F.col("tag_id") == 71) & (F.col("level") == 1) & ~table & seen((F.col("tag_id") == 76) & (F.col("level") == 2)) & seen((F.col("tag_id") == 85) & (F.col("level") >= 3))
    return df.withColumn(name, found & F.lead("tag_id", 2).over(w).isNotNull())


def control_regions(df: DataFrame, by: list[str], order: list[str], name: str = "region") -> DataFrame:
    """Names header and footer rows: those of level 2 or more behind a level-1 control with ``control``.

    The control row itself and a list record of level 2 right behind it are
    ``consumed`` without being in the region. Takes level, tag_id, control.
    """
    w = ordered(by, order)
    opens = (F.col("tag_id") == 71) & (F.col("level") == 1) & F.col("control").isin("header", "footer")
    df = df.withColumn("_opens", F.coalesce(opens, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("level") < 2, 1).otherwise(0)).over(running(by, order)))
    inside = Window.partitionBy(*by, "_island").orderBy(*order)
    df = df.withColumn("_kind", F.first(F.when(F.col("_opens"), F.col("control"))).over(inside)).withColumn("_n", F.row_number().over(inside))
    head = (F.col("_n") == 2) & (F.col("tag_id") == 72) & (F.col("level") == 2)
    return df.withColumn("consumed", F.col("_kind").isNotNull()).withColumn(name, F.when((F.col("_n") > 1) & ~head, F.col("_kind"))).drop("_opens", "_island", "_kind", "_n")


def cell_regions(df: DataFrame, by: list[str], order: list[str], cell: Column, cap: Column, name: str = "cell") -> DataFrame:
    """Numbers rows by the cell that opened before them, from 0; rows before the first cell and cells from cap on get null."""
    df = df.withColumn("_cell", F.sum(F.when(cell, 1).otherwise(0)).over(running(by, order)))
    n = F.col("_cell")
    return df.withColumn(name, F.when((n > 0) & (n <= cap), (n - 1).cast("long"))).drop("_cell")


def exclusive_hangul(df: DataFrame, by: list[str], order: list[str], hangul: str, name: str = "accepted") -> DataFrame:
    """Rejects rows without Hangul once the first row of the partition has two syllables."""
    first = F.first(hangul).over(running(by, order))
    return df.withColumn(name, ~((first >= 2) & (F.col(hangul) == 0)))


def trim_trailing(df: DataFrame, by: list[str], order: list[str], empty: Column) -> DataFrame:
    """Drops the empty rows behind a partition's last other row."""
    behind = ordered(by, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn("_keep", F.max(F.when(empty, 0).otherwise(1)).over(behind) == 1).where("_keep").drop("_keep")


def clean_blocks(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Block cleanup; takes block_type, text, text_origin and adds block_index.

    With any table or image, empty paragraphs go. With any paragraph that has
    text of its own, a paragraph of an image's control goes if the image
    follows directly. The rest is numbered anew.
    """
    whole = Window.partitionBy(*by)
    special = F.max(F.when(F.col("block_type").isin("table", "image"), 1).otherwise(0)).over(whole)
    empty = (F.col("block_type") == "paragraph") & (F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n")) == "")
    df = df.withColumn("_special", special).where(~((F.col("_special") == 1) & empty)).drop("_special")
    empty = F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n")) == ""
    control = (F.col("block_type") == "paragraph") & F.coalesce(F.col("text_origin") == "image_control_visible_text", F.lit(False))
    real = F.max(F.when((F.col("block_type") == "paragraph") & ~empty & ~control, 1).otherwise(0)).over(whole)
    follows = F.coalesce(F.lead("block_type").over(ordered(by, order)) == "image", F.lit(False))
    df = df.withColumn("_drop", (real == 1) & control & follows).where(~F.col("_drop")).drop("_drop")
    return df.withColumn("block_index", (F.row_number().over(ordered(by, order)) - 1).cast("long"))


def grid_positions(df: DataFrame, by: list[str], order: list[str], colspan: str, name: str = "column_index") -> DataFrame:
    """The grid column of each cell in its row: the spans before it."""
    return df.withColumn(name, (F.sum(colspan).over(running(by, order)) - F.col(colspan)).cast("long"))


def merged_rowspans(df: DataFrame, table: list[str], row: str, merge: Column, name: str = "rowspan") -> DataFrame:
    """Rowspans of vertical merges; takes column_index and colspan.

    A cell spans itself and the rows directly below that have a cell at its
    column, as wide, where merge is "continue". Such cells get null.
    """
    by = [*table, "column_index", "colspan"]
    w = ordered(by, [row])
    goes_on = F.coalesce(merge == "continue", F.lit(False)) & F.coalesce(F.col(row) == F.lag(row).over(w) + 1, F.lit(False))
    df = df.withColumn("_on", goes_on).withColumn("_island", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(running(by, [row])))
    n = F.count("*").over(Window.partitionBy(*by, "_island"))
    return df.withColumn(name, F.when(~F.coalesce(merge == "continue", F.lit(False)), n.cast("long"))).drop("_on", "_island")


def node_ids(df: DataFrame, by: list[str], prefix: str, order: list[str], name: str = "node_id") -> DataFrame:
    """Ids of a prefix and a count in document order."""
    return df.withColumn(name, F.concat(F.col(prefix), F.row_number().over(ordered([*by, prefix], order)).cast("string")))


def paragraph_types(records: DataFrame, by: list[str]) -> DataFrame:
    """Classifies groups of records by text, tags and levels; takes tag_id, level, text (null unless accepted)."""
    grouped = records.groupBy(*by).agg(
        F.collect_set("tag_id").alias("tags"), F.max("level").alias("top"),
        F.max(F.col("text").isNotNull()).alias("any"), F.max(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n")) != "").alias("said"),
    )
    array = lambda x: F.array(*[F.lit(t) for t in x]).cast("array<bigint>")
    tags = F.col("tags").cast("array<bigint>")
    kind = (
        F.when(F.col("said"), "text_paragraph")
        .when((F.size(F.array_except(tags, array(EMPTY_TAGS))) == 0) & (F.col("top") <= 1), "empty_paragraph")
        .when(F.col("any"), "unknown_paragraph")
        .when(F.arrays_overlap(tags, array(CONTROL_TAGS)) | (F.col("top") >= 2), "control_paragraph")
        .otherwise("unknown_paragraph")
    )
    return grouped.select(*by, kind.alias("paragraph_type"))


def joined_texts(df: DataFrame, by: list[str], order: str, text: str, name: str = "text_decoded") -> DataFrame:
    """Stripped texts of a group, each once where it came first, on lines of their own."""
    said = F.array_sort(F.collect_list(F.when(F.trim(text, F.lit(" \t\n")) != "", F.struct(order, F.trim(text, F.lit(" \t\n")).alias("t")))))
    return df.groupBy(*by).agg(F.array_join(F.array_distinct(F.transform(said, lambda s: s["t"])), "\n").alias(name))
