"""Running counts for documents of any size: by blocks of rows, then by what the blocks before hold.

The functions of ``windows`` take a document into one task. These give the same
columns for a document with more rows than a task can sort: rows are split into
blocks by range, counted within their block, and what a document's earlier
blocks hold is added from a table with one row per block. All of them start from
``blocked``, whose table can serve several. Null keys are keys like others, and
an empty table stays empty. Rows that tie in the order land in one block and are
counted in any order there, as by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.work import stored


def _named(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def blocked(df: DataFrame, by: list[str], order: list[str], rows: int = 1_000_000) -> DataFrame:
    """df as a work table with _block: consecutive rows of a document, about ``rows`` of them, in one block or in several documents' one.

    Spark samples the ends of the blocks (some hundred keys of each on the driver). They
    are fixed by writing the rows, so that counts and offsets mean the same blocks.
    """
    n = max(1, -(-df.count() // rows))
    return stored(df.repartitionByRange(n, *_named([*by, *order])).withColumn("_block", F.spark_partition_id()), "blocks")


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """With _key, one struct, so that null keys join and one shuffle serves the window and the join."""
    return df.withColumn("_key", F.struct(*_named([*keys, "_block"])))


def _blocks_of(keys: list[str]):
    return Window.partitionBy(*[F.col("_key")[k] for k in keys]).orderBy(F.col("_key")["_block"])


def _inside(order: list[str]):
    return Window.partitionBy("_key").orderBy(*_named(order))


def _with_offsets(df: DataFrame, offsets: DataFrame, name: str) -> DataFrame:
    return df.join(offsets, "_key", "left").withColumn(name, (F.col(f"`{name}`") + F.coalesce("_offset", F.lit(0))).cast("long")).drop("_key", "_offset")


def row_numbers(df: DataFrame, by: list[str], order: list[str], keys: list[str], name: str) -> DataFrame:
    """Adds the count of rows of blocked df with the same keys in the document so far."""
    df = _keyed(df, [*by, *keys])
    before = _blocks_of([*by, *keys]).rowsBetween(Window.unboundedPreceding, -1)
    held = df.groupBy("_key").agg(F.count("*").alias("_n")).select("_key", F.sum("_n").over(before).alias("_offset"))
    return _with_offsets(df.withColumn(name, F.row_number().over(_inside(order))), held.where("_offset > 0"), name)


def running_sums(df: DataFrame, by: list[str], order: list[str], flag: Column, name: str, first: bool = True) -> DataFrame:
    """Adds how often flag held in the document so far; without first, that of its first row doesn't count."""
    df = _keyed(df, by).withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long"))
    w = _blocks_of(by)
    held = df.groupBy("_key").agg(F.sum("_flag").alias("_n"), F.min_by("_flag", F.struct(*_named(order))).alias("_first"))
    offset = F.sum("_n").over(w) - F.col("_n")
    held = held.select("_key", (offset if first else offset - F.first("_first").over(w)).alias("_offset"))
    so_far = F.sum("_flag").over(_inside(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _with_offsets(df.withColumn(name, so_far), held.where("_offset <> 0"), name).drop("_flag")


def islands(df: DataFrame, by: list[str], order: list[str], start: Column, name: str = "island") -> DataFrame:
    """windows.islands on blocked rows."""
    return running_sums(df, by, order, start, name, first=False)


def numbered_markers(df: DataFrame, by: list[str], order: list[str], reset: Column, keys: list[str], name: str = "marker_text") -> DataFrame:
    """windows.numbered_markers on blocked rows."""
    df = row_numbers(running_sums(df.withColumn("_reset", reset), by, order, F.col("_reset"), "_segment"), by, order, ["_segment", *keys], "_n")
    given = ~F.col("_reset")
    for k in _named(keys):
        given = given & k.isNotNull()
    return df.withColumn(name, F.when(given, F.concat(F.col("_n").cast("string"), F.lit(".")))).drop("_reset", "_segment", "_n")


def node_ids(df: DataFrame, by: list[str], prefix: str, order: list[str], name: str = "node_id") -> DataFrame:
    """windows.node_ids on blocked rows."""
    df = row_numbers(df, by, order, [prefix], "_n")
    return df.withColumn(name, F.concat(F.col(f"`{prefix}`"), F.col("_n").cast("string"))).drop("_n")
