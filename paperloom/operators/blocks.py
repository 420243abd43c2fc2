"""Blocks of body text: paragraphs, tables, images, headers and footers.

Starts and ends of tables and images are window functions and joins on the
document; a fold over their few candidates picks those that do not overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import binary as bn
from paperloom.functions import text as tx
from paperloom.operators import windows as wn
from paperloom.sources import records as rc

BY = ["doc_id", "stream"]


def regions(records: DataFrame) -> DataFrame:
    """records with consumed and region: header, footer or null for the body."""
    return wn.control_regions(records.withColumn("control", bn.control_kind(F.col("payload"))), BY, ["idx"]).drop("control")


def specials(body: DataFrame) -> DataFrame:
    """Tables and images (doc_id, stream, kind, start, end) that follow one another without overlap; ends are inclusive.

    body: records of the body with pos, their ordinal. A table ends with its
    last cell, and with one empty paragraph behind.
    """
    w = Window.partitionBy(*BY).orderBy("pos")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    cell = (F.col("tag_id") == 72) & (F.col("level") == 2)
    df = wn.image_starts(wn.table_starts(body, BY, ["pos"]), BY, ["pos"])
    df = df.withColumn("cells_before", F.sum(F.when(cell, 1).otherwise(0)).over(wn.running(BY, ["pos"])))
    df = df.withColumn("cell_end", F.coalesce(F.min(F.when(cell | (F.col("level") < 2), F.col("pos"))).over(ahead), F.max("pos").over(Window.partitionBy(*BY)) + 1) - 1)
    df = df.withColumn("image_end", F.coalesce(F.min(F.when(F.col("level") < 1, F.col("pos"))).over(ahead), F.max("pos").over(Window.partitionBy(*BY)) + 1) - 1)
    df = df.withColumn("n_cells", F.coalesce(F.get(bn.u16_list(F.lead("payload").over(w)), 0), F.lit(0))).withColumn("all_cells", F.sum(F.when(cell, 1).otherwise(0)).over(Window.partitionBy(*BY)))
    df = wn.islands(df, BY, ["pos"], F.col("level") == 0, "island")
    tables = df.where("table_start").select(*BY, F.col("pos").alias("start"), F.col("cells_before").alias("before"), F.least(F.col("cells_before") + F.col("n_cells"), "all_cells").alias("ordinal"))
    ends = df.where(cell).select(*BY, F.col("cells_before").alias("ordinal"), "cell_end")
    tables = tables.join(ends, [*BY, "ordinal"], "left").select(*BY, "start", F.when(F.col("ordinal") > F.col("before"), F.col("cell_end")).otherwise(F.col("start") + 1).alias("end"))
    # The rest of the paragraph behind a table, if it is empty, goes with it.
    behind = df.select(*BY, (F.col("pos") - 1).alias("end"), F.col("pos").alias("from"), "island")
    rest = tables.join(behind, [*BY, "end"]).join(df.select(*BY, "island", "pos", "tag_id", "level", "best"), [*BY, "island"]).where(F.col("pos") >= F.col("from"))
    plain = F.bool_and(F.col("tag_id").isin(*wn.EMPTY_TAGS)) & (F.max("level") <= 1) & F.bool_and(F.col("best").isNull())
    rest = rest.groupBy(*BY, "start").agg(plain.alias("plain"), F.max("pos").alias("last"))
    tables = tables.join(rest, [*BY, "start"], "left").select(*BY, F.struct("start", F.when(F.col("plain"), F.col("last")).otherwise(F.col("end")).alias("end"), F.lit("table").alias("kind")).alias("s"))
    images = df.where("image_start").select(*BY, F.struct(F.col("pos").alias("start"), F.col("image_end").alias("end"), F.lit("image").alias("kind")).alias("s"))
    found = tables.unionByName(images).groupBy(*BY).agg(F.array_sort(F.collect_list("s")).alias("found"))
    step = lambda acc, s: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] < s["start"]), F.concat(acc, F.array(s))).otherwise(acc)
    return found.select(*BY, F.inline(F.aggregate("found", F.slice("found", 1, 0), step)))


def segmented(records: DataFrame) -> DataFrame:
    """Body records with pos, segment (specials that began so far) and special, the start of the table or image they are in."""
    body = regions(records).where("not consumed")
    body = body.withColumn("pos", (F.row_number().over(Window.partitionBy(*BY).orderBy("idx")) - 1).cast("long"))
    marks = specials(body).withColumnRenamed("start", "pos")
    df = body.join(marks, [*BY, "pos"], "left")
    so_far = wn.running(BY, ["pos"])
    df = df.withColumn("segment", F.count("kind").over(so_far)).withColumn("_last", F.last("end", ignorenulls=True).over(so_far))
    df = df.withColumn("in_special", F.coalesce(F.col("pos") <= F.col("_last"), F.lit(False)))
    return df.withColumn("special_kind", F.when(F.col("in_special"), F.last("kind", ignorenulls=True).over(so_far))).drop("kind", "end", "_last")


def tables(marked: DataFrame) -> DataFrame:
    """(doc_id, stream, segment, row_count, column_count, cells): cells of each table in row order."""
    df = marked.where("special_kind = 'table'")
    w = Window.partitionBy(*BY, "segment").orderBy("pos")
    head = df.where("tag_id = 77").groupBy(*BY, "segment").agg(F.min_by(bn.u16_list(F.col("payload")), "pos").alias("h"))
    head = head.select(*BY, "segment", F.coalesce(F.get("h", 0), F.lit(0)).alias("cell_count"), F.coalesce(F.get("h", 2), F.lit(0)).alias("row_count"), F.coalesce(F.get("h", 3), F.lit(0)).alias("column_count"))
    df = df.join(head, [*BY, "segment"])
    cell = (F.col("tag_id") == 72) & (F.col("level") == 2)
    df = df.withColumn("cell", F.sum(F.when(cell, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.max(F.when(F.col("level") < 2, F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    opened = F.max(F.when(cell, F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_in", (F.col("cell") >= 1) & (F.col("cell") <= F.col("cell_count")) & (F.coalesce(low, F.lit(-1)) < opened)).where("_in")
    said = F.when(F.col("tag_id") == 67, F.coalesce(F.nullif("direct", F.lit("")), F.get("candidates", 0)["text"]))
    cells = df.groupBy(*BY, "segment", "row_count", "column_count", "cell").agg(F.min_by("payload", "pos").alias("p"), F.min_by("idx", "pos").alias("source_record_index"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("pos", said.alias("t"))))), lambda s: s["t"]), "\n").alias("text"))
    cells = cells.select("*", bn.cell_place(bn.u16_list(F.col("p")), (F.col("cell") - 1).cast("long")).alias("at"))
    one = F.struct("at.row_index", "at.column_index", F.col("cell").alias("index"), "at.colspan", "at.rowspan", F.trim("text").alias("text"), "source_record_index")
    found = cells.where("at.row_index < row_count").groupBy(*BY, "segment").agg(F.array_sort(F.collect_list(one)).alias("cells"))
    none = F.array().cast("array<struct<row_index:bigint,column_index:bigint,index:bigint,colspan:bigint,rowspan:bigint,text:string,source_record_index:int>>")
    return head.drop("cell_count").join(found, [*BY, "segment"], "left").withColumn("cells", F.coalesce("cells", none))


def images(marked: DataFrame) -> DataFrame:
    """(doc_id, stream, segment, source_record_index, width, height, alt_text, original_filename, original_size_text, visible)."""
    df = marked.where("special_kind = 'image'").withColumn("lines", tx.metadata_lines(F.col("direct")))
    rank = F.struct(F.size("lines"), tx.count_of("direct", tx.HANGUL), F.octet_length("payload"), -F.col("pos"))
    said = F.get(F.filter(F.transform("lines", lambda x: tx.pixel_size(x)), lambda s: s.isNotNull()), 0)
    u16 = bn.u16_list(F.col("payload"))
    large = F.get(F.filter(F.transform(u16, lambda v, i: F.struct(v.alias("width"), F.get(u16, i + 1).alias("height"))), lambda s: (s["width"] > 1000) & (s["height"] > 1000)), 0)
    df = df.withColumn("size", said).withColumn("large", F.when(F.col("tag_id").isin(71, 76, 85), large))
    best = df.groupBy(*BY, "segment").agg(F.max_by(F.struct("idx", "lines", "size"), rank).alias("m"), F.min_by("large", F.when(F.col("large").isNotNull(), F.col("pos"))).alias("large"))
    lines = F.col("m.lines")
    return best.select(
        *BY, "segment", F.col("m.idx").alias("source_record_index"), F.coalesce(F.col("m.size.width").cast("long"), "large.width").alias("width"), F.coalesce(F.col("m.size.height").cast("long"), "large.height").alias("height"),
        tx.image_alt_text(lines).alias("alt_text"), tx.image_original_name(lines).alias("original_filename"), tx.image_original_size(lines).alias("original_size_text"), F.array_join(tx.image_visible_lines(lines), "\n").alias("visible"),
    )


def body_blocks(records: DataFrame, marked: DataFrame | None = None, keep: tuple = ()) -> DataFrame:
    """Blocks (doc_id, stream, block_index, block_type, text, paragraph_type, table, image) of records of any number of documents.

    marked: segmented(record_texts(records)), if it is there already; keep: segment and para, if they are to stay.
    """
    marked = segmented(rc.record_texts(records)) if marked is None else marked
    paras = rc.paragraphs(marked.where("not in_special"), (*BY, "segment"))
    kind = marked.where("in_special").groupBy(*BY, "segment").agg(F.first("special_kind").alias("k"))
    # Noise before an image, and empty paragraphs before a table: by the special that opens the next segment.
    following = kind.select(*BY, (F.col("segment") - 1).alias("segment"), F.col("k").alias("next_kind"))
    tags = marked.where("not in_special").select(*BY, "segment", "idx", "tag_id")
    exploded = paras.select(*BY, "segment", "para", F.explode("record_indices").alias("idx")).join(tags, [*BY, "segment", "idx"])
    paras = paras.join(exploded.groupBy(*BY, "segment", "para").agg(F.collect_set("tag_id").alias("tags")), [*BY, "segment", "para"]).join(following, [*BY, "segment"], "left")
    control = F.array(*[F.lit(t) for t in wn.CONTROL_TAGS])
    noise = F.coalesce(F.col("next_kind") == "image", F.lit(False)) & tx.is_noise_before_image(F.col("text_decoded"), F.col("tags"), control)
    last = F.max(F.when(F.col("text_decoded") != "", F.col("para"))).over(Window.partitionBy(*BY, "segment"))
    hollow = F.coalesce(F.col("next_kind") == "table", F.lit(False)) & (F.col("para") > F.coalesce(last, F.lit(-1)))
    paras = paras.withColumn("_drop", noise | hollow).where("not _drop")
    text = paras.select(*BY, "segment", "para", (F.col("para") + 2).alias("ord"), F.lit("paragraph").alias("block_type"), F.col("text_decoded").alias("text"), "paragraph_type", F.lit("bodytext_paragraph_records").alias("text_origin"))
    shown = images(marked)
    caption = shown.where("visible <> ''").select(*BY, "segment", F.lit(0).cast("long").alias("ord"), F.lit("paragraph").alias("block_type"), F.col("visible").alias("text"), F.lit("text_paragraph").alias("paragraph_type"), F.lit("image_control_visible_text").alias("text_origin"))
    image = shown.select(*BY, "segment", F.lit(1).cast("long").alias("ord"), F.lit("image").alias("block_type"), F.struct("width", "height", "alt_text", "original_filename", "original_size_text", "source_record_index").alias("image"))
    table = tables(marked).select(*BY, "segment", F.lit(1).cast("long").alias("ord"), F.lit("table").alias("block_type"), F.struct("row_count", "column_count", "cells").alias("table"))
    every = text.unionByName(caption, allowMissingColumns=True).unionByName(image, allowMissingColumns=True).unionByName(table, allowMissingColumns=True)
    return wn.clean_blocks(every, BY, ["segment", "ord"]).drop(*{"segment", "ord", "para"} - {*keep})


def style_tables(docinfo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraph and character styles (doc_id, style_ref, …) by the order of their records."""
    df = wn.style_index(docinfo.where("tag_id in (21, 25)"), ["doc_id"], "tag_id", ["idx"], "style_ref").withColumn("u", bn.u32_list(F.col("payload")))
    para = df.where("tag_id = 25").select("doc_id", "style_ref", bn.alignment(F.get("u", 0)).alias("alignment"), bn.list_bits(F.get("u", 7)).alias("list_info"))
    char = df.where("tag_id = 21").select("doc_id", "style_ref", F.when(F.size("u") > 11, bn.char_shape(F.get("u", 10), F.get("u", 11))).alias("shape")).select("doc_id", "style_ref", "shape.*")
    return para, char


def style_refs(records: DataFrame, by: list[str]) -> DataFrame:
    """(by…, para_ref, char_ref) of each group: of its first paragraph header and first character reference that are long enough."""
    para = F.when((F.col("tag_id") == 66) & (F.octet_length("payload") >= 12), F.col("idx"))
    char = F.when((F.col("tag_id") == 68) & (F.octet_length("payload") >= 8), F.col("idx"))
    return records.groupBy(*by).agg(F.min_by(bn.u32_at(F.col("payload"), 8).bitwiseAND(F.lit(0xFFFF)), para).alias("para_ref"), F.min_by(bn.u32_at(F.col("payload"), 4), char).alias("char_ref"))
