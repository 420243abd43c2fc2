"""Whole documents from word-processing files and style reports, and back into files.

Both ways go by joins and windows within a document: list kinds by the numbering
dictionaries, grid columns and row spans of tables, image bytes by their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import binary as bn
from paperloom.functions import text as tx
from paperloom.operators import editor as et
from paperloom.operators import lookups as lk
from paperloom.operators import windows as wn
from paperloom.operators.importing import as_block, cut, text_run
from paperloom.sources import containers as ct
from paperloom.sources import docx_writer as dw

#: What a style report holds of a paragraph.
STYLED = (
    "struct<index:int,paragraph_type:string,text_decoded:string,paragraph_style_ref:int,char_style_ref:int,paragraph_style:struct<alignment:string,style_ref:int>,"
    "list_info:struct<kind:string,level:int,numbering_ref:int,marker_text:string,raw:string>,"
    "text_runs:array<struct<text:string,kind:string,field_type:string,resolved_text:string,raw:string,char_style_ref:int,char_style:struct<bold:boolean,font_size_pt:double,style_ref:int>,"
    "character_style:struct<bold:boolean,font_size_pt:double,style_ref:int>>>>"
)
REPORT = f"source_path string, paragraphs array<{STYLED}>"
CELLS = "array<struct<row_index:int,column_index:int,colspan:int,rowspan:int,text:string>>"
IMAGE = "struct<data:binary,width:int,height:int,alt:string>"


def _ordered(*columns: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(*columns))), lambda s: s[columns[-1]])


def docx_documents(files: DataFrame) -> DataFrame:
    """Documents (doc_id, source_path, header, footer, blocks), as editor reads them, of classified word-processing files.

    Damaged files are left out; containers.docx_blocks gives their errors. A file
    without blocks is left out too. Header and footer are null where nothing in
    them shows or stands as a run.
    """
    # The files are read once, and what is in images isn't kept.
    read = ct.docx_parts(files).where("error is null").withColumn("image", F.col("image").dropFields("data"))
    read = cut(read.repartition("doc_id"))
    found = read.where("kind <> 'number'").drop("number")
    by = ["doc_id", "ord"]
    paragraphs = lk.numbering_kind(found.where("kind = 'paragraph'").drop("kind", "cells", "image"), *ct.numbering_tables(read))
    shown = F.col("text") != ""
    marker = F.when(~F.col("level_text").contains("%") & (F.col("level_text") != ""), F.col("level_text"))
    source = F.when(F.col("num_id").isNotNull(), "paragraph").when(F.col("numbering_ref").isNotNull(), "style")
    raw = F.to_json(F.struct(source.alias("source"), "style_id", "style_name", F.col("numbering_ref").alias("num_id"), F.col("abstract_id").alias("abstract_num_id"), F.col("format").alias("num_format"), F.col("level_text").alias("lvl_text")))
    numbered = F.col("numbering_ref").isNotNull()
    listed = F.when(F.col("kind").isNotNull() | numbered, F.struct(F.col("kind").alias("kind"), F.when(numbered, F.col("level")).alias("level"), "numbering_ref", marker.alias("marker_text"), raw.alias("raw")))
    style = lambda r: F.struct(r["bold"].alias("bold"), r["size"].alias("font_size_pt"), F.lit(None).cast("int").alias("style_ref"))
    paragraph = as_block(
        block_type=F.lit("paragraph"), source_path=F.col("part"), paragraph_type=F.when(shown, "text_paragraph").otherwise("empty_paragraph"), is_empty=~shown, text=F.col("text"),
        paragraph_style=F.struct("alignment", F.lit(None).cast("int").alias("style_ref")), list_info=listed, text_runs=F.transform("runs", lambda r: text_run(r["text"], style(r))),
    )
    image = as_block(
        block_type=F.lit("image"), source_path=F.col("part"), source_ref=F.concat(F.lit("rId:"), F.col("image.rel_id")), binary_stream_ref=F.concat(F.lit("word/media/"), F.col("image.name")),
        width=bn.emu_to_px(F.col("image.cx")), height=bn.emu_to_px(F.col("image.cy")), alt_text=F.col("image.alt"),
    )
    parts = paragraphs.select(*by, "region", paragraph.alias("block"))
    parts = parts.union(found.where("kind = 'image'").select(*by, "region", image.alias("block"))).union(_tables(found.where("kind = 'table'")))
    hollow = (F.col("region") != "body") & (F.col("block.block_type") == "paragraph") & F.col("block.is_empty") & (F.size("block.text_runs") == 0)
    whole = parts.where(~hollow).groupBy("doc_id").pivot("region", ["header", "footer", "body"]).agg(_ordered("ord", "block"))
    section = lambda c: F.when(F.size(c) > 0, F.struct(F.col(c).alias("blocks"))).alias(c)
    path = files.select("doc_id", F.col("path").alias("source_path")) if "path" in files.columns else files.select("doc_id", F.lit(None).cast("string").alias("source_path"))
    return whole.join(path, "doc_id").select("doc_id", "source_path", section("header"), section("footer"), F.coalesce("body", F.array().cast(f"array<{et.BLOCK}>")).alias("blocks"))


def _tables(found: DataFrame) -> DataFrame:
    """(doc_id, ord, region, block) of tables whose cells stand in rows by position; cells that continue one above are part of it."""
    by = ["doc_id", "ord"]
    cells = found.select(*by, "region", "part", F.inline("cells"))
    cells = wn.grid_positions(cells, [*by, "row"], ["position"], "colspan")
    cells = wn.merged_rowspans(cells, by, "row", F.col("merge"))
    raw = F.to_json(F.struct(F.col("colspan").alias("grid_span"), F.col("merge").alias("v_merge")))
    cell = F.struct("text", F.col("row").alias("row_index"), F.col("column_index").cast("int").alias("column_index"), "colspan", F.col("rowspan").cast("int").alias("rowspan"), F.lit(None).cast("int").alias("source_record_index"), raw.alias("raw"))
    kept = F.when(F.col("rowspan").isNotNull(), F.struct("position", cell.alias("cell")))
    rows = cells.groupBy(*by, "row").agg(F.first("region").alias("region"), F.first("part").alias("part"), F.max(F.col("column_index") + F.col("colspan")).alias("width"), F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["cell"]).alias("cells"))
    row = F.struct("row", F.struct(F.lit(None).cast("int").alias("source_index"), "cells").alias("cells"))
    held = rows.groupBy(*by).agg(F.first("region").alias("region"), F.first("part").alias("part"), F.max("width").alias("columns"), F.transform(F.array_sort(F.collect_list(row)), lambda s: s["cells"]).alias("rows"))
    # A table without any cell has no rows here.
    bare = found.where(F.size("cells") == 0).select(*by, "region", "part", F.lit(0).cast("long").alias("columns"), F.array().alias("rows"))
    block = as_block(block_type=F.lit("table"), source_path=F.col("part"), row_count=F.size("rows"), column_count=F.col("columns"), rows=F.col("rows"))
    kind = f"array<struct<source_index:int,cells:array<{et.CELL}>>>"
    every = held.withColumn("rows", F.col("rows").cast(kind)).unionByName(bare.withColumn("rows", F.col("rows").cast(kind)))
    return every.select(*by, "region", block.alias("block"))


def writer_blocks(found: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """What docx_writer.write_docx takes, of blocks (doc_id, region, ord, block).

    media: (doc_id, path, payload). An image has the bytes of its replacement, else those of
    the one file of its document whose path ends in its reference at a component; with none or several
    it has none, and the writer leaves it out. Fields show what they resolve to, or nothing.
    """
    b = F.col("block")
    said = lambda r: F.coalesce(F.when(r["kind"] == "field", r["resolved_text"]).when(F.coalesce(r["kind"], F.lit("text")) == "text", r["text"]), F.lit(""))
    run = lambda text, style: F.struct(text.alias("text"), style["bold"].alias("bold"), style["font_size_pt"].alias("size"))
    runs = F.filter(F.transform(b["text_runs"], lambda r: run(said(r), r["character_style"])), lambda r: r["text"] != "")
    alone = F.when(F.coalesce(b["text"], F.lit("")) != "", F.array(run(b["text"], F.get(b["text_runs"], 0)["character_style"])))
    span = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    cell = lambda c: F.struct(c["row_index"].alias("row_index"), c["column_index"].alias("column_index"), span(c["colspan"]).alias("colspan"), span(c["rowspan"]).alias("rowspan"), c["text"].alias("text"))
    kind = F.when(b["list_info"]["kind"] == "numbered", "numbered").when(b["list_info"]["kind"] == "bulleted", "bullet")
    alignment = b["paragraph_style"]["alignment"]
    df = found.select(
        "doc_id", "region", "ord", b["block_type"].alias("kind"), F.when(F.size(runs) > 0, runs).otherwise(alone).alias("runs"), F.when(alignment.isin("left", "center", "right", "justify"), alignment).alias("alignment"),
        kind.alias("list_kind"), b["list_info"]["level"].alias("list_level"), F.transform(F.flatten(F.transform(b["rows"], lambda r: r["cells"])), cell).cast(CELLS).alias("cells"),
        bn.data_url_bytes(F.get_json_object(b["raw"], "$.replacement_data_url")).alias("_own"), F.regexp_replace(b["binary_stream_ref"], r"^(\./)+", "").alias("_ref"), *[b[x].alias(f"_{y}") for x, y in (("width", "width"), ("height", "height"), ("alt_text", "alt"))],
    )
    if media is None:
        df = df.withColumn("payload", F.lit(None).cast("binary"))
    else:
        # By names first; bytes follow only to images that have one file.
        parts = F.split("path", "/")
        endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        named = media.select("doc_id", "path").distinct().select("doc_id", "path", F.explode(endings).alias("_ref"))
        one = named.groupBy("doc_id", "_ref").agg(F.count("*").alias("n"), F.min("path").alias("_path")).where("n = 1").drop("n")
        held = media.groupBy("doc_id", F.col("path").alias("_path")).agg(F.min("payload").alias("payload"))
        df = df.join(one, ["doc_id", "_ref"], "left").join(held, ["doc_id", "_path"], "left")
    image = F.when(F.col("kind") == "image", F.struct(F.coalesce("_own", "payload").alias("data"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.col("_alt").alias("alt"))).cast(IMAGE)
    return df.select("doc_id", "region", "ord", "kind", "runs", "alignment", "list_kind", "list_level", "cells", image.alias("image"))


def export_documents(docs: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """(doc_id, docx) of documents; see writer_blocks for media."""
    return dw.write_docx(writer_blocks(et.blocks(docs), media))


def export_tree(tree: DataFrame, original: DataFrame | None = None, media: DataFrame | None = None) -> DataFrame:
    """(doc_id, docx) of edited trees, with the header, the footer and the sources of the original documents."""
    if original is None:
        found = et.blocks_of_nodes(tree).withColumn("region", F.lit("body"))
    else:
        known = et.blocks(original)
        body = et.blocks_of_nodes(tree, known).withColumn("region", F.lit("body"))
        edges = known.where("region <> 'body'").join(tree.select("doc_id").distinct(), "doc_id", "left_semi")
        found = body.unionByName(edges)
    return dw.write_docx(writer_blocks(found, media))


def read_style_reports(spark: SparkSession, path: str) -> DataFrame:
    """Documents of style reports in JSON files, one each: the older form, which has paragraphs only."""
    return style_documents(spark.read.schema(REPORT).option("multiLine", True).json(path).withColumn("doc_id", F.col("_metadata.file_name")))


def style_documents(reports: DataFrame) -> DataFrame:
    """Documents (doc_id, source_path, header, footer, blocks) of style reports (doc_id, source_path, paragraphs).

    Without runs, a paragraph's text is its one run. References beside a style go before those in it.
    """
    def style(r):
        given = F.when(F.to_json(r["char_style"]) != "{}", r["char_style"]).otherwise(r["character_style"])
        return F.struct(given["bold"].alias("bold"), given["font_size_pt"].alias("font_size_pt"), F.coalesce(r["char_style_ref"], given["style_ref"]).alias("style_ref"))

    def run(r):
        return F.struct(F.coalesce(r["kind"], F.lit("text")).alias("kind"), F.coalesce(r["text"], F.lit("")).alias("text"), r["field_type"].alias("field_type"), r["resolved_text"].alias("resolved_text"), r["raw"].alias("raw"), style(r).alias("character_style")).cast(et.RUN)

    def block(p):
        bare = F.struct(F.lit(None).cast("boolean").alias("bold"), F.lit(None).cast("double").alias("font_size_pt"), p["char_style_ref"].alias("style_ref"))
        whole = F.when(F.coalesce(p["text_decoded"], F.lit("")) != "", F.array(text_run(p["text_decoded"], bare))).otherwise(F.array().cast(f"array<{et.RUN}>"))
        runs = F.when(F.size(p["text_runs"]) > 0, F.transform(p["text_runs"], run)).otherwise(whole)
        return as_block(
            block_type=F.lit("paragraph"), source_path=F.col("source_path"), source_index=p["index"], paragraph_type=F.coalesce(p["paragraph_type"], F.lit("unknown_paragraph")), is_empty=~F.exists(runs, lambda r: r["text"] != ""),
            text=tx.display_text(runs), paragraph_style=F.struct(p["paragraph_style"]["alignment"].alias("alignment"), F.coalesce(p["paragraph_style_ref"], p["paragraph_style"]["style_ref"]).alias("style_ref")), list_info=p["list_info"], text_runs=runs,
        )

    part = F.lit(None).cast(f"struct<blocks:array<{et.BLOCK}>>")
    blocks = F.coalesce(F.transform("paragraphs", block), F.array().cast(f"array<{et.BLOCK}>"))
    return reports.select("doc_id", "source_path", part.alias("header"), part.alias("footer"), blocks.alias("blocks"))


def record_report(records: DataFrame) -> DataFrame:
    """(doc_id, stream, json): the records of each stream, with the hex of the first 32 bytes of their payloads."""
    size = F.col("header_size").cast("long") + F.col("size")
    shown = F.struct(F.col("idx").alias("index"), "offset", "tag_id", "level", "size", "header_size", F.lower(F.hex(F.substring("payload", 1, 32))).alias("payload_preview_hex"))
    listed = F.array_sort(F.collect_list(shown))
    body = F.struct(F.col("stream").alias("source_path"), F.max(F.col("offset") + size).alias("decoded_size"), F.count("*").alias("record_count"), listed.alias("records"))
    return records.groupBy("doc_id", "stream").agg(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def paragraph_report(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, stream, json): paragraphs of each stream (records.paragraphs with paragraph_type), and the visible ones; record_indices are kept."""
    one = F.struct(F.col("para").alias("index"), "paragraph_type", "record_indices", "text_decoded")
    listed = F.array_sort(F.collect_list(one))
    text = lambda x: F.filter(x, lambda p: p["paragraph_type"] == "text_paragraph")
    df = paragraphs.groupBy("doc_id", "stream").agg(listed.alias("p"))
    seen = F.transform(text(F.col("p")), lambda p: F.struct(p["index"].alias("index"), p["paragraph_type"].alias("paragraph_type"), p["text_decoded"].alias("text_decoded")))
    body = F.struct(F.col("stream").alias("source_path"), F.size("p").alias("paragraph_count_all"), F.size(seen).alias("paragraph_count_text_only"), F.col("p").alias("paragraphs"), seen.alias("visible_text_paragraphs"))
    return df.select("doc_id", "stream", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def style_table_report(para: DataFrame, char: DataFrame) -> DataFrame:
    """(doc_id, json): both tables of blocks.style_tables, by reference."""
    def mapped(df, name, *values):
        entry = F.struct("style_ref", F.struct(*values, "style_ref").alias("style"))
        listed = F.transform(F.array_sort(F.collect_list(entry)), lambda s: F.struct(s["style_ref"].cast("string").alias("key"), s["style"].alias("value")))
        return df.groupBy("doc_id").agg(F.map_from_entries(listed).alias(name))

    both = mapped(para, "paragraph_shapes", "alignment").join(mapped(char, "character_shapes", "bold", "font_size_pt"), "doc_id", "full")
    return both.select("doc_id", F.to_json(F.struct("paragraph_shapes", "character_shapes"), {"ignoreNullFields": "false"}).alias("json"))
