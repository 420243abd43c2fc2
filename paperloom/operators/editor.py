"""The canonical document model as JSON and rows, and its editable tree as nodes.

Documents are rows (source_path, header, footer, blocks). Blocks become rows
with their ordinal; the tree is an adjacency list whose paths, arrays of
ordinals, are document order. Templates are joined by ordinal and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import edits as ed
from paperloom.operators import lookups as lk
from paperloom.operators import sweeps as sw
from paperloom.operators import windows as wn
from paperloom.sources.work import stored

RUN = "struct<kind:string,text:string,field_type:string,resolved_text:string,raw:string,character_style:struct<bold:boolean,font_size_pt:double,style_ref:int>>"
CELL = "struct<text:string,row_index:int,column_index:int,colspan:int,rowspan:int,source_record_index:int,raw:string>"
BLOCK = (
    f"struct<block_type:string,source_path:string,source_index:int,paragraph_type:string,is_empty:boolean,text:string,paragraph_style:struct<alignment:string,style_ref:int>,"
    f"list_info:struct<kind:string,level:int,numbering_ref:int,marker_text:string,raw:string>,text_runs:array<{RUN}>,row_count:int,column_count:int,"
    f"rows:array<struct<source_index:int,cells:array<{CELL}>>>,source_ref:string,source_record_index:int,binary_stream_ref:string,width:int,height:int,placement:string,"
    f"alt_text:string,original_filename:string,original_size_text:string,raw:string>"
)
DOCUMENT = f"source_path string, header struct<blocks:array<{BLOCK}>>, footer struct<blocks:array<{BLOCK}>>, blocks array<{BLOCK}>"
KINDS = ("paragraph", "table", "image")
PREFIXES = {"paragraph": "p", "text": "text", "table": "t", "tableRow": "tr", "tableCell": "tc", "image": "img"}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents in JSON files, one each; a value of another type than its field's is null."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("doc_id", F.col("_metadata.file_name"))


def shape_of(json: str | Column) -> Column:
    """editor for a tree, document for blocks, null otherwise."""
    return F.when((F.get_json_object(json, "$.type") == "doc") & F.get_json_object(json, "$.children").isNotNull(), "editor").when(F.get_json_object(json, "$.blocks").isNotNull(), "document")


def blocks(docs: DataFrame, regions: tuple[str, ...] = ("body", "header", "footer")) -> DataFrame:
    """(doc_id, region, ord, block) of documents; unknown block types are left out, and ordinals are of what stays."""
    held = {"body": F.col("blocks"), "header": F.col("header.blocks"), "footer": F.col("footer.blocks")}
    placed = lambda r: lambda b, k: F.struct(F.lit(r).alias("region"), k.alias("ord"), b.alias("block"))
    part = lambda r: F.transform(F.filter(held[r], lambda b: b["block_type"].isin(*KINDS)), placed(r))
    none = F.array().cast(f"array<struct<region:string,ord:int,block:{BLOCK}>>")
    return docs.select("doc_id", F.inline(F.concat(*[F.coalesce(part(r), none) for r in regions])))


def is_visible(block: Column) -> Column:
    """Paragraphs with text that count as not empty, tables with text in a cell, any image."""
    said = F.exists(F.flatten(F.transform(block["rows"], lambda r: r["cells"])), lambda c: c["text"] != "")
    text = (tx.display_text(block["text_runs"]) != "") & ~F.coalesce(block["is_empty"], F.lit(False))
    return F.coalesce(F.when(block["block_type"] == "paragraph", text).when(block["block_type"] == "table", said).otherwise(F.lit(True)), F.lit(False))


def to_json(docs: DataFrame) -> DataFrame:
    """(doc_id, json) with block_count and visible_text_blocks; nulls are written."""
    body = F.struct("source_path", "header", "footer", F.size("blocks").alias("block_count"), "blocks", F.filter("blocks", is_visible).alias("visible_text_blocks"))
    return docs.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def nodes(docs: DataFrame) -> DataFrame:
    """The tree of each document's body: doc_id, node_id, path, type, text, bold, size, align, list, level, colspan, rowspan, src, width, height, alt.

    Runs that show nothing have no node. Ids count by type in document order.
    Blocks are written as a work table: the parts of the union would else read the shuffle of docs eight times in each task.
    """
    body = stored(blocks(docs, ("body",)).select("doc_id", F.array(F.col("ord").cast("long")).alias("path"), "block"), "body")
    kind = F.col("block.list_info.kind")
    paragraph = body.where("block.block_type = 'paragraph'").select("doc_id", "path", F.lit("paragraph").alias("type"), F.coalesce("block.paragraph_style.alignment", F.lit("left")).alias("align"), F.when(kind == "numbered", "numbered").when(kind == "bulleted", "bullet").otherwise("none").alias("list"), F.col("block.list_info.level").alias("level"))
    shown = F.when(F.col("r.kind") == "field", F.col("r.resolved_text")).otherwise(F.col("r.text"))
    runs = body.select("doc_id", "path", F.posexplode("block.text_runs").alias("k", "r")).where(F.coalesce(shown, F.lit("")) != "")
    text = runs.select("doc_id", F.concat("path", F.array(F.col("k").cast("long"))).alias("path"), F.lit("text").alias("type"), shown.alias("text"), F.coalesce("r.character_style.bold", F.lit(False)).alias("bold"), F.col("r.character_style.font_size_pt").alias("size"))
    table = body.where("block.block_type = 'table'").select("doc_id", "path", F.lit("table").alias("type"))
    rows = body.select("doc_id", "path", F.posexplode("block.rows").alias("k", "row")).select("doc_id", F.concat("path", F.array(F.col("k").cast("long"))).alias("path"), "row")
    cells = rows.select("doc_id", "path", F.posexplode("row.cells").alias("k", "c")).select("doc_id", F.concat("path", F.array(F.col("k").cast("long"))).alias("path"), "c")
    zero = F.array(F.lit(0).cast("long"))
    span = lambda c: F.coalesce(F.nullif(c, F.lit(0)), F.lit(1))
    parts = [
        paragraph, text, table, rows.select("doc_id", "path", F.lit("tableRow").alias("type")),
        cells.select("doc_id", "path", F.lit("tableCell").alias("type"), span(F.col("c.colspan")).alias("colspan"), span(F.col("c.rowspan")).alias("rowspan")),
        cells.select("doc_id", F.concat("path", zero).alias("path"), F.lit("paragraph").alias("type"), F.lit("left").alias("align")),
        cells.where("c.text <> ''").select("doc_id", F.concat("path", zero, zero).alias("path"), F.lit("text").alias("type"), F.col("c.text").alias("text"), F.lit(False).alias("bold")),
        body.where("block.block_type = 'image'").select("doc_id", "path", F.lit("image").alias("type"), F.col("block.binary_stream_ref").alias("src"), F.col("block.width").alias("width"), F.col("block.height").alias("height"), F.col("block.alt_text").alias("alt")),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p, allowMissingColumns=True)
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), F.col("type"))
    return wn.node_ids(found.withColumn("prefix", prefix), ["doc_id"], "prefix", ["path"]).drop("prefix")


def blocks_of_nodes(tree: DataFrame, original: DataFrame | None = None, by_position: bool = False) -> DataFrame:
    """Body blocks (doc_id, ord, block) of a tree, with what only the original's blocks know.

    original: blocks() of the document before the edits. Blocks count anew in document order. The n-th paragraph,
    table and image take over from the n-th of their type. A cell's grid column
    comes from the spans before and above it; with by_position it is its place in the row.
    """
    tree = tree.withColumns({"at": ed.block_path(), "in": ed.inner_path()})
    depth = F.size("in")
    top = tree.where(F.col("type").isin(*KINDS) & (depth == 0)).select("doc_id", "at", "type", "align", "list", "level", "src", "width", "height", "alt")
    text = tree.where((F.col("type") == "text") & (depth == 1)).groupBy("doc_id", "at").agg(F.array_sort(F.collect_list(F.struct(F.col("in")[0].alias("k"), "text", "bold", "size"))).alias("runs"))
    said = tree.where((F.col("type") == "text") & (depth == 4)).groupBy("doc_id", "at", F.slice("in", 1, 2).alias("in")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda s: s["text"]), "").alias("said"))
    cells = tree.where("type = 'tableCell'").select("doc_id", "at", "in", F.coalesce("colspan", F.lit(1)).alias("colspan"), F.coalesce("rowspan", F.lit(1)).alias("rowspan")).join(said, ["doc_id", "at", "in"], "left")
    cells = cells.select("doc_id", "at", F.col("in")[0].alias("row"), F.col("in")[1].alias("k"), "colspan", "rowspan", F.coalesce("said", F.lit("")).alias("text"))
    if by_position:
        cells = cells.withColumn("column", F.col("k"))
    else:
        cells = sw.placed_cells(cells, ["doc_id", "at"])
    cell = F.struct("k", F.struct(F.col("text"), F.col("row").cast("int").alias("row_index"), F.col("column").cast("int").alias("column_index"), F.col("colspan").cast("int").alias("colspan"), F.col("rowspan").cast("int").alias("rowspan"), F.lit(None).cast("int").alias("source_record_index"), F.lit(None).cast("string").alias("raw")).alias("c"))
    rows = cells.groupBy("doc_id", "at", "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.sum("colspan").alias("width"))
    rows = rows.groupBy("doc_id", "at").agg(F.array_sort(F.collect_list(F.struct("row", F.transform("cells", lambda s: s["c"]).alias("cells")))).alias("rows"), F.max("width").alias("columns"))
    df = top.join(text, ["doc_id", "at"], "left").join(rows, ["doc_id", "at"], "left")
    df = df.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).drop("at")
    if original is None:
        df = df.withColumn("template_block", F.lit(None).cast(BLOCK))
    else:
        body = original.where("region = 'body'").select("doc_id", F.col("block.block_type").alias("type"), "ord", "block")
        df = lk.ordinal_join(df, body, ["doc_id", "type"], "ord", ["block"])
    t = F.col("template_block")
    runs = F.transform(F.coalesce("runs", F.array().cast("array<struct<k:bigint,text:string,bold:boolean,size:double>>")), lambda r: F.struct(F.lit("text").alias("kind"), r["text"].alias("text"), F.lit(None).cast("string").alias("field_type"), F.lit(None).cast("string").alias("resolved_text"), F.lit(None).cast("string").alias("raw"), F.struct(r["bold"].alias("bold"), r["size"].alias("font_size_pt"), F.get(t["text_runs"], 0)["character_style"]["style_ref"].alias("style_ref")).alias("character_style")))
    kind = F.when(F.col("list") == "numbered", "numbered").when(F.col("list") == "bullet", "bulleted")
    same = F.coalesce(t["list_info"]["kind"] == kind, F.lit(False))
    listed = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.coalesce("level", t["list_info"]["level"], F.lit(0)).cast("int").alias("level"), F.when(same, t["list_info"]["numbering_ref"]).alias("numbering_ref"), F.when(same, t["list_info"]["marker_text"]).alias("marker_text"), t["list_info"]["raw"].alias("raw")))
    para, table, image = (F.col("type") == k for k in KINDS)
    url = F.col("src").startswith("data:")
    told = F.array_join(F.transform(runs, lambda r: r["text"]), "")
    # A row and a cell take over from those at their place in the table that the block takes over from.
    old = lambda r: F.get(t["rows"], r["row"].cast("int"))
    cell_of = lambda r: lambda c, k: c.withField("source_record_index", F.get(old(r)["cells"], k)["source_record_index"]).withField("raw", F.get(old(r)["cells"], k)["raw"])
    row = lambda r: F.struct(old(r)["source_index"].alias("source_index"), F.transform(r["cells"], cell_of(r)).alias("cells"))
    block = F.struct(
        F.col("type").alias("block_type"), t["source_path"].alias("source_path"), t["source_index"].alias("source_index"),
        F.when(para, F.coalesce(t["paragraph_type"], F.lit("text_paragraph"))).alias("paragraph_type"), F.when(para, told == "").alias("is_empty"), F.when(para, told).alias("text"),
        F.when(para, F.struct(F.coalesce("align", F.lit("left")).alias("alignment"), t["paragraph_style"]["style_ref"].alias("style_ref"))).alias("paragraph_style"), F.when(para, listed).alias("list_info"), F.when(para, runs).alias("text_runs"),
        F.when(table, F.coalesce(t["row_count"], F.size("rows"))).alias("row_count"), F.when(table, F.coalesce(t["column_count"], F.col("columns").cast("int"))).alias("column_count"),
        F.when(table, F.transform("rows", row)).alias("rows"),
        t["source_ref"].alias("source_ref"), t["source_record_index"].alias("source_record_index"), F.when(image, F.when(F.col("src").isNotNull() & ~url, F.col("src")).otherwise(t["binary_stream_ref"])).alias("binary_stream_ref"),
        F.when(image, F.coalesce("width", t["width"])).cast("int").alias("width"), F.when(image, F.coalesce("height", t["height"])).cast("int").alias("height"), t["placement"].alias("placement"), F.when(image, F.coalesce("alt", t["alt_text"])).alias("alt_text"),
        t["original_filename"].alias("original_filename"), t["original_size_text"].alias("original_size_text"), F.when(image & url, F.to_json(F.struct(F.col("src").alias("replacement_data_url")))).otherwise(t["raw"]).alias("raw"),
    )
    return df.select("doc_id", F.col("ord").cast("int").alias("ord"), block.alias("block"))


def image_warnings(found: DataFrame) -> DataFrame:
    """(doc_id, ord, reason) of images that have neither bytes of their own nor a path."""
    bare = F.col("block.binary_stream_ref").isNull() & ~F.coalesce(F.col("block.raw").contains("replacement_data_url"), F.lit(False))
    return found.where((F.col("block.block_type") == "image") & bare).select("doc_id", "ord", F.lit("image without source").alias("reason"))
