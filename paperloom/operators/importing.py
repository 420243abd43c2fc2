"""From the streams of compound files to whole documents: styles, lists, headers, footers and blocks joined.

Streams are opened by their file's header; records get styles by joins with the
style tables of their document, list markers by a running count, and header and
footer runs by an ordered aggregate. Only the text of a payload needs Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import binary as bn
from paperloom.operators import blocks as bl
from paperloom.operators import lookups as lk
from paperloom.operators import windows as wn
from paperloom.operators.editor import BLOCK, RUN
from paperloom.sources import records as rc
from paperloom.sources.work import stored

BY = bl.BY
#: Bytes of a file header at least, and those of a whole one.
HEADER_LEAST = 40
HEADER_WHOLE = 256


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a work table, as what follows reads it several times."""
    return stored(df)


def opened(streams: DataFrame) -> DataFrame:
    """(doc_id, stream, payload, warning, error) of DocInfo and body streams (doc_id, path, payload), inflated where the file's header says so.

    A file without a header, or with one of under 40 bytes, gives one row with an error;
    a header of under 256 bytes is a warning. A stream of damaged deflate data has an error and no payload.
    """
    head = streams.where("path = 'FileHeader'").groupBy("doc_id").agg(F.first("payload").alias("head"))
    size = F.coalesce(F.octet_length("head"), F.lit(0))
    df = streams.where("path = 'DocInfo' or path like 'BodyText/Section%'").join(head, "doc_id", "left")
    bad = df.where(size < HEADER_LEAST).groupBy("doc_id").agg(F.first("head").alias("head")).select("doc_id", F.when(F.col("head").isNull(), "no file header").otherwise("file header under 40 bytes").alias("error"))
    good = df.where(size >= HEADER_LEAST).withColumn("packed", bn.file_header(F.col("head"))["is_compressed"])
    warning = F.when(size < HEADER_WHOLE, "file header under 256 bytes").alias("warning")
    # A Python function runs for all rows, so those that aren't packed give it null.
    good = good.withColumn("opened", rc.opened(F.when(F.col("packed"), F.col("payload"))))
    payload = F.when(F.col("packed"), F.col("opened.data")).otherwise(F.col("payload")).alias("payload")
    return good.select("doc_id", F.col("path").alias("stream"), payload, warning, F.col("opened.error").alias("error")).unionByName(bad, allowMissingColumns=True)


def import_errors(streams: DataFrame) -> DataFrame:
    """(doc_id, stream, error) of what opened() can't open; import_documents leaves these files out and imports the others."""
    return opened(streams).where("error is not null").select("doc_id", "stream", "error")


def embedded_images(streams: DataFrame) -> DataFrame:
    """(doc_id, path, data) of the binary streams that are images as they are or, if not, once inflated."""
    found = streams.where("path like 'BinData/%'")
    plain = bn.is_image(F.col("payload"))
    found = found.withColumn("data", F.when(plain, F.col("payload")).otherwise(rc.try_inflate(F.when(~plain, F.col("payload")))))
    return found.where(bn.is_image(F.col("data"))).select("doc_id", "path", "data")


def paragraph_styles(records: DataFrame, docinfo: DataFrame, by: list[str]) -> DataFrame:
    """(by…, para, para_ref, char_ref, alignment, bold, font_size_pt, numbering_ref, level, marker_text) of each paragraph.

    by begins with doc_id. A reference that the document's tables lack stays, with null attributes.
    Markers count by list and level, anew for each group of by.
    """
    para_styles, char_styles = bl.style_tables(docinfo)
    grouped = wn.islands(records, by, ["idx"], F.col("level") == 0, "para")
    refs = bl.style_refs(grouped, [*by, "para"])
    df = lk.style_lookup(refs, para_styles.withColumnRenamed("style_ref", "para_ref"), ["doc_id", "para_ref"])
    df = lk.style_lookup(df, char_styles.withColumnRenamed("style_ref", "char_ref"), ["doc_id", "char_ref"])
    df = df.select(*by, "para", "para_ref", "char_ref", "alignment", "bold", "font_size_pt", "list_info.numbering_ref", "list_info.level")
    return wn.numbered_markers(df, by, ["para"], F.lit(False), ["numbering_ref", "level"])


def style(df: DataFrame) -> DataFrame:
    """df of paragraph_styles with the structs character_style, paragraph_style and list_info of a block."""
    listed = F.struct(F.lit("numbered").alias("kind"), F.col("level").cast("int").alias("level"), F.col("numbering_ref").cast("int").alias("numbering_ref"), "marker_text", F.lit(None).cast("string").alias("raw"))
    return df.withColumns({
        "character_style": F.struct("bold", F.col("font_size_pt").cast("double").alias("font_size_pt"), F.col("char_ref").cast("int").alias("style_ref")),
        "paragraph_style": F.struct("alignment", F.col("para_ref").cast("int").alias("style_ref")),
        "list_info": F.when(F.col("numbering_ref").isNotNull(), listed),
    })


def text_run(text, character_style):
    return F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("field_type"), F.lit(None).cast("string").alias("resolved_text"), F.lit(None).cast("string").alias("raw"), character_style.alias("character_style")).cast(RUN)


def region_paragraphs(told: DataFrame, docinfo: DataFrame) -> DataFrame:
    """(doc_id, stream, region, para, text, text_runs, paragraph_style) of the header and footer that count: the last of each kind that has records.

    told: record_texts of all records. Runs are the texts of text records, and page-number fields; a text gets back the
    space at its end, if its payload has one, where a field follows or stands before.
    """
    df = bl.regions(told)
    occurrence = F.sum(F.when(F.col("consumed") & (F.col("tag_id") == 71) & (F.col("level") == 1), 1).otherwise(0)).over(wn.running(BY, ["idx"]))
    df = df.withColumn("occurrence", occurrence).where(F.col("region").isNotNull())
    last = F.max("occurrence").over(Window.partitionBy(*BY, "region"))
    df = df.withColumn("_last", last).where("occurrence = _last").drop("_last", "consumed")
    by = [*BY, "region"]
    styles = style(paragraph_styles(df, docinfo, by))
    df = wn.islands(df, by, ["idx"], F.col("level") == 0, "para")
    field = (F.col("tag_id") == 71) & (F.col("level") >= 3)
    has_field = F.max(F.when(field, 1).otherwise(0)).over(Window.partitionBy(*by, "para")) == 1
    spaced = has_field & F.expr("contains(payload, X'2000')") & ~F.col("said").endswith(" ")
    text = F.when(spaced, F.concat("said", F.lit(" "))).otherwise(F.col("said"))
    df = df.join(styles.select(*by, "para", "character_style", "paragraph_style"), [*by, "para"], "left")
    number = F.when(field & (F.substring("payload", 1, 4) == F.lit(b"onta")), F.struct(F.lit("field").alias("kind"), F.lit("").alias("text"), F.lit("page_number").alias("field_type"), bn.page_number(F.col("payload")).cast("string").alias("resolved_text"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("struct<bold:boolean,font_size_pt:double,style_ref:int>").alias("character_style")).cast(RUN))
    run = F.when((F.col("tag_id") == 67) & (F.col("said") != ""), text_run(text, F.col("character_style"))).otherwise(number)
    found = df.select(*by, "para", "idx", run.alias("run"), "paragraph_style").groupBy(*by, "para").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("run").isNotNull(), F.struct("idx", "run")))), lambda s: s["run"]).alias("text_runs"), F.first("paragraph_style").alias("paragraph_style"),
    )
    shown = F.array_join(F.transform("text_runs", lambda r: F.coalesce(F.when(r["kind"] == "field", r["resolved_text"]).otherwise(r["text"]), F.lit(""))), "")
    decoded = rc.paragraphs(bl.regions(told).where(F.col("region").isNotNull()), tuple(by)).select(*by, "para", "text_decoded")
    return found.join(decoded, [*by, "para"], "left").select(*by, "para", F.when(shown != "", shown).otherwise(F.coalesce("text_decoded", F.lit(""))).alias("text"), "text_runs", "paragraph_style")


def as_block(**known):
    """A BLOCK with the named fields; all others are null."""
    names = [f.split(":")[0] for f in ("block_type source_path source_index paragraph_type is_empty text paragraph_style list_info text_runs row_count column_count rows source_ref source_record_index "
                                       "binary_stream_ref width height placement alt_text original_filename original_size_text raw").split()]  # fmt: skip
    return F.struct(*[known.get(n, F.lit(None)).alias(n) for n in names]).cast(BLOCK)


def import_documents(streams: DataFrame) -> DataFrame:
    """Documents (doc_id, source_path, header, footer, blocks), as editor reads them, of streams (doc_id, path, payload) of compound files.

    Files with a missing or short header or a damaged stream are left out; import_errors() tells which.
    """
    told = cut(opened(streams))
    ready = told.where("error is null").join(told.where("error is not null").select("doc_id").distinct(), "doc_id", "left_anti")
    records = cut(rc.split_records(ready))
    docinfo, body = records.where("stream = 'DocInfo'"), records.where("stream <> 'DocInfo'")
    told = cut(rc.record_texts(body))
    marked = cut(bl.segmented(told))
    styles = style(paragraph_styles(marked.where("not in_special"), docinfo, [*BY, "segment"]))
    plain = cut(bl.body_blocks(told, marked, keep=("segment", "para")))
    found = plain.join(styles.select(*BY, "segment", "para", "character_style", "paragraph_style", "list_info"), [*BY, "segment", "para"], "left")
    paragraph = F.col("block_type") == "paragraph"
    runs = F.when(F.col("text") != "", F.array(text_run(F.col("text"), F.col("character_style")))).otherwise(F.array().cast(f"array<{RUN}>"))
    cell = lambda c: F.struct(c["text"].alias("text"), c["row_index"].alias("row_index"), c["column_index"].alias("column_index"), c["colspan"].alias("colspan"), c["rowspan"].alias("rowspan"), c["source_record_index"].alias("source_record_index"), F.lit(None).cast("string").alias("raw"))
    rows = F.when(F.col("table.row_count") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("table.row_count") - 1), lambda r: F.struct(F.lit(None).cast("int").alias("source_index"), F.transform(F.filter("table.cells", lambda c: c["row_index"] == r), cell).alias("cells"))))
    block = as_block(
        block_type=F.col("block_type"), source_path=F.col("stream"), paragraph_type=F.col("paragraph_type"), is_empty=F.when(paragraph, F.col("text") == ""), text=F.when(paragraph, F.col("text")), paragraph_style=F.when(paragraph, F.col("paragraph_style")),
        list_info=F.col("list_info"), text_runs=F.when(paragraph, runs), row_count=F.col("table.row_count"), column_count=F.col("table.column_count"), rows=rows, source_record_index=F.col("image.source_record_index"), width=F.col("image.width"), height=F.col("image.height"),
        alt_text=F.col("image.alt_text"), original_filename=F.col("image.original_filename"), original_size_text=F.col("image.original_size_text"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("stream", "block_index", block.alias("block")))), lambda s: s["block"])
    docs = found.groupBy("doc_id").agg(ordered.alias("blocks"))
    part = region_paragraphs(told, docinfo).withColumn("block", as_block(block_type=F.lit("paragraph"), source_path=F.concat("stream", F.lit("/"), F.initcap("region")), paragraph_type=F.lit("text_paragraph"), is_empty=F.col("text") == "", text=F.col("text"), paragraph_style=F.col("paragraph_style"), text_runs=F.col("text_runs")))
    part = part.groupBy("doc_id", "region").agg(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("stream", "para", "block"))), lambda s: s["block"]).alias("blocks")).alias("part"))
    side = lambda region: part.where(F.col("region") == region).select("doc_id", F.col("part").alias(region))
    return docs.join(side("header"), "doc_id", "left").join(side("footer"), "doc_id", "left").select("doc_id", F.lit(None).cast("string").alias("source_path"), "header", "footer", "blocks")


def dump_summary(streams: DataFrame) -> DataFrame:
    """(doc_id, json): the streams of each file (doc_id, path, payload) with size and digest, in order without regard to case."""
    one = streams.select("doc_id", F.struct(F.lower("path").alias("k"), F.col("path").alias("path"), bn.stream_metadata(F.col("payload")).alias("m")).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s["path"].alias("path"), s["m"]["size"].alias("size"), s["m"]["sha256"].alias("sha256")))
    return one.groupBy("doc_id").agg(F.to_json(F.struct(F.count("*").alias("stream_count"), listed.alias("streams"))).alias("json"))
