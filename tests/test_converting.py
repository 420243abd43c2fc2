"""Files to documents and back, with lists, tables, images, headers and fields; style reports."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from paperloom.operators import converting, editor, edits
from paperloom.sources import containers, docx_writer
from tests.test_containers import PNG, blocks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = (
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="4"/></w:numPr></w:pPr><w:r><w:t>own</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:pStyle w:val="S"/></w:pPr><w:r><w:t>styled</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="L"/></w:pPr><w:r><w:t>named</w:t></w:r></w:p>'
    '<w:p/><w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>'
    '<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:tbl/>'
)
STYLES = '<w:style w:styleId="S"><w:name w:val="Own"/><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:style><w:style w:styleId="L"><w:name w:val="List Bullet 2"/></w:style>'
NUMBERS = (
    '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="-"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl/></w:abstractNum>'
    '<w:num w:numId="4"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num><w:num/>'
)


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", text)
    return bytearray(out.getvalue())


def numbered_file(numbers=f"<w:numbering {W}>{NUMBERS}</w:numbering>"):
    return packed(document=f"<w:document {W}><w:body>{BODY}</w:body></w:document>", styles=f"<w:styles {W}>{STYLES}</w:styles>", numbering=numbers)


def test_lists_and_tables_of_a_file(spark):
    files = spark.createDataFrame([("a", "/x/a.docx", "docx", numbered_file()), ("b", "/x/b.docx", "docx", numbered_file("<cut")), ("c", "/x/c.docx", "docx", bytearray(b"PK"))], "doc_id string, path string, kind string, content binary")
    docs = converting.docx_documents(files).collect()
    assert [(d.doc_id, d.source_path, d.header, d.footer) for d in docs] == [("a", "/x/a.docx", None, None)]
    assert sorted(r.doc_id for r in containers.docx_blocks(files).where("error is not null").collect()) == ["b", "c"]
    own, styled, named, empty, table, bare = docs[0].blocks
    listed = [(x.list_info.kind, x.list_info.level, x.list_info.numbering_ref, x.list_info.marker_text) for x in (own, styled, named)]
    assert listed == [("numbered", 1, 4, None), ("bulleted", 0, 5, "-"), ("bulleted", None, None, None)]
    assert [json.loads(x.list_info.raw).get("source") for x in (own, styled, named)] == ["paragraph", "style", None]
    assert (empty.paragraph_type, empty.is_empty, empty.list_info) == ("empty_paragraph", True, None)
    assert (table.row_count, table.column_count) == (2, 3)
    cells = [[(c.text, c.row_index, c.column_index, c.colspan, c.rowspan) for c in r.cells] for r in table.rows]
    assert cells == [[("a", 0, 0, 1, 2), ("b", 0, 1, 1, 1)], [("c", 1, 1, 2, 1)]]
    assert (bare.block_type, bare.row_count, bare.rows) == ("table", 0, [])
    assert converting.docx_documents(files.where("false")).count() == 0


def test_edited_documents_keep_header_and_images(spark):
    files = docx_writer.write_docx(blocks(spark)).select("doc_id", F.lit("docx").alias("kind"), F.col("docx").alias("content"))
    docs, media = converting.docx_documents(files), containers.docx_media(files)
    assert [(r.path, bytes(r.payload)) for r in media.collect()] == [("word/media/image1.png", PNG)]
    tree = editor.nodes(docs)
    log = spark.createDataFrame([("d", 1, "align", "p1", "right"), ("d", 2, "text", "text3", "two")], "doc_id string, seq long, op string, node_id string, value string")
    again = converting.export_tree(edits.apply_edits(tree, log), docs, media).select("doc_id", F.lit("docx").alias("kind"), F.col("docx").alias("content"))
    found = containers.docx_blocks(again).orderBy("region", "ord").collect()
    body = [r for r in found if r.region == "body"]
    assert [(r.kind, r.text) for r in body[:2]] == [("paragraph", "Title & more"), ("paragraph", "two")]
    assert (body[0].alignment, body[1].style_name) == ("right", "List Number")
    assert [(c.text, c.row) for c in body[2].cells if c.merge != "continue" and c.text] == [("a", 0), ("b", 1), ("c", 1), ("d\ne", 2)]
    assert (bytes(body[3].image.data), body[3].image.alt) == (PNG, "a <dot>")
    assert [r.text for r in found if r.region == "header"] == ["Head"]


def test_what_the_writer_gets(spark):
    run = {"kind": "field", "resolved_text": "7", "text": "#"}
    doc = {"header": {"blocks": [{"block_type": "paragraph", "text_runs": [run, {"kind": "field"}, {"kind": "other", "text": "no"}]}]}, "blocks": [
        {"block_type": "paragraph", "text": "alone", "text_runs": [{"kind": "field", "character_style": {"bold": True}}], "paragraph_style": {"alignment": "odd"}},
        {"block_type": "image", "binary_stream_ref": "./m/a.png"}, {"block_type": "image", "binary_stream_ref": "twice.png"}, {"block_type": "image"},
        {"block_type": "image", "binary_stream_ref": "twice.png", "raw": json.dumps({"replacement_data_url": "data:image/png;base64,b3du"})}, {"block_type": "chart"},
    ]}
    docs = spark.createDataFrame([("d", json.dumps(doc)), ("e", "{}")], "doc_id string, json string").select("doc_id", F.inline(F.array(F.from_json("json", editor.DOCUMENT))))
    media = spark.createDataFrame([("d", "x/m/a.png", bytearray(b"one")), ("d", "x/m/a.png", bytearray(b"one")), ("d", "x/twice.png", bytearray(b"2")), ("d", "y/twice.png", bytearray(b"3")), ("e", "m/a.png", bytearray(b"other")), ("d", "x/nom/a.png", None)], "doc_id string, path string, payload binary")
    rows = converting.writer_blocks(editor.blocks(docs), media).orderBy("region", "ord").collect()
    assert [r.image and r.image.data and bytes(r.image.data) for r in rows] == [None, b"one", None, None, b"own", None]
    assert [[(x.text, x.bold) for x in r.runs] for r in rows if r.kind == "paragraph"] == [[("alone", True)], [("7", None)]]
    assert rows[0].alignment is None


def test_style_reports(spark, tmp_path):
    style = {"bold": True, "font_size_pt": 9.0, "style_ref": 4}
    paragraphs = [
        {"index": 0, "paragraph_type": "text_paragraph", "text_decoded": "x", "paragraph_style_ref": 2, "paragraph_style": {"alignment": "left", "style_ref": 1}, "text_runs": [{"text": "run", "char_style": style, "char_style_ref": 3}, {"text": "", "character_style": style}]},
        {"index": 1, "text_decoded": "whole", "char_style_ref": 6, "text_runs": [], "list_info": {"kind": "numbered", "level": 1}}, {"index": "odd"},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"source_path": "s", "paragraphs": paragraphs}))
    (tmp_path / "b.json").write_text("{}")
    docs = {d.doc_id: d for d in converting.read_style_reports(spark, str(tmp_path)).collect()}
    one, two, three = docs["a.json"].blocks
    assert (one.text, one.paragraph_style.style_ref, [r.character_style.style_ref for r in one.text_runs], one.text_runs[0].character_style.bold) == ("run", 2, [3, 4], True)
    assert (two.text, two.text_runs[0].character_style.style_ref, two.list_info.level, two.paragraph_type, two.source_path) == ("whole", 6, 1, "unknown_paragraph", "s")
    assert (three.is_empty, three.text_runs, three.source_index) == (True, [], None)
    assert docs["b.json"].blocks == []


def test_reports(spark):
    para = spark.createDataFrame([("d", 0, "left"), ("d", 1, None)], "doc_id string, style_ref long, alignment string")
    char = spark.createDataFrame([("d", 0, True, 10.0), ("e", 0, None, None)], "doc_id string, style_ref long, bold boolean, font_size_pt double")
    found = {r.doc_id: json.loads(r.json) for r in converting.style_table_report(para, char).collect()}
    assert found["d"]["paragraph_shapes"] == {"0": {"alignment": "left", "style_ref": 0}, "1": {"alignment": None, "style_ref": 1}}
    assert found["e"]["paragraph_shapes"] is None and found["e"]["character_shapes"]["0"]["bold"] is None
    rows = [("d", "s", 1, "empty_paragraph", [1], ""), ("d", "s", 0, "text_paragraph", [0], "글")]
    paragraphs = spark.createDataFrame(rows, "doc_id string, stream string, para long, paragraph_type string, record_indices array<long>, text_decoded string")
    report = json.loads(converting.paragraph_report(paragraphs).first().json)
    assert (report["paragraph_count_all"], report["paragraph_count_text_only"], [p["index"] for p in report["paragraphs"]]) == (2, 1, [0, 1])
    assert report["visible_text_paragraphs"] == [{"index": 0, "paragraph_type": "text_paragraph", "text_decoded": "글"}]


def test_files_are_written_by_many_tasks_and_read_once(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("doc_id"), F.lit("body").alias("region"), F.lit(0).alias("ord"), F.lit("paragraph").alias("kind"), F.array(F.struct(F.lit("one").alias("text"), F.lit(True).alias("bold"), F.lit(10.0).alias("size"))).alias("runs"))
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("alignment", "string"), ("list_kind", "string"), ("list_level", "int"), ("cells", converting.CELLS), ("image", converting.IMAGE))])
    # However few bytes they have, all cores take part.
    written = docx_writer.write_docx(rows).select("doc_id", F.lit("docx").alias("kind"), F.col("docx").alias("content"), F.spark_partition_id().alias("task")).toArrow()
    assert len(set(written["task"].to_pylist())) == 4
    files, read = spark.createDataFrame(written).drop("task"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert converting.docx_documents(files.mapInArrow(seen, files.schema)).count() == 400
    # Once for what is in them, and once for their names.
    assert 400 <= read.value <= 800
