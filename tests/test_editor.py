"""Documents to trees and back, edits, and streaming."""

import json

from pyspark.sql import functions as F

from paperloom.operators import edits as ed
from paperloom.operators import editor
from paperloom.streaming import ingest


def document():
    run = lambda t, **k: {"kind": "text", "text": t, "character_style": {"bold": k.get("bold"), "font_size_pt": k.get("size"), "style_ref": 4}}
    cell = lambda r, c, t, cs=1: {"text": t, "row_index": r, "column_index": c, "colspan": cs, "rowspan": 0}
    return {
        "source_path": "BodyText/Section0",
        "header": {"blocks": [{"block_type": "paragraph", "text_runs": [{"kind": "field", "text": "", "resolved_text": "7"}]}]},
        "blocks": [
            {"block_type": "paragraph", "source_index": 3, "paragraph_style": {"alignment": "center", "style_ref": 2}, "text_runs": [run("Title", bold=True, size=15.0), run("")]},
            {"block_type": "table", "row_count": 2, "column_count": 2, "rows": [{"cells": [cell(0, 0, "A", 2)]}, {"cells": [cell(1, 0, "B"), cell(1, 1, "C")]}]},
            {"block_type": "mystery"},
            {"block_type": "paragraph", "is_empty": True, "text_runs": [run("")], "list_info": {"kind": "numbered", "level": 0, "numbering_ref": 2, "marker_text": "1."}},
            {"block_type": "image", "binary_stream_ref": "BinData/BIN0001.png", "width": "12", "height": 517, "alt_text": "x"},
        ],
    }


def load(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(document()))
    return editor.read_documents(spark, str(tmp_path / "d.json"))


def test_json_and_visible_blocks(spark, tmp_path):
    docs = load(spark, tmp_path)
    found = json.loads(editor.to_json(docs).first().json)
    assert found["blocks"][4]["width"] is None and found["blocks"][4]["height"] == 517
    assert [b["block_type"] for b in found["visible_text_blocks"]] == ["paragraph", "table", "mystery", "image"]
    assert found["footer"] is None and found["block_count"] == 5
    assert [r[0] for r in docs.select(editor.shape_of(F.to_json(F.struct("blocks")))).collect()] == ["document"]


def test_tree_and_back(spark, tmp_path):
    docs = load(spark, tmp_path)
    tree = editor.nodes(docs)
    order = [(r.node_id, r.text) for r in tree.orderBy("path").collect()]
    assert order == [("p1", None), ("text1", "Title"), ("t1", None), ("tr1", None), ("tc1", None), ("p2", None), ("text2", "A"), ("tr2", None), ("tc2", None), ("p3", None), ("text3", "B"), ("tc3", None), ("p4", None), ("text4", "C"), ("p5", None), ("img1", None)]
    back = {r.ord: r.block for r in editor.blocks_of_nodes(tree, editor.blocks(docs)).collect()}
    assert [(back[k].block_type, back[k].text) for k in sorted(back)] == [("paragraph", "Title"), ("table", None), ("paragraph", ""), ("image", None)]
    assert (back[0].source_index, back[0].paragraph_style.style_ref, back[0].text_runs[0].character_style.bold, back[0].text_runs[0].character_style.style_ref) == (3, 2, True, 4)
    assert [(c.text, c.row_index, c.column_index, c.colspan, c.rowspan) for r in back[1].rows for c in r.cells] == [("A", 0, 0, 2, 1), ("B", 1, 0, 1, 1), ("C", 1, 1, 1, 1)]
    assert (back[2].list_info.kind, back[2].list_info.numbering_ref, back[2].is_empty) == ("numbered", 2, True)
    assert (back[3].binary_stream_ref, back[3].width, back[3].height) == ("BinData/BIN0001.png", None, 517)
    assert editor.image_warnings(editor.blocks_of_nodes(tree).where("block.block_type = 'image'")).count() == 0


def test_edits(spark):
    nodes = spark.createDataFrame([("d", "p1", [0], "paragraph", "one", False, None, "left", None, None, None), ("d", "p2", [1], "paragraph", "two", True, None, "left", None, None, None), ("d", "p3", [2], "paragraph", "three", False, None, "left", None, None, None)], "doc_id string, node_id string, path array<bigint>, type string, text string, bold boolean, size string, align string, list string, alt string, src string")
    log = [(1, "text", "p1", "uno"), (2, "bold", "p1", None), (3, "bold", "p2", None), (4, "insert", "p1", "p4"), (5, "insert", "p1", "p5"), (6, "text", "p4", "late"), (7, "delete", "p3", None), (8, "align", "p2", "right"), (9, "text", "p1", "eins"), (10, "size", "p1", "12")]
    edits = spark.createDataFrame([("d", *e) for e in log], "doc_id string, seq long, op string, node_id string, value string")
    found = ed.apply_edits(nodes, edits).orderBy("path").collect()
    assert [(r.node_id, r.text, r.bold, r.align, r["size"]) for r in found] == [("p1", "eins", True, "left", "12"), ("p5", "", False, "left", None), ("p4", "late", False, "left", None), ("p2", "two", False, "right", None)]
    assert [(r.prefix, r.next_id) for r in ed.next_ids(nodes).collect()] == [("p", 4)]


def test_files_arrive_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(b"same")
    (tmp_path / "in/b.docx").write_bytes(b"same")
    (tmp_path / "in/c.hwpx").write_bytes(b"other")
    q = ingest.arriving_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.kind for r in spark.table("arrived").collect()) == ["docx", "hwpx"]


def test_nodes_read_the_documents_once(spark):
    part = f"struct<blocks:array<{editor.BLOCK}>>"
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.from_json(F.lit('{"block_type":"image","alt_text":"a"}'), editor.BLOCK).alias("block"))
    docs = rows.groupBy("doc_id").agg(F.collect_list("block").alias("blocks")).select("doc_id", F.lit(None).cast(part).alias("header"), F.lit(None).cast(part).alias("footer"), "blocks")
    tree = editor.nodes(docs)
    assert "collect_list" not in tree._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in tree.select("doc_id", "node_id", "alt").collect()) == [(k, "img1", "a") for k in range(3)]
