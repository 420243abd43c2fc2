"""Streams of compound files to whole documents, and small helpers of the editor."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import editor, importing
from tests.test_blocks import cell, record, said


def paragraph(text, para_ref=0, char_ref=0):
    return record(66, 0, struct.pack("<3I", 0, 0, para_ref)) + (record(67, 1, said(text)) if text else b"") + record(68, 1, struct.pack("<2I", 0, char_ref))


def docinfo():
    chars = [struct.pack("<12I", *[0] * 10, 1000 * 65536, 0x20000), struct.pack("<12I", *[0] * 10, 1200 * 65536, 0)]
    paras = [struct.pack("<8I", 4, *[0] * 7), struct.pack("<8I", 12, *[0] * 6, 3 << 16 | 1)]
    return b"".join([*(record(21, 1, c) for c in chars), *(record(25, 1, p) for p in paras)])


def region(name, *texts, field=None):
    out = record(71, 1, name) + record(72, 2, bytes(8)) + record(66, 2, struct.pack("<3I", 0, 0, 1))
    out += b"".join(record(67, 3, said(t)) for t in texts)
    if field is not None:
        out += record(71, 3, b"onta" + bytes(4) + struct.pack("<I", field))
    return out + record(68, 3, struct.pack("<2I", 0, 1))


def body():
    table = record(66, 0, bytes(24)) + record(71, 1, b" lbt") + record(77, 2, struct.pack("<4H", 2, 0, 1, 2)) + cell(0, 0, "왼쪽 칸입니다") + cell(0, 1, "오른쪽 칸입니다")
    first = record(66, 0, struct.pack("<3I", 0, 0, 0)) + region(b"daeh", "옛날 머리말") + region(b"daeh", "새로운 머리말") + region(b"toof", "쪽 번호는 ", field=7)
    return first + paragraph("목록 하나입니다", 1) + paragraph("목록 둘입니다", 1, 1) + paragraph("보통 문단입니다", 0, 9) + table + paragraph("다시 목록입니다", 1)


def file(doc, packed, head=None):
    def pack(data):
        squeezed = zlib.compressobj(wbits=-15)
        return squeezed.compress(data) + squeezed.flush() if packed else data

    head = struct.pack("<32sII", b"document", 5 << 24, int(packed)) + bytes(216) if head is None else head
    rows = [(doc, "DocInfo", pack(docinfo())), (doc, "BodyText/Section0", pack(body())), (doc, "BinData/x.png", b"x")]
    return rows + ([(doc, "FileHeader", head)] if head != b"" else [])


def test_streams_become_documents_with_styles_lists_and_regions(spark):
    rows = [r for d, packed in (("a", False), ("b", True)) for r in file(d, packed)]
    streams = spark.createDataFrame([(d, p, bytearray(x)) for d, p, x in rows], "doc_id string, path string, payload binary")
    found = {r.doc_id: r for r in importing.import_documents(streams).collect()}
    assert set(found) == {"a", "b"} and found["a"].blocks == found["b"].blocks
    blocks = [b for b in found["a"].blocks if b.block_type == "table" or b.text]
    assert [b.block_type for b in blocks] == ["paragraph"] * 3 + ["table", "paragraph"]
    one, two, plain, table, again = blocks
    assert [b.text for b in (one, two, plain, again)] == ["목록 하나입니다", "목록 둘입니다", "보통 문단입니다", "다시 목록입니다"]
    assert [b.list_info and (b.list_info.kind, b.list_info.numbering_ref, b.list_info.level, b.list_info.marker_text) for b in (one, two, plain, again)] == [("numbered", 3, 1, "1."), ("numbered", 3, 1, "2."), None, ("numbered", 3, 1, "1.")]
    assert [b.paragraph_style.alignment for b in (one, two, plain)] == ["center", "center", "left"]
    assert [tuple(b.text_runs[0].character_style) for b in (one, two, plain)] == [(True, 10.0, 0), (False, 12.0, 1), (None, None, 9)]
    assert [[c.text for c in r.cells] for r in table.rows] == [["왼쪽 칸입니다", "오른쪽 칸입니다"]]
    header, footer = found["a"].header.blocks, found["a"].footer.blocks
    assert [b.text for b in header] == ["새로운 머리말"] and header[0].paragraph_style.alignment == "center"
    assert [b.text for b in footer] == ["쪽 번호는 7"]
    assert [(r.kind, r.text, r.field_type, r.resolved_text) for r in footer[0].text_runs] == [("text", "쪽 번호는 ", None, None), ("field", "", "page_number", "7")]
    tree = editor.nodes(importing.import_documents(streams))
    assert tree.where("type = 'paragraph' and size(path) = 1 and list = 'numbered'").count() == 6


def test_headers_of_files(spark):
    rows = [r for d, h in (("short", bytes(39)), ("small", bytes(40)), ("none", b""), ("whole", bytes(256))) for r in file(d, False, h)]
    found = {(r.doc_id, r.stream): r for r in importing.opened(spark.createDataFrame([(d, p, bytearray(x)) for d, p, x in rows], "doc_id string, path string, payload binary")).collect()}
    assert {k: r.error for k, r in found.items() if r.error} == {("short", None): "file header under 40 bytes", ("none", None): "no file header"}
    assert found["small", "DocInfo"].warning == "file header under 256 bytes" and found["whole", "DocInfo"].warning is None
    assert importing.import_documents(spark.createDataFrame([], "doc_id string, path string, payload binary")).count() == 0


def test_damaged_streams_fail_one_file(spark):
    packed = lambda x: zlib.compress(x)[2:-4]
    good = [(d, p, x if p == "FileHeader" else packed(x)) for d, p, x in file("good", False, bytes(36) + b"\x01" + bytes(219))]
    bad = [("bad", p, x if p == "FileHeader" else b"\xff\xfe damaged") for _, p, x in good]
    image = [("good", "BinData/a.png", b"\x89PNG\r\n\x1a\n raw"), ("good", "BinData/b.png", packed(b"\x89PNG\r\n\x1a\n packed")), ("good", "BinData/c.ole", b"nothing")]
    streams = spark.createDataFrame([(d, p, bytearray(x)) for d, p, x in good + bad + image], "doc_id string, path string, payload binary")
    assert {(r.doc_id, r.stream) for r in importing.import_errors(streams).collect()} == {("bad", p) for _, p, _ in bad if p in ("DocInfo", "BodyText/Section0")}
    assert [r.doc_id for r in importing.import_documents(streams).collect()] == ["good"]
    assert {r.path: bytes(r.data[8:]) for r in importing.embedded_images(streams).collect()} == {"BinData/a.png": b" raw", "BinData/b.png": b" packed"}


def test_dump_summary(spark):
    rows = [("d", "b", bytearray(b"xy")), ("d", "A", bytearray())]
    found = importing.dump_summary(spark.createDataFrame(rows, "doc_id string, path string, payload binary")).first().json
    said = json.loads(found)
    assert said["stream_count"] == 2 and [(s["path"], s["size"]) for s in said["streams"]] == [("A", 0), ("b", 2)]


def test_edited_cells_keep_what_the_original_knows(spark):
    text = {"block_type": "table", "row_count": 1, "column_count": 2, "rows": [{"source_index": 4, "cells": [{"text": t, "row_index": 0, "column_index": k, "colspan": 1, "rowspan": 1, "source_record_index": 40 + k, "raw": f"r{k}"} for k, t in enumerate("xy")]}]}
    docs = spark.createDataFrame([("d", json.dumps([text]))], "doc_id string, j string").select("doc_id", F.from_json("j", f"array<{editor.BLOCK}>").alias("blocks"))
    part = F.lit(None).cast(f"struct<blocks:array<{editor.BLOCK}>>")
    docs = docs.select("doc_id", F.lit(None).cast("string").alias("source_path"), part.alias("header"), part.alias("footer"), "blocks")
    back = editor.blocks_of_nodes(editor.nodes(docs), editor.blocks(docs)).first().block
    assert back.rows[0].source_index == 4
    assert [(c.text, c.source_record_index, c.raw) for c in back.rows[0].cells] == [("x", 40, "r0"), ("y", 41, "r1")]


@pytest.mark.parametrize(("source", "loads"), [("/a.png", True), ("./a", True), ("../a", True), ("http://x", True), ("https://x", True), ("data:image/png", True), ("a/b.png", False), ("", False), (None, False)])
def test_sources_that_load(spark, source, loads):
    assert spark.createDataFrame([(source,)], "s string").select(tx.loads_in_browser("s")).first()[0] is loads
