"""Records to blocks on synthetic streams."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.functions import binary as bn
from paperloom.operators import blocks, lookups
from paperloom.sources import records as rc


def record(tag, level, payload=b""):
    if len(payload) >= 0xFFF:
        return struct.pack("<II", tag | level << 10 | 0xFFF << 20, len(payload)) + payload
    return struct.pack("<I", tag | level << 10 | len(payload) << 20) + payload


def said(text):
    return text.encode("utf-16le")


def paragraph(text):
    return record(66, 0, bytes(24)) + (record(67, 1, said(text)) if text else b"") + record(68, 1, bytes(8))


def cell(row, column, text, colspan=1, rowspan=1):
    return record(72, 2, struct.pack("<12H", 0, 0, 0, 0, column, row, colspan, rowspan, 0, 0, 0, 0)) + record(66, 2, bytes(24)) + record(67, 3, said(text))


def mixed():
    table = record(66, 0, bytes(24)) + record(71, 1, b" lbt") + record(77, 2, struct.pack("<4H", 3, 0, 2, 2)) + cell(0, 0, "가나 합친 칸", colspan=2) + cell(1, 0, "다라 왼쪽") + cell(1, 1, "마바 오른쪽")
    image = record(66, 0, bytes(24)) + record(71, 1, said("그림입니다.\n원본 그림의 이름: a.png\n원본 그림의 크기: 가로 444pixel, 세로 517pixel")) + record(76, 2, bytes(8)) + record(85, 3, bytes(8))
    return paragraph("제목입니다 문서") + paragraph("") + table + paragraph("") + paragraph("두 번째 문단입니다") + image + paragraph("마지막 문단입니다")


def streams(spark, *data):
    return spark.createDataFrame([(f"d{i}", "BodyText/Section0", bytearray(d)) for i, d in enumerate(data)], "doc_id string, stream string, payload binary")


def test_records_keep_the_prefix_of_cut_streams(spark):
    whole = paragraph("첫 번째 문단") + record(67, 1, bytes(5000))
    cuts = [len(whole), len(whole) - 1, len(whole) - 5002, len(whole) - 5006, 3]
    found = rc.split_records(streams(spark, *[whole[:n] for n in cuts])).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == {"d0": 4, "d1": 3, "d2": 3, "d3": 3}
    last = rc.split_records(streams(spark, whole)).orderBy(F.desc("idx")).first()
    assert (last.header_size, last.size, last.tag_id, last.level) == (8, 5000, 67, 1)
    packed = zlib.compressobj(wbits=-15)
    data = packed.compress(whole) + packed.flush()
    frame = spark.createDataFrame([(bytearray(data),), (bytearray(b"\xff\xff"),)], "x binary")
    assert [r[0] for r in frame.select(rc.try_inflate("x")).collect()] == [whole, None]


def test_paragraphs_and_types(spark):
    made = rc.record_texts(rc.split_records(streams(spark, paragraph("제목입니다 문서") + paragraph("") + record(66, 0) + record(71, 1) + record(75, 2))))
    found = rc.paragraphs(made).orderBy("para").collect()
    assert [(r.paragraph_type, r.text_decoded) for r in found] == [("text_paragraph", "제목입니다 문서"), ("empty_paragraph", ""), ("control_paragraph", "")]
    assert found[0].text_raw_hex == said("제목입니다 문서").hex()


def test_body_blocks_in_order(spark):
    found = blocks.body_blocks(rc.split_records(streams(spark, mixed(), paragraph("첫 번째 문단입니다")))).orderBy("doc_id", "block_index").collect()
    one = [r for r in found if r.doc_id == "d0"]
    assert [(r.block_type, r.text) for r in one if r.block_type == "paragraph"] == [("paragraph", "제목입니다 문서"), ("paragraph", "두 번째 문단입니다"), ("paragraph", "마지막 문단입니다")]
    assert [r.block_type for r in one] == ["paragraph", "table", "paragraph", "image", "paragraph"]
    assert [(c.row_index, c.column_index, c.colspan, c.text) for c in one[1].table.cells] == [(0, 0, 2, "가나 합친 칸"), (1, 0, 1, "다라 왼쪽"), (1, 1, 1, "마바 오른쪽")]
    assert (one[1].table.row_count, one[1].table.column_count) == (2, 2)
    image = one[3].image
    assert (image.width, image.height, image.alt_text, image.original_filename) == (444, 517, "그림입니다.", "a.png")
    assert [r.text for r in found if r.doc_id == "d1"] == ["첫 번째 문단입니다"]


def test_header_region_and_page_number(spark):
    field = record(71, 3, b"onta" + bytes(4) + struct.pack("<I", 7))
    data = paragraph("본문 내용입니다") + record(66, 0) + record(71, 1, b"daeh") + record(72, 2) + record(66, 2) + record(67, 3, said("문서 헤더")) + field + record(68, 1)
    found = blocks.regions(rc.split_records(streams(spark, data))).orderBy("idx").select("tag_id", "consumed", "region", bn.page_number(F.col("payload")).alias("n")).collect()
    assert [(r.tag_id, r.consumed, r.region) for r in found][4:] == [(71, True, None), (72, True, None), (66, True, "header"), (67, True, "header"), (71, True, "header"), (68, False, None)]
    assert found[8].n == "7"


def test_styles(spark):
    info = record(25, 0, struct.pack("<8I", 12, 0, 0, 0, 0, 0, 0, 2 << 16)) + record(21, 0, struct.pack("<12I", *[0] * 10, 1300 * 65536, 0x20000)) + record(25, 0, struct.pack("<8I", 4, *[0] * 7))
    para, char = blocks.style_tables(rc.split_records(streams(spark, info)))
    assert [(r.style_ref, r.alignment, r.list_info and tuple(r.list_info)) for r in para.orderBy("style_ref").collect()] == [(0, "center", (2, 0)), (1, "left", None)]
    assert [(r.bold, r.font_size_pt) for r in char.collect()] == [(True, 13.0)]
    body = rc.split_records(streams(spark, record(66, 0, struct.pack("<3I", 0, 0, 1 | 5 << 16)) + record(68, 1, struct.pack("<2I", 0, 9))))
    refs = blocks.style_refs(body, ["doc_id"]).withColumn("style_ref", F.col("para_ref"))
    joined = lookups.style_lookup(refs, para, ["doc_id", "style_ref"]).first()
    assert (joined.para_ref, joined.char_ref, joined.alignment) == (1, 9, "left")
    missing = lookups.style_lookup(refs.withColumn("style_ref", F.col("char_ref")), char, ["doc_id", "style_ref"]).first()
    assert (missing.char_ref, missing.bold) == (9, None)


def test_records_as_a_table_function(spark):
    """Rows stay beside their records, whatever the number; bad arguments fail in analysis."""
    many = b"".join(record(66 + k % 3, k % 4, b"x" * (k % 50)) for k in range(5000))
    streams = spark.createDataFrame([("a", bytearray(many)), ("b", bytearray()), ("c", None), ("d", bytearray(record(67, 1, b"yy") + b"cut"))], "doc_id string, payload binary")
    rc.register_records(spark)
    found = spark.sql("SELECT doc_id, r.* FROM {s} s, LATERAL stream_records(s.payload) r", s=streams)
    want = rc.split_records(streams.selectExpr("doc_id", "'s' AS stream", "payload")).drop("stream")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 5001
    assert spark.sql("SELECT doc_id, count(*) FROM {s} s, LATERAL stream_records(s.payload, 67) r GROUP BY 1 ORDER BY 1", s=streams).collect() == [("a", 1667), ("d", 1)]
    with pytest.raises(Exception, match="binary payload"):
        spark.sql("SELECT * FROM stream_records('text')").collect()


def test_a_table_function_hands_records_on_one_by_one():
    """The first record of a large stream comes before the others are made."""
    import tracemalloc

    stream = b"".join(record(66, 0, bytes(1 << 20)) for _ in range(40))
    tracemalloc.start()
    n = sum(1 for _ in rc.StreamRecords().eval(stream))
    assert n == 40 and tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
