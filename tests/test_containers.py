"""Containers: compound files, zipped files, and documents written and read back."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from paperloom.operators import lookups as lk
from paperloom.operators import windows as wn
from paperloom.sources import containers, docx_writer

PNG = bytes.fromhex("89504e470d0a1a0a0000000d49484452000000010000000108060000001f15c4890000000d49444154789c6360000002000001e221bc330000000049454e44ae426082")


def compound(streams):
    """A small compound file: one table sector, a directory, small and large streams in sectors of 512 bytes."""
    entry = lambda name, kind, left, right, child, first, size: (name + "\0").encode("utf-16le").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(name) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", first, size)
    none, sectors, fat = 0xFFFFFFFF, [], []

    def put(data):
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)] or [bytes(512)]
        first = len(sectors)
        for k, p in enumerate(parts):
            sectors.append(p)
            fat.append(first + k + 1 if k + 1 < len(parts) else 0xFFFFFFFE)
        return first

    small, small_fat, rows = b"", [], []
    for n, (name, data) in enumerate(streams):
        if len(data) < 4096:
            first = len(small) // 64
            count = max(1, -(-len(data) // 64))
            small += data.ljust(64 * count, b"\0")
            small_fat += [first + k + 1 for k in range(count - 1)] + [0xFFFFFFFE]
        else:
            first = put(data)
        rows.append(entry(name, 2, none, n + 2 if n + 1 < len(streams) else none, none, first, len(data)))
    pool, small_table = put(small), put(struct.pack(f"<{len(small_fat)}I", *small_fat).ljust(512, b"\xff"))
    directory = entry("Root Entry", 5, none, none, 1, pool, len(small)) + b"".join(rows)
    where = put(directory.ljust(-(-len(directory) // 512) * 512, b"\0"))
    table = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = bytes.fromhex(containers.OLE_MAGIC) + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<3I", 0, 1, where) + struct.pack("<I", 0) + struct.pack("<5I", 4096, small_table, 1, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", table, *[none] * 108) + b"".join(sectors)


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    return out.getvalue()


def test_streams_of_compound_and_zipped_files(spark, tmp_path):
    held = [("FileHeader", b"HWP".ljust(256, b"\0")), ("DocInfo", b"x" * 5000), ("Other", b"skip"), ("empty", b"")]
    (tmp_path / "a.hwp").write_bytes(compound(held))
    (tmp_path / "b.hwpx").write_bytes(zipped({"Contents/section0.xml": b"<a/>", "BinData/i.png": PNG, "mimetype": b"m"}))
    (tmp_path / "c.hwp").write_bytes(bytes.fromhex(containers.OLE_MAGIC) + b"cut")
    (tmp_path / "d.txt").write_bytes(b"no")
    files = containers.read_files(spark, str(tmp_path))
    found = containers.streams(files)
    good = {(r.path, bytes(r.payload)) for r in found.where("error is null").collect()}
    assert good == {("FileHeader", held[0][1]), ("DocInfo", held[1][1]), ("BodyText/Section0", b"<a/>"), ("BinData/i.png", PNG)}
    assert [r.error is not None for r in found.where("doc_id like 'c_hwp%'").collect()] == [True]
    assert [r.path.rsplit("/", 1)[-1] for r in containers.rejects(files).collect()] == ["d.txt"]
    sizes = containers.listing(files).where("doc_id like 'a_%'").collect()
    assert {(r.path, r.size) for r in sizes} == {(n, len(d)) for n, d in held}


def blocks(spark):
    run = lambda t, b=None, s=None: {"text": t, "bold": b, "size": s}
    cell = lambda r, c, t, cs=1, rs=1: {"row_index": r, "column_index": c, "colspan": cs, "rowspan": rs, "text": t}
    rows = [
        ("d", "header", 0, "paragraph", [run("Head")], None, None, None, None, None),
        ("d", "body", 0, "paragraph", [run("Title", True, 15.0), run(" & more", False)], "center", None, None, None, None),
        ("d", "body", 1, "paragraph", [run("one")], None, "numbered", 0, None, None),
        ("d", "body", 2, "table", None, None, None, None, [cell(0, 0, "a", 2), cell(0, 1, "hidden"), cell(1, 0, "b", 1, 2), cell(1, 1, "c"), cell(2, 1, "d\ne")], None),
        ("d", "body", 3, "image", None, None, None, None, None, {"data": PNG, "width": 4, "height": 5, "alt": "a <dot>"}),
        ("d", "body", 4, "image", None, None, None, None, None, {"data": b"not an image", "width": 4, "height": 5, "alt": ""}),
    ]
    schema = "doc_id string, region string, ord int, kind string, runs array<struct<text:string,bold:boolean,size:double>>, alignment string, list_kind string, list_level int, cells array<struct<row_index:int,column_index:int,colspan:int,rowspan:int,text:string>>, image struct<data:binary,width:int,height:int,alt:string>"
    return spark.createDataFrame(rows, schema)


def test_documents_survive_a_round_trip(spark):
    written = docx_writer.write_docx(blocks(spark)).select("doc_id", F.lit("docx").alias("kind"), F.col("docx").alias("content"))
    found = containers.docx_blocks(written).orderBy("region", "ord").collect()
    body = [r for r in found if r.region == "body"]
    assert [r.kind for r in body] == ["paragraph", "paragraph", "table", "image"]
    assert [(r.text, r.bold, r["size"]) for r in body[0].runs] == [("Title", True, 15.0), (" & more", False, None)]
    assert (body[0].alignment, body[1].style_name) == ("center", "List Number")
    image = body[3].image
    assert (bytes(image.data), image.alt, image.cx, image.cy) == (PNG, "a <dot>", 4 * 9525, 5 * 9525)
    assert [r.text for r in found if r.region == "header"] == ["Head"]
    cells = containers.docx_blocks(written).where("kind = 'table'").select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.*")
    cells = wn.grid_positions(cells, ["doc_id", "row"], ["position"], "colspan")
    cells = wn.merged_rowspans(cells, ["doc_id"], "row", F.col("merge")).where("rowspan is not null").orderBy("row", "column_index")
    assert [(r.row, r.column_index, r.colspan, r.rowspan, r.text) for r in cells.collect()] == [(0, 0, 2, 1, "a"), (1, 0, 1, 2, "b"), (1, 1, 1, 1, "c"), (2, 1, 1, 1, "d\ne")]
    kinds = lk.numbering_kind(containers.docx_blocks(written).where("kind = 'paragraph' and region = 'body'"), *containers.docx_numbering(written)).orderBy("ord").collect()
    assert [r.kind for r in kinds] == [None, "numbered"]


def test_damaged_document(spark):
    bad = spark.createDataFrame([("x", "docx", bytearray(b"PK"))], "doc_id string, kind string, content binary")
    assert containers.docx_blocks(bad).first().error.startswith("BadZipFile")
