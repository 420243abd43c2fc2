"""Containers of office documents: files to streams, and word-processing files to blocks.

Files come from Spark's binaryFile source, so any store that Spark reads will
do. Each container is opened by one short function over whole files; everything
behind it is DataFrame code.
"""

from __future__ import annotations

import functools
import io
import struct
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.batches import batched

OLE_MAGIC = "D0CF11E0A1B11AE1"
STREAMS = "doc_id string, path string, payload binary"
# Streams that are read, and names of zipped parts that stand for them.
WANTED = ("FileHeader", "DocInfo", "BodyText/Section0")
LOGICAL = {"Contents/header.xml": "FileHeader", "Contents/section0.xml": "BodyText/Section0"}
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path as doc_id, path, kind (ole, hwpx, docx, or null: rejected), content.

    doc_id is the stem, suffix and a hash of the path, as stems may repeat.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return classified(files)


def classified(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    kind = F.when(F.hex(F.substring("content", 1, 8)) == OLE_MAGIC, "ole").when(suffix.isin("hwpx", "docx"), suffix)
    doc = F.concat_ws("_", F.regexp_replace(name, r"\.[A-Za-z]+$", ""), suffix, F.lower(F.hex(F.xxhash64("path"))))
    return files.select(doc.alias("doc_id"), "path", kind.alias("kind"), "content")


def rejects(files: DataFrame) -> DataFrame:
    return files.where("kind is null").select("doc_id", "path", F.lit("unsupported file").alias("reason"))


def ole_entries(read_at):
    """(path, size, function that reads the bytes) of the streams of a compound file, of which read_at(start, n) gives bytes.

    Sector chains, the small streams' own chain, and a tree of names. Only the tables are read until a stream is asked for.
    """
    head = read_at(0, 512)
    if head[:8].hex().upper() != OLE_MAGIC:
        raise ValueError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", head, 30)
    size, small = 1 << shift, 1 << small_shift
    n_fat, first_dir = struct.unpack_from("<I", head, 44)[0], struct.unpack_from("<I", head, 48)[0]
    cutoff, first_small, _, first_more, _ = struct.unpack_from("<5I", head, 56)
    sector = lambda k: read_at((k + 1) * size, size)
    listed = list(struct.unpack_from("<109I", head, 76))
    while first_more < 0xFFFFFFFA:
        more = struct.unpack(f"<{size // 4}I", sector(first_more))
        listed += more[:-1]
        first_more = more[-1]
    fat = [x for k in listed[:n_fat] if k < 0xFFFFFFFA for x in struct.unpack(f"<{size // 4}I", sector(k))]

    def chain(k: int, table: list[int]):
        seen = set()
        while k < 0xFFFFFFFA and k not in seen:
            seen.add(k)
            yield k
            k = table[k]

    read = lambda k: b"".join(map(sector, chain(k, fat)))
    directory, small_fat = read(first_dir), [x[0] for x in struct.iter_unpack("<I", read(first_small))]
    entries = [directory[i : i + 128] for i in range(0, len(directory), 128)]
    name = lambda e: e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16le", "ignore")
    place = lambda e: struct.unpack_from("<IQ", e, 116)
    pool = functools.cache(lambda: read(place(entries[0])[0]))

    def body(first: int, length: int) -> bytes:
        found = b"".join(pool()[i * small : (i + 1) * small] for i in chain(first, small_fat)) if length < cutoff else read(first)
        return found[:length]  # a stream that ends early is as long as it is

    todo, done = [(struct.unpack_from("<I", entries[0], 76)[0], "")], set()
    while todo:
        k, above = todo.pop()
        if k >= len(entries) or k in done:
            continue
        done.add(k)
        e = entries[k]
        left, right, child = struct.unpack_from("<3I", e, 68)
        todo += [(left, above), (right, above)]
        if e[66] == 1:
            todo.append((child, f"{above}{name(e)}/"))
        elif e[66] == 2:
            first, length = place(e)
            length &= 0xFFFFFFFF if shift == 9 else 0xFFFFFFFFFFFFFFFF
            yield above + name(e), length, functools.partial(body, first, length)


def zip_entries(file):
    """(path, size, function that reads the bytes) of the parts of an open zipped file, without folders."""
    z = zipfile.ZipFile(file)
    for i in z.infolist():
        if not i.is_dir():
            yield i.filename, i.file_size, functools.partial(z.read, i)


def ole_streams(data: bytes):
    """(path, bytes) of the streams of a compound file."""
    for path, _, read in ole_entries(lambda start, n: data[start : start + n]):
        yield path, read()


def zip_streams(data: bytes):
    for path, _, read in zip_entries(io.BytesIO(data)):
        yield path, read()


def streams(files: DataFrame, wanted_only: bool = True) -> DataFrame:
    """(doc_id, path, source_path, payload) of compound and zipped files; damaged ones have an error instead.

    path is the logical name. With wanted_only, just what documents are made of.
    """

    def found(frames):
        for frame in frames:
            for doc, kind, content in frame.itertuples(index=False):
                rows = []
                try:
                    for path, payload in (ole_streams if kind == "ole" else zip_streams)(bytes(content)):
                        logical = LOGICAL.get(path, path)
                        if not wanted_only or logical in WANTED or logical.startswith("BinData/"):
                            rows.append((doc, logical, path, payload, None))
                except Exception as e:  # of the file, whatever its damage
                    rows = [(doc, None, None, None, f"{type(e).__name__}: {e}")]
                yield from rows

    def run(frames):
        yield from batched(found(frames), ["doc_id", "path", "source_path", "payload", "error"])

    return files.where("kind in ('ole', 'hwpx')").select("doc_id", "kind", "content").mapInPandas(run, "doc_id string, path string, source_path string, payload binary, error string")


def listing(files: DataFrame) -> DataFrame:
    """(doc_id, path, size) of all streams; order by doc_id and lower(path) to print."""
    return streams(files, wanted_only=False).where("error is null").select("doc_id", F.col("source_path").alias("path"), F.octet_length("payload").cast("long").alias("size"))


BLOCKS = (
    "doc_id string, region string, ord int, kind string, text string, style_id string, style_name string, alignment string, num_id int, ilvl int, "
    "runs array<struct<text:string,bold:boolean,size:double>>, image struct<rel_id:string,name:string,alt:string,cx:long,cy:long,data:binary>, "
    "cells array<struct<row:int,position:int,colspan:int,merge:string,text:string>>, part string, error string"
)
DOCX_COLUMNS = ("doc_id", "region", "ord", "kind", "text", "style_id", "style_name", "alignment", "num_id", "ilvl", "runs", "image", "cells", "part", "error")
NUMBER = ("what", "style_id", "a", "b", "format", "level_text")
NUMBERS = "struct<what:string,style_id:string,a:int,b:int,format:string,level_text:string>"
# Alignments that are kept.
ALIGNMENTS = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right"}


def _part_blocks(root, region: str, names: dict[str, str], media):
    """Rows of the paragraphs, images and tables right below root, in order."""
    value = lambda e, path: (x.get(f"{W}val") if (x := e.find(path)) is not None else None)
    number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
    on = lambda e: None if e is None else e.get(f"{W}val") not in ("0", "false", "none")
    said = lambda r: "".join((t.text or "") if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" for t in r if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))

    def paragraph(p):
        runs = []
        for r in p.iter(f"{W}r"):
            if text := said(r):
                half = number(value(r, f"{W}rPr/{W}sz"))
                runs.append({"text": text, "bold": on(r.find(f"{W}rPr/{W}b")), "size": None if half is None else half / 2})
        return runs

    for child in root:
        if child.tag == f"{W}p":
            style, runs = value(child, f"{W}pPr/{W}pStyle"), paragraph(child)
            text = "".join(r["text"] for r in runs)
            images = []
            for d in child.iter(f"{W}drawing"):
                for blip in d.iter(f"{A}blip"):
                    name, data = media(blip.get(f"{R}embed"))
                    if data is not None:
                        extent, prop = d.find(f".//{WP}extent"), d.find(f".//{WP}docPr")
                        alt = next((prop.get(k) for k in ("descr", "title", "name") if prop is not None and prop.get(k)), None)
                        images.append({"rel_id": blip.get(f"{R}embed"), "name": name, "alt": alt, "cx": number(extent.get("cx")) if extent is not None else None, "cy": number(extent.get("cy")) if extent is not None else None, "data": data})
            num = (number(value(child, f"{W}pPr/{W}numPr/{W}numId")), number(value(child, f"{W}pPr/{W}numPr/{W}ilvl")))
            row = {"kind": "paragraph", "text": text, "style_id": style, "style_name": names.get(style, style), "alignment": ALIGNMENTS.get(value(child, f"{W}pPr/{W}jc")), "num_id": num[0], "ilvl": num[1], "runs": runs}
            is_list = num[0] is not None or (row["style_name"] or "").lower().startswith(("list number", "list bullet"))
            if region == "body" and (text.strip() or is_list or not images) or region != "body" and (text or runs):
                yield row
            yield from ({"kind": "image", "image": i} for i in images)
        elif child.tag == f"{W}tbl":
            cells = []
            for k, tr in enumerate(child.findall(f"{W}tr")):
                for n, tc in enumerate(tr.findall(f"{W}tc")):
                    merge = tc.find(f"{W}tcPr/{W}vMerge")
                    text = "\n".join("".join(r["text"] for r in paragraph(p)) for p in tc.iter(f"{W}p"))
                    cells.append({"row": k, "position": n, "colspan": number(value(tc, f"{W}tcPr/{W}gridSpan")) or 1, "merge": None if merge is None else merge.get(f"{W}val") or "continue", "text": text})
            yield {"kind": "table", "cells": cells}


def _docx_rows(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        held = set(z.namelist())
        tree = lambda n: ElementTree.fromstring(z.read(n)) if n in held else None
        relations = lambda n: {e.get("Id"): (e.get("Type", "").rsplit("/", 1)[-1], e.get("Target", "")) for e in (tree(n) if tree(n) is not None else ())}
        main = relations("word/_rels/document.xml.rels")
        styles = tree("word/styles.xml")
        names = {s.get(f"{W}styleId"): (s.find(f"{W}name").get(f"{W}val") if s.find(f"{W}name") is not None else "") for s in (styles.findall(f"{W}style") if styles is not None else ())}

        def media_of(known):
            def media(rel):
                target = known.get(rel, ("", ""))[1]
                path = target.lstrip("/") if target.startswith("/") else f"word/{target}"
                return (path.rsplit("/", 1)[-1], z.read(path)) if path in held else (None, None)

            return media

        tree("word/numbering.xml")  # damage there is damage of the file
        body = tree("word/document.xml").find(f"{W}body")
        yield from (r | {"region": "body", "part": "word/document.xml"} for r in _part_blocks(body, "body", names, media_of(main)))
        section = next(body.iter(f"{W}sectPr"), None)
        for kind in ("header", "footer"):
            for ref in section.findall(f"{W}{kind}Reference")[:1] if section is not None else ():
                part = main.get(ref.get(f"{R}id"), ("", ""))[1]
                if f"word/{part}" in held:
                    yield from (r | {"region": kind, "part": f"word/{part}"} for r in _part_blocks(tree(f"word/{part}"), kind, names, media_of(relations(f"word/_rels/{part}.rels"))))


def _numbering_rows(data: bytes):
    """What docx_numbering tells of a file: its kind, the style, two numbers, a format and a text; none of a damaged one."""
    rows = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            held = set(z.namelist())
            at = lambda e, k: (x.get(f"{W}val") if (x := e.find(k)) is not None else None)
            number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
            if "word/styles.xml" in held:
                for s in ElementTree.fromstring(z.read("word/styles.xml")).findall(f"{W}style"):
                    rows.append(("style", s.get(f"{W}styleId"), number(at(s, f"{W}pPr/{W}numPr/{W}numId")), number(at(s, f"{W}pPr/{W}numPr/{W}ilvl")) or 0, None, None))
            if "word/numbering.xml" in held:
                root = ElementTree.fromstring(z.read("word/numbering.xml"))
                rows += [("number", None, number(n.get(f"{W}numId")), number(at(n, f"{W}abstractNumId")), None, None) for n in root.findall(f"{W}num")]
                rows += [("format", None, number(a.get(f"{W}abstractNumId")), number(v.get(f"{W}ilvl")), at(v, f"{W}numFmt"), at(v, f"{W}lvlText")) for a in root.findall(f"{W}abstractNum") for v in a.findall(f"{W}lvl")]
    except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError):
        rows = []
    return [r for r in rows if r[2] is not None and r[3] is not None]


def docx_parts(files: DataFrame, numbers: bool = True) -> DataFrame:
    """docx_blocks and, as rows of kind 'number', what numbering_tables takes; each file is read once."""

    def found(frames):
        for frame in frames:
            for doc, content in frame.itertuples(index=False):
                try:
                    rows = [r | {"doc_id": doc, "ord": n} for n, r in enumerate(_docx_rows(bytes(content)))]
                except Exception as e:  # of the file, whatever its damage
                    rows = [{"doc_id": doc, "ord": 0, "error": f"{type(e).__name__}: {e}"}]
                if numbers:
                    rows += [{"doc_id": doc, "kind": "number", "number": dict(zip(NUMBER, r))} for r in _numbering_rows(bytes(content))]
                yield from ([r.get(c) for c in (*DOCX_COLUMNS, "number")] for r in rows)

    def run(frames):
        yield from batched(found(frames), (*DOCX_COLUMNS, "number"))

    return files.where("kind = 'docx'").select("doc_id", "content").mapInPandas(run, f"{BLOCKS}, number {NUMBERS}")


def docx_blocks(files: DataFrame) -> DataFrame:
    """Blocks of zipped word-processing files in the order of each region; a damaged file has a row with its error."""
    return docx_parts(files, numbers=False).drop("number")


def docx_media(files: DataFrame) -> DataFrame:
    """(doc_id, path, payload) of all media of word-processing files, path being word/media/ and the base name; damaged files have none."""

    def found(frames):
        for frame in frames:
            for doc, content in frame.itertuples(index=False):
                try:
                    rows = [(doc, f"word/media/{n.rsplit('/', 1)[-1]}", x) for n, x in zip_streams(bytes(content)) if n.startswith("word/media/")]
                except (zipfile.BadZipFile, zlib.error):
                    rows = []
                yield from rows

    def run(frames):
        yield from batched(found(frames), ["doc_id", "path", "payload"])

    return files.where("kind = 'docx'").select("doc_id", "content").mapInPandas(run, STREAMS)


def docx_numbering(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dimensions that lookups.numbering_kind joins: styles' numbers, numbers' abstract lists, their levels' formats and texts.

    Entries that lack a number are left out. A damaged file has none; docx_blocks gives its error. Each of the three reads the
    files: docx_parts and numbering_tables spare that.
    """
    return numbering_tables(docx_parts(files))


def numbering_tables(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docx_numbering of what docx_parts gave."""
    found = parts.where("kind = 'number'").select("doc_id", "number.*")
    styles = found.where("what = 'style'").select("doc_id", "style_id", F.col("a").alias("num_id"), F.col("b").alias("ilvl"))
    numbers = found.where("what = 'number'").select("doc_id", F.col("a").alias("num_id"), F.col("b").alias("abstract_id"))
    formats = found.where("what = 'format'").select("doc_id", F.col("a").alias("abstract_id"), F.col("b").alias("ilvl"), "format", "level_text")
    return styles, numbers, formats
