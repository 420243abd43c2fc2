"""Blocks written as zipped word-processing files, one row per document.

blocks: doc_id, region, ord, kind and, by kind, runs (text, bold, size), alignment,
list_kind, list_level; cells (row_index, column_index, colspan, rowspan, text);
image (data, width, height, alt). What is hidden under another cell's span, and
images without supported bytes, are left out.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import binary as bn
from paperloom.operators import sweeps as sw

NS = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" '
    'xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
)
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Documents whose blocks are Python objects at a time.
FILES = 64
STYLES = {"numbered": "ListNumber", "bullet": "ListBullet"}


def _run(r: dict) -> str:
    props = ("" if r["bold"] is None else "<w:b/>" if r["bold"] else '<w:b w:val="0"/>') + ("" if r["size"] is None else f'<w:sz w:val="{round(2 * r["size"])}"/>')
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(r["text"])}</w:t></w:r>'


def _paragraph(b: dict) -> str:
    style = STYLES.get(b["list_kind"]) if not b["list_level"] else None
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:jc w:val="{"both" if b["alignment"] == "justify" else b["alignment"]}"/>' if b["alignment"] else "")
    return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}{"".join(_run(r) for r in b["runs"] or () if r["text"])}</w:p>'


def _table(cells: list[dict]) -> str:
    """Rows of cells; below a cell that spans rows stand cells that continue it."""
    width = max((c["column_index"] + c["colspan"] for c in cells), default=0)
    height = max((c["row_index"] + c["rowspan"] for c in cells), default=0)
    grid: dict[tuple[int, int], tuple[dict, bool]] = {}
    for c in cells:
        for k in range(int(c["rowspan"])):
            grid[c["row_index"] + k, c["column_index"]] = (c, k > 0)
    out = []
    for r in range(height):
        row, at = [], 0
        while at < width:
            c, below = grid.get((r, at), ({"colspan": 1, "rowspan": 1, "text": ""}, False))
            merge = '<w:vMerge/>' if below else '<w:vMerge w:val="restart"/>' if c["rowspan"] > 1 else ""
            span = f'<w:gridSpan w:val="{c["colspan"]}"/>' if c["colspan"] > 1 else ""
            text = "" if below else c["text"] or ""
            said = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in text.split("\n"))
            row.append(f"<w:tc><w:tcPr>{span}{merge}</w:tcPr>{said}</w:tc>")
            at += c["colspan"]
        out.append(f'<w:tr>{"".join(row)}</w:tr>')
    return f'<w:tbl><w:tblPr/><w:tblGrid>{"<w:gridCol/>" * width}</w:tblGrid>{"".join(out)}</w:tbl>'


def _image(n: int, i: dict) -> str:
    alt = quoteattr(i["alt"] or "")
    size = f'cx="{9525 * int(i["width"] or 96)}" cy="{9525 * int(i["height"] or 96)}"'
    return f'<w:p><w:r><w:drawing><wp:inline><wp:extent {size}/><wp:docPr id="{n}" name="Picture {n}" descr={alt} title={alt}/><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic><pic:blipFill><a:blip r:embed="rIdM{n}"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'


def _docx(blocks: list[dict]) -> bytes:
    media, parts = [], {"header": [], "body": [], "footer": []}
    for b in blocks:
        if b["kind"] == "paragraph":
            parts[b["region"]].append(_paragraph(b))
        elif b["kind"] == "table" and b["region"] == "body":
            parts["body"].append(_table(sw.kept(b["cells"] or [])))
        elif b["kind"] == "image" and b["region"] == "body" and b["image"]["data"]:
            media.append(bytes(b["image"]["data"]))
            parts["body"].append(_image(len(media), b["image"]))
    kinds = [k for k in ("header", "footer") if parts[k]]
    refs = "".join(f'<w:{k}Reference w:type="default" r:id="rId{k}"/>' for k in kinds)
    relations = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/{k}" Target="{k}1.xml"/>' for k in kinds)
    relations += "".join(f'<Relationship Id="rIdM{n}" Type="{OFFICE}/image" Target="media/image{n}.png"/>' for n in range(1, len(media) + 1))
    relations += f'<Relationship Id="rIdS" Type="{OFFICE}/styles" Target="styles.xml"/>'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="List {s[4:]}"/></w:style>' for s in STYLES.values())
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml."
    types = "".join(f'<Override PartName="/word/{p}.xml" ContentType="{kind}{t}+xml"/>' for p, t in [("document", "document.main"), ("styles", "styles"), *((f"{k}1", k) for k in kinds)])
    package = "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'{HEAD}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>{types}</Types>',
        "_rels/.rels": f'{HEAD}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{HEAD}<Relationships xmlns="{package}/relationships">{relations}</Relationships>',
        "word/document.xml": f'{HEAD}<w:document {NS}><w:body>{"".join(parts["body"])}<w:sectPr>{refs}</w:sectPr></w:body></w:document>',
        "word/styles.xml": f"{HEAD}<w:styles {NS}>{styles}</w:styles>",
    } | {f"word/{k}1.xml": f'{HEAD}<w:{"hdr" if k == "header" else "ftr"} {NS}>{"".join(parts[k])}</w:{"hdr" if k == "header" else "ftr"}>' for k in kinds}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
        for n, data in enumerate(media, 1):
            z.writestr(zipfile.ZipInfo(f"word/media/image{n}.png"), data)
    return out.getvalue()


def write_docx(blocks: DataFrame) -> DataFrame:
    """(doc_id, docx): the file of each document. Equal blocks give equal bytes."""
    cells = F.when(F.col("kind") == "table", F.array_sort("cells"))
    image = F.when(bn.is_image(F.col("image.data")), F.col("image"))
    row = F.struct("ord", "region", "kind", "runs", "alignment", "list_kind", "list_level", cells.alias("cells"), image.alias("image"))
    usable = F.filter("blocks", lambda b: (b["kind"] != "image") | b["image"].isNotNull())
    # Files take much work for their bytes, so their tasks aren't merged by bytes.
    spark = blocks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    whole = blocks.repartition(tasks, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("blocks")).select(F.col("doc_id").cast("string").alias("doc_id"), usable.alias("blocks"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, FILES):
                some = batch.slice(lo, FILES)
                files = [_docx(x) for x in some.column("blocks").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(files, pa.binary())], ["doc_id", "docx"])

    return whole.mapInArrow(run, "doc_id string, docx binary")
