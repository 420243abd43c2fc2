"""Edits on trees against a replay of the log on plain Python documents."""

import copy
import json
import random

from pyspark.sql import functions as F

from paperloom.operators import editor
from paperloom.operators import edits as ed
from tests.test_editor import document

OPS = ("text", "text", "text", "bold", "bold", "size", "align", "list", "insert", "insert", "delete", "src", "alt")


def as_document(rng):
    run = lambda t: {"kind": "text", "text": t, "character_style": {"bold": rng.random() < 0.5, "font_size_pt": rng.choice([None, 9.0, 12.0])}}
    blocks = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.choice(["paragraph", "paragraph", "paragraph", "table", "image"])
        if kind == "paragraph":
            blocks.append({"block_type": kind, "text_runs": [run(f"r{k}") for k in range(rng.randrange(3))]})
        elif kind == "table":
            blocks.append({"block_type": kind, "rows": [{"cells": [{"text": rng.choice(["", "cell"]), "row_index": 0, "column_index": k, "colspan": 1, "rowspan": 1} for k in range(2)]}]})
        else:
            blocks.append({"block_type": kind, "binary_stream_ref": "BinData/a.png", "alt_text": "x"})
    return {"blocks": blocks}


def tops_of(rows):
    """A plain document: a list of blocks in order, from the rows of a tree."""
    rows = sorted(rows, key=lambda r: r.path)
    out = []
    for r in rows:
        depth = [x for i, x in enumerate(r.path) if i and x < ed.BEHIND]
        if not depth:
            out.append({"id": r.node_id, "type": r.type, "align": r.align, "list": r.list, "level": r.level, "src": r.src, "alt": r.alt, "kids": [], "cells": []})
        elif r.type == "text" and len(depth) == 1:
            out[-1]["kids"].append([r.node_id, r.text, r.bold, r.size])
        elif r.type == "paragraph":
            out[-1]["cells"].append({"id": r.node_id, "kids": []})
        elif r.type == "text":
            out[-1]["cells"][-1]["kids"].append([r.node_id, r.text, r.bold, r.size])
    return out


def replay(tops, log):
    for seq, op, node, value in sorted(log, key=lambda e: e[0]):
        at = next((k for k, b in enumerate(tops) if b["id"] == node), None)
        block = tops[at] if at is not None else None
        top = block if block and block["type"] == "paragraph" else None
        if op == "text":
            for p in [top] if top else [c for b in tops for c in b["cells"] if c["id"] == node]:
                marks = p["kids"][0][2:] if p["kids"] else [False, None]
                p["kids"] = [[p["kids"][0][0] if p["kids"] else None, value, *marks]] if value else []
        elif op == "bold" and top:
            on = not (top["kids"] and all(k[2] for k in top["kids"]))
            for k in top["kids"]:
                k[2] = on
        elif op == "size" and top:
            for k in top["kids"]:
                k[3] = float(value)
        elif op == "align" and top:
            top["align"] = value
        elif op == "list" and top:
            top["list"], top["level"] = value, None if value == "none" else 0
        elif op == "insert" and top and value not in [b["id"] for b in tops]:
            tops.insert(at + 1, {"id": value, "type": "paragraph", "align": "left", "list": "none", "level": None, "src": None, "alt": None, "kids": [[None, "", False, None]], "cells": []})
        elif op == "delete" and top:
            del tops[at]
        elif op in ("src", "alt") and block and block["type"] == "image":
            block[op] = value
    return tops


def nameless(tops, known):
    for b in tops:
        for p in [b, *b["cells"]]:
            p["kids"] = [[i if i in known else None, *rest] for i, *rest in p["kids"]]
    return tops


def test_random_logs_equal_a_replay(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    for d in range(30):
        (tmp_path / f"d{d}.json").write_text(json.dumps(as_document(rng)))
    docs = editor.read_documents(spark, f"{tmp_path}/*.json")
    tree = editor.nodes(docs)
    rows = tree.collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    edits, want, known = [], {}, {}
    for doc, held in by.items():
        ids, log, made = [r.node_id for r in held if r.type in ("paragraph", "image")] + ["p999"], [], 0
        for seq in rng.sample(range(1, 500), 60):
            op = rng.choice(OPS)
            log.append((seq, op, rng.choice(ids + [f"p{100 + k}" for k in range(made)]), {"text": rng.choice(["", "t%d" % seq]), "size": str(seq), "list": rng.choice(["none", "bullet", "numbered"]), "insert": f"p{100 + made}"}.get(op, f"v{seq}")))
            made += op == "insert"
        known[doc] = {r.node_id for r in held}
        want[doc] = nameless(replay(copy.deepcopy(tops_of(held)), log), known[doc])
        edits += [(doc, *e) for e in log + log[:10]]
    rng.shuffle(edits)
    log = spark.createDataFrame(edits, "doc_id string, seq long, op string, node_id string, value string").repartition(3)
    for run in (ed.RUN, 7):
        monkeypatch.setattr(ed, "RUN", run)
        out = ed.apply_edits(tree, log)
        assert out.columns == tree.columns
        found = {}
        for r in out.collect():
            found.setdefault(r.doc_id, []).append(r)
        for doc in want:
            ids = [r.node_id for r in found.get(doc, [])]
            assert len(ids) == len(set(ids))
            assert nameless(tops_of(found.get(doc, [])), known[doc]) == want[doc], doc
    # The tree that was edited is edited again, and becomes blocks in the same order.
    twice = ed.apply_edits(out, spark.createDataFrame([(d, 1, "insert", "p100", "q1") for d in want] + [(d, 2, "text", "q1", "again") for d in want], "doc_id string, seq long, op string, node_id string, value string"))
    back = {}
    for r in editor.blocks_of_nodes(twice, editor.blocks(docs)).orderBy("doc_id", "ord").collect():
        back.setdefault(r.doc_id, []).append((r.ord, r.block.block_type, "".join(x.text for x in r.block.text_runs or [])))
    for doc, tops in want.items():
        told = [(b["type"], "".join(k[1] for k in b["kids"])) for b in tops]
        for k, b in enumerate(tops):
            if b["id"] == "p100":
                told.insert(k + 1, ("paragraph", "again"))
        assert [x[1:] for x in back.get(doc, [])] == told and [x[0] for x in back.get(doc, [])] == list(range(len(told)))


def test_what_an_edit_shows(spark, tmp_path):
    """The operations one by one on the tree of a document: text, bold, size, align, list, insert, delete, image."""
    (tmp_path / "d.json").write_text(json.dumps(document()))
    docs = editor.read_documents(spark, str(tmp_path / "d.json"))
    tree = editor.nodes(docs)

    def after(*log):
        edits = spark.createDataFrame([("d.json", k, *e) for k, e in enumerate(log)], "doc_id string, seq long, op string, node_id string, value string")
        return ed.apply_edits(tree, edits)

    out = after(("text", "p1", "New"), ("bold", "p1", None), ("text", "p3", "cell"), ("insert", "p1", None), ("text", "p6", "six"), ("size", "p6", "9"), ("align", "p6", "right"), ("list", "p5", "bullet"), ("bold", "p3", None), ("src", "img1", "x.png"))
    found = editor.blocks_of_nodes(out, editor.blocks(docs)).orderBy("ord").collect()
    assert [r.block.block_type for r in found] == ["paragraph", "paragraph", "table", "paragraph", "image"]
    first, second, cells = found[0].block, found[1].block, [c.text for r in found[2].block.rows for c in r.cells]
    assert (first.text, first.text_runs[0].character_style.bold, first.text_runs[0].character_style.font_size_pt) == ("New", False, 15.0)
    assert (second.text, second.text_runs[0].character_style.font_size_pt, second.paragraph_style.alignment) == ("six", 9.0, "right")
    assert cells == ["A", "cell", "C"] and found[3].block.list_info.kind == "bulleted" and found[4].block.binary_stream_ref == "x.png"
    # Text that was empty for a while has no marks, and text1 isn't used again.
    kids = after(("text", "p1", ""), ("bold", "p1", None), ("text", "p1", "x")).where("type = 'text' AND text = 'x'").first()
    assert (kids.node_id, kids.bold, kids["size"]) == ("text5", False, None)
    assert after(("delete", "p1", None), ("insert", "p1", None)).where(F.size("path") == 1).count() == tree.where(F.size("path") == 1).count() - 1
    assert [tuple(r) for r in ed.first_paragraphs(after(("delete", "p1", None))).collect()] == [("d.json", "p5")]
    view = {r.node_id: r for r in ed.paragraphs(tree).collect()}
    assert (view["p1"].text, view["p1"].bold, view["p1"]["size"], view["p5"].text, view["p5"].bold) == ("Title", True, 15.0, "", False)
    assert after().count() == tree.count() and ed.apply_edits(tree.limit(0), spark.createDataFrame([("d", 1, "bold", "p1", None)], "doc_id string, seq long, op string, node_id string, value string")).count() == 0
