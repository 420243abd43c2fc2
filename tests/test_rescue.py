"""Documents whose fields deviate from their types."""

import json

from paperloom.operators import editor, rescue
from tests.test_editor import document


def of(spark, *docs, **k):
    rows = [(f"d{i}", d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return rescue.documents_of_json(spark.createDataFrame(rows, "doc_id string, json string"), **k).orderBy("doc_id").collect()


def test_documents_that_fit_are_as_before(spark, tmp_path):
    held = document()
    held["blocks"][4]["width"] = 12
    held["blocks"][4]["raw"] = {"replacement_data_url": "data:image/png;base64,AA=="}
    (tmp_path / "d.json").write_text(json.dumps(held, separators=(",", ":")))
    plain = editor.read_documents(spark, str(tmp_path / "d.json")).drop("doc_id")
    found = rescue.read_documents(spark, str(tmp_path / "d.json"))
    assert found.select(plain.columns).first().asDict(True) == plain.first().asDict(True)
    assert found.first().rescued == [] and found.drop("rescued", "doc_id").schema.simpleString() == plain.schema.simpleString()


def test_one_value_costs_its_own_field_only(spark):
    held = document()
    held["header"] = "none"
    held["blocks"][0]["text_runs"][0]["character_style"]["bold"] = "yes"
    held["blocks"][1]["rows"][0] = 7
    held["blocks"].append([1])
    held["blocks"][0]["paragraph_style"] = []
    held["blocks"][3]["source_index"] = 2**40
    held["source_path"] = 5
    r = of(spark, held)[0]
    assert {(x.path, x.expected, x.found, x.value) for x in r.rescued} == {
        ("$.header", "OBJECT", "STRING", '"none"'), ("$.source_path", "STRING", "BIGINT", "5"), ("$.blocks[4].width", "INT", "STRING", '"12"'), ("$.blocks[5]", "OBJECT", "ARRAY", "[1]"),
        ("$.blocks[0].text_runs[0].character_style.bold", "BOOLEAN", "STRING", '"yes"'), ("$.blocks[1].rows[0]", "OBJECT", "BIGINT", "7"), ("$.blocks[0].paragraph_style", "OBJECT", "ARRAY", "[]"), ("$.blocks[3].source_index", "INT", "BIGINT", str(2**40)),
    }
    assert r.header is None and r.source_path == "5" and len(r.blocks) == 6 and r.blocks[5] is None
    run = r.blocks[0].text_runs[0]
    assert (run.text, run.character_style.bold, run.character_style.font_size_pt, r.blocks[0].paragraph_style, r.blocks[0].source_index) == ("Title", None, 15.0, None, 3)
    assert r.blocks[1].rows[0] is None and [c.text for c in r.blocks[1].rows[1].cells] == ["B", "C"]


def test_nothing_malformed_and_unknown(spark):
    found = of(spark, None, "", "{", "[]", "{}", {"blocks": None}, '{"blocks":[],"blocks":[]}', {"more": {"x": [1]}, "blocks": [{"odd.name": None, "block_type": "image"}]}, unknown=True)
    told = [[(x.path, x.expected, x.found, x.value) for x in r.rescued] for r in found]
    bad = lambda text: [("$", "OBJECT", "MALFORMED", text)]
    assert told[:7] == [[], bad(""), bad("{"), [("$", "OBJECT", "ARRAY", "[]")], [], [], bad('{"blocks":[],"blocks":[]}')]
    assert sorted(told[7]) == sorted([("$.more", None, "OBJECT", '{"x":[1]}'), ("$.blocks[0].odd.name", None, "VOID", "null")], key=lambda t: t[0])
    assert all(r.blocks in (None, []) for r in found[:7])
