"""Drafts: replayed, late and equal ones change nothing; the table equals a fold in plain Python."""

import datetime
import json
import random

from pyspark.sql import functions as F

from paperloom.streaming import drafts as dr

SCHEMA = "key string, saved_at timestamp, document string"


def at(k):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k)


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    rng = random.Random(3)
    path = str(tmp_path / "table")
    batches = [[(rng.choice("abc"), at(rng.randrange(100)), rng.choice(["x", "y", None])) for _ in range(8)] for _ in range(4)] + [[(None, at(1), "z"), ("d", None, "z")]]
    held = {}
    for k, rows in enumerate(batches):
        dr.upsert(spark.createDataFrame(rows, SCHEMA), path, "s", k)
        for key in {r[0] for r in rows if r[0] and r[1]}:
            new = max((r[1], dr_digest(r[2]), r[2]) for r in rows if r[0] == key and r[1])
            if key not in held or (new[0] > held[key][0] and new[1] != held[key][1]):
                held[key] = new
        found = {r.key: (r.saved_at, r.digest, r.document) for r in dr.current_drafts(spark, path).collect()}
        assert found == held
    for k in (1, 3):
        dr.upsert(spark.createDataFrame(batches[k], SCHEMA), path, "s", k)
    assert {r.key: (r.saved_at, r.digest, r.document) for r in dr.current_drafts(spark, path).collect()} == held


def dr_digest(text):
    import hashlib

    return hashlib.sha256((text or "").encode()).hexdigest()


def test_a_stream_of_drafts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda t, label, at_, doc: {"source_type": t, "label": label, "saved_at": str(at_), "document": doc}
    files = [[row("docx", "a b.docx", at(1), "one"), row("docx", "a b.docx", at(3), "three")], [row("docx", "a b.docx", at(2), "two"), row("hwp", "é(1)!", at(5), "five")], [row("hwp", "é(1)!", at(9), "five")]]
    for k, rows in enumerate(files):
        (tmp_path / f"in/{k}.json").write_text("\n".join(map(json.dumps, rows)))
    raw = spark.readStream.schema("source_type string, label string, saved_at timestamp, document string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    told = raw.select(dr.draft_key("source_type", "label").alias("key"), "saved_at", "document")
    q = dr.save_drafts(told, str(tmp_path / "table"), "s", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {r.key: (r.saved_at, r.document) for r in dr.current_drafts(spark, str(tmp_path / "table")).collect()}
    assert found == {f"{dr.PREFIX}:docx:a%20b.docx": (at(3), "three"), f"{dr.PREFIX}:hwp:%C3%A9(1)!": (at(5), "five")}
    rows = dr.with_digest(spark.createDataFrame([("k", at(k), t) for k, t in enumerate("aabba")], SCHEMA))
    assert [r.document for r in dr.changes(rows).orderBy("saved_at").collect()] == ["a", "b", "a"]
    assert spark.createDataFrame([("a~b*c'd",)], "t string").select(dr.encoded(F.col("t"))).first()[0] == "a~b*c'd"
