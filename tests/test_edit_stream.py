"""The edit log as a stream: late, repeated and restarted batches equal the batch fold."""

import json
import random
import time

from pyspark.sql import functions as F

from paperloom.operators import edits as ed
from paperloom.streaming import edit_log

SCHEMA = "doc_id string, seq long, op string, node_id string, value string"
NAMES = ("emptied", "flips", "size", "told", "text", "odd", "later", "align", "list", "src", "alt")


def random_log(rng, n):
    ops = ("text", "text", "bold", "bold", "size", "align", "list", "src", "alt")
    out = []
    for doc in ("a", "b", "c"):
        for seq in range(1, n + 1):
            op = rng.choice(ops)
            out.append((doc, seq, op, rng.choice(["p1", "p2", "img1"]), {"text": rng.choice(["", f"t{seq}"]), "size": rng.choice([str(seq), "big"]), "bold": None}.get(op, f"v{seq}")))
    return out


def batches(log, rng):
    """The log in files, shuffled over a few, some edits twice."""
    files = [[] for _ in range(5)]
    for e in log:
        files[min(4, max(0, int(e[1] / len(log) * 15) + rng.choice([-1, 0, 1])))].append(e)
    for k in range(1, 5):
        files[k] += rng.sample(files[k - 1], min(10, len(files[k - 1])))
    for f in files:
        rng.shuffle(f)
    return files


def test_stream_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(5)
    log = random_log(rng, 60)
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", edit_log.PROVIDER)
    try:
        for k, rows in enumerate(batches(log, rng)):
            (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(("doc_id", "seq", "op", "node_id", "value"), r))) for r in rows))
            if k in (1, 4):  # stopped and started anew from its checkpoint in between
                stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
                held = edit_log.settled_edits(stream, None).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
                q = held.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
                q.awaitTermination(240)
                assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("kind = 'late'").count() == 0
    last = out.groupBy("doc_id", "node_id").agg(F.max_by(F.struct(*NAMES), "seq").alias("s"), F.max("seq").alias("seq"))
    found = {(r.doc_id, r.node_id): tuple(r.s) for r in last.collect()}
    batch = ed.folded(spark.createDataFrame(log, SCHEMA), ["doc_id", "node_id"])
    want = {(r.doc_id, r.node_id): (*r.did, r.align, r["list"], r.src, r.alt) for r in batch.collect()}
    assert found == want


def test_gaps_are_given_up_and_late_edits_told(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda name, rows: (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps(dict(zip(("doc_id", "seq", "op", "node_id", "value"), r))) for r in rows))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", edit_log.PROVIDER)
    seen = []
    try:
        write("0", [("a", 1, "text", "p1", "one"), ("a", 3, "text", "p1", "three")])
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        q = edit_log.settled_edits(stream, patience_ms=100).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: seen.extend(df.collect())).start()
        until = time.time() + 120
        while time.time() < until and not any(r.text == "three" for r in seen):
            time.sleep(0.5)
        write("1", [("a", 2, "text", "p1", "two"), ("a", 1, "text", "p1", "one"), ("a", 4, "align", "p1", "right")])
        while time.time() < until and not any(r.kind == "late" for r in seen):
            time.sleep(0.5)
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [(r.seq, r.value) for r in seen if r.kind == "late"] == [(2, "two")]
    state = [(r.seq, r.text, r.align) for r in seen if r.kind == "state"]
    assert state == [(1, "one", None), (3, "three", None), (4, "three", "right")]
