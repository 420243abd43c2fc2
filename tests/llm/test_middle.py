"""Fill-in-the-middle against a plain version, token by token."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from paperloom.llm import middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    h1, h2, h3, h4 = middle.draw(doc_id)
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, "plain", n, None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:i], tokens[i:j], tokens[j:]))
    if h4 % 100 < 80:
        return doc_id, "spm", n, len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, "psm", n, len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(4)
    words = ["a", "né", "日本語", "\x85", " ", "x" * 40, "<", "<P", "S>", "\x1c", "\0"]
    gaps = [" ", "  ", "\n", "\t\r\n", "\x0b\x0c"]
    out = [None, "", " ", "\n\n", "a", " a", "a ", "w" * 30_000, " " * 30_000, "é" * 20_000 + " b", "a" + " " * 20_000 + "b", "one <P> two", "x <M>", " <S>"]
    shared = " ".join(rng.choice(words[:6]) for _ in range(3000))
    for n in range(150):
        own = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([1, 3, 40, 900])))
        out.append(rng.choice(["", " "]) + own + rng.choice(["", shared, shared + "\n", " " + shared]))
    return out


def test_equals_the_plain_version_and_restores(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts() * 2)] + [(14, texts()[14], "again"), (None, "no id here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    found = middle.fill_in_middle(docs).withColumn("restored", middle.restored()).collect()
    assert sorted([(r.doc_id, r.form, r.n, r.prefix_chars, r.middle_chars, r.output) for r in found], key=repr) == sorted((plain(i, t) for i, t, _ in rows), key=repr)
    assert {r.form for r in found} == {"plain", "spm", "psm"}
    by_id = {i: t or "" for i, t, _ in rows}
    assert all(r.restored == by_id[r.doc_id] for r in found)
    row = middle.digest(middle.fill_in_middle(docs)).where("doc_id = 15").first()
    assert row.restored_sha256 == hashlib.sha256(by_id[15].encode()).hexdigest()


def test_chunks_repeat_and_the_cache_stays_small():
    rng = random.Random(1)
    shared = bytes(rng.randrange(256) for _ in range(40_000))
    docs = [bytes(rng.randrange(256) for _ in range(rng.randrange(500, 3000))) + shared for _ in range(5)]
    known = middle.Summaries(most=30_000)
    chunks = []
    for raw in docs:
        import numpy as np

        at = [p for p in middle.chunk_ends(np.frombuffer(raw, np.uint8)).tolist()]
        ends = middle.bounds(at, 0, len(raw))
        assert ends[-1] == len(raw) and all(b - a <= middle.MOST for a, b in zip([0, *ends], ends))
        chunks.append({raw[a:b] for a, b in zip([0, *ends], ends)})
        for c in chunks[-1]:
            known.of(c)
        assert known.bytes <= 30_000
    assert len(set.intersection(*chunks)) > 10
    assert middle.bounds([], 5, 5) == []


def test_empty_table_and_odd_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, output string, `a.b` int")
    assert middle.digest(middle.fill_in_middle(docs)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "form", 2)], "doc_id long, text string, form string, `a.b` int")
    assert middle.fill_in_middle(docs).select(F.col("n")).first().n == 3
