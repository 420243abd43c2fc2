"""Fingerprints and components against plain Python."""

import random
import re

import xxhash

from paperloom.llm import simhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    h = [xxhash.xxh64_intdigest(" ".join(p).encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(7)
    some = ["Ärger", "the", "Of", "on", "wordwordwordwordwordwordword", "x", "éé", "a" * 40, "tail"]
    base = [" ".join(rng.choice(some) for _ in range(rng.choice([1, 2, 3, 4, 30, 400]))) for _ in range(60)]
    near = [re.sub(r"\bthe\b", "thy", t, count=1) for t in base[:30]]
    return [None, "", " \n\t ", "one", "one two", "ONE  TWO\nthree", "one two three", "é" * 5000, "w " * 70_000, *base, *near, *base[:5]]


def test_fingerprints_and_components_match_plain_python(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    found = {r.doc_id: r for r in simhash.digest(simhash.near_duplicates(docs)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in found.items()} == plain_components(prints)


def test_split_tiles_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    rng = random.Random(3)
    prints = {i: rng.getrandbits(8) | rng.choice([0, 1 << 40, 7 << 50]) for i in range(200)}
    least = {}
    for i, p in prints.items():
        least.setdefault(p, i)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in least], "fp long")
    edges = simhash.links(frame)
    from paperloom.llm.common import components

    found = {r.node: r.root for r in components(edges).collect()}
    want = plain_components({p: p for p in least})
    groups = {}
    for p in least:
        groups.setdefault(found.get(p, p), set()).add(p)
    expected = {}
    for p, r in want.items():
        expected.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(twice).collect()] == [5, 5, 5]


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(5, "a b c d", 1, 2, "x"), (5, "a b c d", 1, 2, "x"), (3, "a b c d", 1, 2, "y"), (8, None, 1, 2, "z"), (9, "", 1, 2, "z"), (None, "q r s t u", 1, 2, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int, _n int, row string")
    found = simhash.one_of_each(docs)
    assert found.columns == docs.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id in (3, 8)").collect()))
    assert simhash.one_of_each(docs.limit(0)).count() == 0
