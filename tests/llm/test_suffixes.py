"""Substring deduplication against brute force."""

import hashlib
import random

import pytest

from paperloom.llm import suffixes


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    marked = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                marked[d][i : i + length] = b"\1" * length
    out = []
    for b, m in zip(data, marked):
        kept = bytes(x for x, y in zip(b, m) if not y)
        out.append((len(b), sum(m), sum(1 for i, y in enumerate(m) if y and (i == 0 or not m[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "é", "x", "of the", "\n", "zz"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.choice([4, 8, 30]))) for _ in range(8)]
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    out = [None, "", "a", "a" * 300, "ab" * 200, noise(50)]
    for _ in range(50):
        out.append(noise(rng.randrange(30)) + rng.choice(passages) + noise(rng.randrange(30)) + rng.choice(passages)[rng.randrange(10) :] + noise(rng.randrange(5)))
    return out + out[10:14]


@pytest.mark.parametrize(("seed", "length", "kgram", "group", "reported"), [(1, 20, 6, 10_000, 20), (2, 33, 8, 3, 20), (3, 12, 12, 10_000, 12), (4, 40, 6, 1, 11)])
def test_removed_bytes_match_brute_force(spark, monkeypatch, seed, length, kgram, group, reported):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "BATCH", 2000)
    some = texts(seed)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(some)] + [(6, some[6], "k")], "doc_id long, text string, k1 string")
    found = suffixes.deduplicate(docs, length=length, kgram=kgram, reported=reported).collect()
    want = plain([*some, some[6]], length)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted((i, *w) for i, w in zip([*range(len(some)), 6], want))


def test_maximal_repeats_of_a_small_suffix_array():
    text = b"xabcyabczabc"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    found = suffixes.maximal_repeats([text[i:] for i in order], [text[i - 1] if i else -1 for i in order], 2)
    assert [(n, sorted(order[a : b + 1])) for n, a, b in found] == [(3, [1, 5, 9])]


def test_empty_table(spark):
    assert suffixes.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_production_lengths_and_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, short, line = prose(90), prose(62), prose(30)
    some = [prose(200) for _ in range(20)]
    for k in (2, 5, 9):
        some[k] += f" {long} {prose(40)}"
    for k in (3, 7):
        some[k] = f"{prose(20)} {short} {prose(60)}"
    for k in (4, 6, 8):
        some[k] += f" {line} {prose(10)}"
    some += [some[11], "x" * 1000, "ab " * 400, f"{long} {long}"]
    assert len(long.encode()) > 400 > len(short.encode()) > suffixes.REPORTED > len(line.encode())
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    found = {r.doc_id: r for r in suffixes.deduplicate(docs).collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(found.items())] == plain(some, 400)
    assert {i for i, r in found.items() if r.n_passages} == {2, 3, 5, 7, 9, 11, 20, 22, 23}
