"""Exact duplicates: the filter loses nothing, and groups equal those of plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from paperloom.llm import copies


def test_filters_keep_all_and_merge():
    rng = np.random.default_rng(3)
    for bits in (10, 16, 30):
        block = 5
        base = np.uint64(block) << np.uint64(64 - bits)
        parts, want = [], Counter()
        for n in (1, 7, 900, 3000):
            low = rng.integers(0, 1 << min(62, 64 - bits), n, dtype=np.uint64)
            low[: n // 2] = low[: n // 2] % np.uint64(50)
            prints, counts = np.unique(base | low, return_counts=True)
            want.update(dict(zip(prints.tolist(), counts.tolist())))
            back = copies.unpack(copies.pack(prints, counts, bits), block, bits)
            assert back[0].tolist() == prints.tolist() and back[1].tolist() == counts.tolist()
            parts.append(back)
        prints, counts = copies.merged(parts)
        assert dict(zip(prints.tolist(), counts.tolist())) == want and (np.diff(prints.astype(object)) > 0).all()


def plain(rows):
    groups = defaultdict(list)
    told = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, (_, t) in enumerate(rows)}
    for k, (i, _) in enumerate(rows):
        groups[told[k]].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        same = [x for x in groups[told[k]] if x is not None]
        keep = min(same) if same else None
        out.append((i, keep, len(groups[told[k]]), i == keep, hashlib.sha256(told[k].encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(8)
    pool = ["a b", "a  b", "a\nb", " a b", "a b ", "", " ", "\n\t", None, "日本 語", "日本 語", "A b", "x" * 50_000, "x" * 50_000 + " ", "\x1c", "a\x1cb"]
    out = [(i, rng.choice(pool)) for i in range(300)] + [(1000 + i, f"only {i}") for i in range(300)] + [(2000 + i, "hot") for i in range(2500)]
    out += [(2000, "hot"), (5, "a b"), (None, "hot"), (None, "nobody"), (None, "nobody")]
    rng.shuffle(out)
    return out


def test_groups_equal_plain_python_whatever_the_bits(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for bits in (64, 6):
        found = copies.exact_duplicates(docs, bits=bits).collect()
        assert sorted((tuple(r) for r in found), key=repr) == plain(data), bits


def test_empty_table_and_odd_columns(spark):
    assert copies.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a", 1, 2, 3), (2, "a", 1, 2, 3)], "doc_id long, text string, keep_id int, `a.b` int, hash int")
    assert [tuple(r)[:4] for r in copies.exact_duplicates(docs).orderBy("doc_id").collect()] == [(1, 1, 2, True), (2, 1, 2, False)]
