"""Packing: an exact round trip of ids, valid places, few sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paperloom.llm import packing


def test_plan_places_each_rank_once_and_never_overfills():
    rng = random.Random(5)
    for room, n in ((2048, 3000), (100, 500), (7, 40), (2048, 1)):
        sizes = [min(room, 1 + int(rng.expovariate(3 / room))) for _ in range(n)]
        counts = {x: sizes.count(x) for x in set(sizes)}
        rows, used = packing.plan(counts, room)
        assert sorted(x for a, b, _, _ in rows.tolist() for x in range(a, b)) == list(range(n))
        desc = np.sort(sizes)[::-1]
        sequence = np.concatenate([f + np.arange(b - a) // p for a, b, f, p in rows.tolist()])
        filled = np.bincount(sequence, weights=desc, minlength=used)
        assert filled.max() <= room and filled.min() > 0 and len(filled) == used
        assert used <= 1.1 * -(-sum(sizes) // room) + 2


def test_pieces_equal_the_tokenizer_and_fill_sequences(spark):
    rng = random.Random(2)
    words = ["the", "it's", "naïve", "\t", "3.14", "don't", "", "<|endoftext|>", "日本", "a\nb", " ", "x" * 50]
    texts = [None, "", " ", "  lead", "trail ", "a  b", *[" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 300, 3000]))) for _ in range(60)]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(6, texts[6], 1)], "doc_id long, text string, length int")
    found = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in [*enumerate(texts), (6, texts[6])]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    assert sorted(tuple(r)[:5] for r in found) == sorted(want)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    rooms = []  # best-fit decreasing
    for n in sorted((w[3] for w in want), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((2048 if fit is None else fit) - n)
    assert len(by) <= len(rooms)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fast_and_slow_encoders_agree():
    encoder = packing.Encoder(packing.tokenizer_spec())
    assert encoder.fast is not None
    rng = random.Random(9)
    parts = ["'s", "'ll", "'LL", " ", "  ", "\n", "\t", "é", "日本", "😀", "1", "12", "...", "a", "Word", "\x85", " ", "\x1c", "<|endoftext|>", "'", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(20_000)] + ["a" * 20_000, " " * 5000 + "x"]
    fast = encoder.encode(texts)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert fast == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_millions_of_spaces(spark):
    """Runs of white space that the fast encoder's pattern has no room for, in the middle and at the end."""
    encoder = packing.Encoder(packing.tokenizer_spec())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = 2_000_000
    for c in " \t\n\x0b\x0c\r\x85\u3000":
        texts = ["a" + c * n + "b", "a" + c * n]
        assert encoder.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts], repr(c)
    docs = spark.createDataFrame([(1, "a" + " " * n + "b")], "doc_id long, text string")
    assert packing.pack_documents(docs).selectExpr("sum(length)").first()[0] == len(tokenizer.encode("a" + " " * n + "b", add_special_tokens=False).ids) + 1
