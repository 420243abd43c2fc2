"""Exact duplicates by counting quotient filters and a comparison of bytes.

Each task builds a counting quotient filter of its documents' 64-bit
fingerprints: the leading bits are a block, the next ones a quotient that is a
place in a bitmap, and the rest a remainder that is kept in sorted runs with
its count. Nothing is lost in it, so filters of a block merge as sorted runs
do, whatever task they come from. Only documents whose fingerprint counts more
than once are compared, by all the bytes of their normalised texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks
from .common import bitmap_of, discard, in_bitmap, stored, text_of, with_facts

#: Bits of a quotient and, at most, of a remainder, which takes six bytes; what is left of 64 bits is the block.
QUOTIENT, REMAINDER = 6, 48
#: Documents of a block, about, and fingerprints of one filter.
BLOCK, FILTER = 200_000, 4_000_000


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each run of ASCII white space as one space, as bytes and offsets."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    keep = np.ones(len(data), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return np.where(gap, np.uint8(32), data)[keep], place[offsets]


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """SHA-256 of each text; the first bytes are its fingerprint."""
    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def leading(codes: list[bytes], bits: int) -> np.ndarray:
    """The first bits of each code, as the high bits of a uint64."""
    out = np.frombuffer(b"".join(c[:8] for c in codes), ">u8").astype(np.uint64)
    return out >> np.uint64(64 - bits) << np.uint64(64 - bits)


def pack(prints: np.ndarray, counts: np.ndarray, block_bits: int) -> bytes:
    """A block's filter, of ascending different fingerprints and their counts.

    Which quotients occur, where the run of each ends, the remainders, which of
    them count more than once, and those counts.
    """
    low = 64 - block_bits - QUOTIENT
    quotient = (prints >> np.uint64(low) & np.uint64((1 << QUOTIENT) - 1)).astype(np.int64)
    occupied = np.zeros(1 << QUOTIENT, bool)
    occupied[quotient] = True
    run_end = np.ones(len(prints), bool)
    run_end[:-1] = quotient[1:] != quotient[:-1]
    rest = (prints & np.uint64((1 << low) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REMAINDER // 8]
    more = counts > 1
    return b"".join((np.array([len(prints)], "<u8").tobytes(), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), np.packbits(more).tobytes(), rest.tobytes(), counts[more].astype("<u8").tobytes()))


def unpack(packed: bytes, block: int, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints and counts that pack was given."""
    low, size = 64 - block_bits - QUOTIENT, REMAINDER // 8
    n = int(np.frombuffer(packed, "<u8", 1)[0])
    at, flags = 8, (n + 7) // 8
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, (1 << QUOTIENT) // 8, at)))
    at += (1 << QUOTIENT) // 8
    run_end, more = (np.unpackbits(np.frombuffer(packed, np.uint8, flags, at + k * flags))[:n].astype(bool) for k in range(2))
    at += 2 * flags
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :size] = np.frombuffer(packed, np.uint8, n * size, at).reshape(n, size)
    counts = np.ones(n, np.uint64)
    counts[more] = np.frombuffer(packed, "<u8", -1, at + n * size)
    quotient = occupied[np.cumsum(run_end) - run_end].astype(np.uint64)
    return np.uint64(block) << np.uint64(64 - block_bits) | quotient << np.uint64(low) | rest.view("<u8")[:, 0], counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of several filters with their counts added."""
    prints, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def repeated_prints(prints: DataFrame, n: int) -> DataFrame:
    """(hash, n) of the fingerprints (column hash, long) that count more than once; n rows in all.

    As many blocks are made that each holds about BLOCK documents, 1,024 at least.
    """
    block_bits = min(32, max(64 - QUOTIENT - REMAINDER, int(np.ceil(np.log2(max(1, n / BLOCK))))))

    def build(batches):
        def filters(held):
            found = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            counts = np.diff(np.concatenate([first, [len(found)]]))
            found = found[first]
            block = (found >> np.uint64(64 - block_bits)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            ends = [*edge[1:].tolist(), len(found)]
            for i in range(0, len(edge), 4096):
                some = list(zip(edge[i : i + 4096].tolist(), ends[i : i + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array([int(block[a]) for a, _ in some], pa.int64()), pa.array([pack(found[a:b], counts[a:b], block_bits) for a, b in some], pa.binary())], ["block", "filter"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            size += len(held[-1])
            if size >= FILTER:
                yield from filters(held)
                held, size = [], 0
        if size:
            yield from filters(held)

    def merge(key, rows):
        block = key[0].as_py()
        found, counts = merged([unpack(x, block, block_bits) for x in rows.column("filter").to_pylist()])
        more = counts > 1
        return pa.table({"hash": found[more].view(np.int64), "n": counts[more].astype(np.int64)})

    return prints.select("hash").mapInArrow(build, "block long, filter binary").groupBy("block").applyInArrow(merge, "hash long, n long")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row.

    Texts are equal if their bytes are, after each run of ASCII white space
    became one space; a null text is empty. keep_id is the smallest id of the
    equal texts, null only if none has an id. Ids are taken to be unique: of
    rows repeated with the smallest id each is kept, and each counts. Very long
    texts are compared whole; other columns aren't read, and no rows give none.
    bits are those of a fingerprint; fewer make more work and the same result.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("text"))

    def hashed(batches):
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                codes = fingerprints(*normalised(data, offsets))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(leading(codes, bits).view(np.int64)), pa.array(codes, pa.binary())], ["doc_id", "hash", "code"])

    prints = stored(narrow.mapInArrow(hashed, "doc_id long, hash long, code binary"), "prints")
    repeated = stored(repeated_prints(prints, prints.count()), "repeated")
    held = bitmap_of(repeated)

    def routed(batches):
        bitmap = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                data, offsets = normalised(data, offsets)
                prints = leading(fingerprints(data, offsets), bits)
                some = np.flatnonzero(in_bitmap(bitmap, prints))
                whole = data.tobytes()
                told = [whole[a:b] for a, b in zip(offsets[some].tolist(), offsets[some + 1].tolist())]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(some)), pa.array(prints[some].view(np.int64)), pa.array(told, pa.binary())], ["doc_id", "hash", "told"])

    # Equal texts are combined before they are shuffled, so a text with very many copies comes once from each task.
    texts = narrow.mapInArrow(routed, "doc_id long, hash long, told binary").groupBy("hash", "told").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = stored(texts.where("n > 1").select(F.unhex(F.sha2("told", 256)).alias("code"), "keep_id", "n", F.col("n").alias("size")), "groups")
    discard(repeated)
    found = with_facts(prints, groups, ["code"], "doc_id", "left")
    return found.select("doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), (F.col("size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("code")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)
"""
