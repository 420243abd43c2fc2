"""Packing documents into token sequences by linear grouping and best fit.

Only a histogram of lengths, of one entry for each length up to the sequence
length, reaches the driver. The plan made from it says for ranges of the
ranking by length into which sequences the pieces go; its size is bounded by
the number of lengths, groups and configurations, whatever the corpus holds.
Pieces are ranked, placed and offset by Spark.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import chunks
from .common import stored, text_of

SEQUENCE = 2048
END_ID = 0
#: Pairs of (part, groups) that are planned; the plan with the fewest sequences is used. Lengths over SEQUENCE / part
#: are large and grouped, the others are best-fitted; part 1 leaves all to the best fit, which suits few pieces.
CHOICES = ((2, 32), (3, 16), (4, 16), (1, 1))
# Fixed value: the pre-tokens of a byte-level BPE, in a form without backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: White-space characters in a row from which on a text isn't left to PATTERN, whose matcher holds a million at most.
GAP = 100_000
#: Pieces that are ranked together.
RANKED = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of texts as little-endian uint32 bytes, by a tokenizer's file.

    A byte-level BPE whose ids follow the order of its merges is the same
    function in the tiktoken library, which is several times faster; any other
    file is left to the tokenizers library, and so are texts with a very long
    run of white space, for which that library's pattern has no room. Added
    tokens' strings in a text become those tokens, as the tokenizers library has it.
    """

    def __init__(self, spec: str):
        self.fast, self.spec, self.slow = self.by_ranks(json.loads(spec)), spec, None

    @staticmethod
    def by_ranks(spec: dict):
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocabulary = model["vocab"]
        added = spec.get("added_tokens", ())
        special = {x["content"]: x["id"] for x in added}
        nested = any(a != b and a in b for a in special for b in special)
        if nested or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added):
            return None
        singles = len(vocabulary) - len(merges) - len(special.keys() & vocabulary.keys())
        if singles != 256 or any(vocabulary.get(a + b) != singles + k for k, (a, b) in enumerate(merges)):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def by_library(self, texts: list[str]) -> list[bytes]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.spec)
        return [np.array(e.ids, "<u4").tobytes() for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return self.by_library(texts)
        one = lambda t: self.fast.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False).tobytes()
        return [self.by_library([t])[0] if len(t) >= GAP and re.search(rf"\s{{{GAP}}}", t) else one(t) for t in texts]


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer file's text; by default of the public byte-level BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece of each document: its tokens and END_ID, cut only where longer than sequence.

    Whole texts are encoded, however long and whatever runs they hold. A null text counts as empty and has one token.
    Repeated rows are packed repeatedly.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec or tokenizer_spec())

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(held.value)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for rows, _, _ in chunks(batch, size=1_000_000):
                out: list[tuple] = []
                for d, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist())):
                    ids += end
                    n, at, k = len(ids) // 4, 0, 0
                    step = n % sequence or min(n, sequence)
                    while at < n:
                        out.append((d, k, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)])))
                        at, k, step = at + step, k + 1, sequence
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, PIECES)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits in room and is worth most."""
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    for r in range(int(sizes.min()), room + 1):
        ok = sizes <= r
        value = np.where(ok, best[np.maximum(r - sizes, 0)] + worth, -1.0)
        g = int(value.argmax())
        best[r], took[r] = (value[g], g) if value[g] > best[r - 1] else (best[r - 1], -2)
    pattern, r = np.zeros(len(sizes), int), room
    while r > 0 and took[r] != -1:
        if took[r] == -2:
            r -= 1
        else:
            pattern[took[r]] += 1
            r -= sizes[took[r]]
    return best[room], pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Patterns of sizes and how many bins have each: column generation, rounded down.

    Solves the relaxed covering problem by the revised simplex method, in which
    a knapsack over the dual prices finds each new pattern.
    """
    k = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    for step in range(rounds):
        if step % 40 == 0:
            inverse = np.linalg.inv(basis)
            x = inverse @ demand
        value, pattern = best_pattern(sizes, inverse.sum(0), room)
        if value <= 1 + 1e-7:
            break
        way = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-9, x / way, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        amount = ratio[out]
        x -= amount * way
        x[out] = amount
    found = [(basis[:, j].round().astype(int), int(np.floor(x[j] + 1e-6))) for j in range(k)]
    left = demand.astype(int).copy()
    out = []
    for pattern, n in found:
        if n > 0 and pattern.any():
            n = min(n, int((left[pattern > 0] // pattern[pattern > 0]).min()))
            if n > 0:
                left -= pattern * n
                out.append((pattern, n))
    return out


def plan_of(counts: dict[int, int], room: int, small_part: int, groups: int) -> tuple[np.ndarray, int]:
    """Where pieces go: rows (first rank, end rank, first sequence, ranks per sequence), and the number of sequences.

    Ranks count all pieces, longest first. counts has the pieces of each length.
    """
    lengths = np.array(sorted(counts, reverse=True), dtype=np.int64)
    number = np.array([counts[x] for x in lengths.tolist()], dtype=np.int64)
    edge = np.concatenate([[0], np.cumsum(number)])
    length_at = lambda rank: int(lengths[np.searchsorted(edge, rank, "right") - 1])
    rows: list[tuple[int, int, int, int]] = []
    used = 0
    full = counts.get(room, 0)
    if full:
        rows.append((0, full, 0, 1))
        used = full
    n_large = int(number[lengths > room // small_part].sum()) - full
    bins: list[tuple[int, int, int]] = []  # room left, first sequence, sequences
    rest: list[tuple[int, int]] = []  # rank ranges not yet placed
    if n_large > 0:
        cuts = sorted({full + n_large * g // groups for g in range(groups + 1)})
        starts = np.array(cuts[:-1])
        sizes = np.array([length_at(s) for s in starts])  # rounded up to the longest of the group
        at = starts.copy()
        for pattern, n in configurations(sizes, np.diff(cuts).astype(float), room):
            slots = []  # ranges of n ranks, one of which goes to each sequence
            for g in np.flatnonzero(pattern):
                for _ in range(pattern[g]):
                    slots.append(int(at[g]))
                    at[g] += n
            for s in slots:
                rows.append((s, s + n, used, 1))
            breaks = sorted({0, n} | {int(b - s) for s in slots for b in edge[(edge > s) & (edge < s + n)]})
            for a, b in zip(breaks[:-1], breaks[1:]):
                bins.append((room - sum(length_at(s + a) for s in slots), used + a, b - a))
            used += n
        rest = [(int(a), int(b)) for a, b in zip(at, cuts[1:]) if a < b]
    rest.append((full + n_large, int(edge[-1])))
    free: dict[int, list[tuple[int, int]]] = {}
    for r, first, n in bins:
        free.setdefault(r, []).append((first, n))
    todo = []
    for a, b in rest:  # split at each length
        inner = [a, *edge[(edge > a) & (edge < b)].tolist(), b]
        todo += [(length_at(x), x, y) for x, y in zip(inner[:-1], inner[1:]) if x < y]
    order = SortedRooms(list(free))
    for size, a, b in sorted(todo, reverse=True):
        while a < b:
            r = order.least(size)
            if r is None:
                per = room // size
                first, n, r = used, -(-(b - a) // per), room
                used += n
            else:
                first, n = free[r].pop()
                if not free[r]:
                    del free[r]
                    order.drop(r)
            per = min(r // size, b - a)
            take = min(n, (b - a) // per)
            rows.append((a, a + take * per, first, per))
            a += take * per
            for left, f, m in ((r - per * size, first, take), (r, first + take, n - take)):
                if m and left:
                    if left not in free:
                        order.add(left)
                    free.setdefault(left, []).append((f, m))
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4), used


def plan(counts: dict[int, int], room: int = SEQUENCE, choices: tuple = CHOICES) -> tuple[np.ndarray, int]:
    """The best plan_of for the choices of small_part and groups."""
    return min((plan_of(counts, room, *c) for c in choices), key=lambda x: x[1])


class SortedRooms:
    """Amounts of room that some sequence has left, up to a sequence's length each."""

    def __init__(self, found: list[int]):
        self.rooms = sorted(found)

    def least(self, size: int) -> int | None:
        i = int(np.searchsorted(self.rooms, size)) if self.rooms else 0
        return self.rooms[i] if i < len(self.rooms) else None

    def add(self, r: int) -> None:
        self.rooms.append(r)
        self.rooms.sort()

    def drop(self, r: int) -> None:
        self.rooms.remove(r)


def pack(found: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces with sequence_id and offset: gapless, and sequence tokens at most.

    Pieces of one length are interchangeable. They are ranked within hash
    buckets, whose sizes are summed up, so no task ranks all of a length.
    """
    found = stored(found, "pieces")
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one for each length at most
    if not counts:
        return found.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows, _ = plan(counts, sequence)
    buckets = 1 + sum(counts.values()) // RANKED
    longer, before = {}, 0
    for x in sorted(counts, reverse=True):
        longer[x], before = before, before + counts[x]
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "bucket", earlier.alias("earlier"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = dealt.withColumn("place", place).join(sizes, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("place") - 1).alias("rank"))

    def run(batches):
        keys = np.array(sorted(longer), np.int64)
        base = np.array([longer[k] for k in keys.tolist()], np.int64)
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy() + base[np.searchsorted(keys, length)]
            row = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + (rank - row[:, 0]) // row[:, 3])], [*batch.schema.names[:5], "sequence_id"])

    placed = ranked.mapInArrow(run, PIECES + ", sequence_id long")
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of docs with their places; null texts are empty, repeated rows are packed repeatedly."""
    return pack(pieces(docs, doc_id, text, spec, sequence), sequence)
