"""Exact substring deduplication with enhanced suffix arrays.

Every string of REPORTED bytes is filed under its anchor, the least hashed
k-gram in it, so equal strings meet. Strings of a text that share an anchor
form one span of text, which goes on to where a string of LENGTH bytes from its last start would
end. Equal spans are combined before anything is shuffled; one copy of each different
span under a repeated anchor goes on. A task sorts the suffixes of whole anchor
groups, scans their common prefixes with a stack, and keeps intervals whose
occurrences can't all be extended to the left by the same byte: maximal repeats,
with all their occurrences. Those of LENGTH bytes are removed; shorter ones of
REPORTED bytes and over 50 words are counted. The spans of an anchor that very many have are
filed anew under their next k-gram, so they are dealt out to several tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, mix, prefix_sums, spread, substring_hash, window_runs
from .common import bitmap_of, in_bitmap, stored, text_of, with_facts

LENGTH = 400
#: Bytes of repeats that are found, and words of those that count as passages, at least.
REPORTED = 240
PASSAGE = 51
KGRAM = 32
#: Bytes of spans that one suffix array covers, or a whole anchor's if they are more.
BATCH = 3_000_000
#: Different spans of one anchor that go to one suffix array; more are filed under their next k-gram.
GROUP = 10_000
ANCHORS = "doc_id long, k1 long, k2 long, anchor long, span long, first long, last long, end long, n long"
COVER = "k1 long, k2 long, start long, end long"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, k1, k2, text): k1 and k2 are alike for equal texts."""
    t = text_of(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), t.alias("text"))


def anchor_runs(data: np.ndarray, offsets: np.ndarray, reported: int, kgram: int):
    """Prefix sums, hashes of all k-grams, and for each run of starts with one anchor its place, first and last start and text."""
    sums = prefix_sums(data)
    at = np.arange(max(0, len(data) - kgram + 1))
    hashes = substring_hash(sums, at, at + kgram)
    place, first, last = window_runs(hashes, reported - kgram + 1, offsets[:-1], offsets[1:] - reported + 1)
    return sums, hashes, place, first, last, np.searchsorted(offsets, first, "right") - 1


def repeated_anchors(rows: DataFrame, reported: int, kgram: int) -> DataFrame:
    """(anchor) of all that occur more than once."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in chunks(batch, "text"):
                _, hashes, place, *_ = anchor_runs(data, offsets, reported, kgram)
                found, n = np.unique(hashes[place], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return rows.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def anchors(rows: DataFrame, length: int, reported: int, kgram: int, bitmap) -> DataFrame:
    """The anchors of each text that the bitmap lets through: a hash of the k-gram and of the span, first and last start, end of the span, occurrences."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                sums, hashes, place, first, last, owner = anchor_runs(data, offsets, reported, kgram)
                fits = in_bitmap(bits, hashes[place])
                place, first, last, owner = place[fits], first[fits], last[fits], owner[fits]
                end = np.minimum(last + length, offsets[owner + 1])
                anchor, span = hashes[place], substring_hash(sums, first, end)
                # In a text of one repeated k-gram each place is an anchor; equal neighbours become one row.
                fresh = np.ones(len(first), bool)
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1]) | (owner[1:] != owner[:-1]) | (first[1:] != last[:-1] + 1)
                lead = np.flatnonzero(fresh)
                n = np.diff(np.concatenate([lead, [len(first)]])).astype(np.int64)
                tail = last[lead + n - 1] if len(lead) else last[:0]
                stop = end[lead + n - 1] if len(lead) else end[:0]
                base = offsets[owner[lead]]
                take = pa.array(owner[lead])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(take) for k in range(3)), pa.array(anchor[lead].view(np.int64)), pa.array(span[lead].view(np.int64)), pa.array(first[lead] - base), pa.array(tail - base), pa.array(stop - base), pa.array(n)],
                    ["doc_id", "k1", "k2", "anchor", "span", "first", "last", "end", "n"],
                )

    return rows.mapInArrow(run, ANCHORS)


def with_partner(rows: DataFrame, partners: DataFrame, drop: bool) -> DataFrame:
    """rows of keyed(); texts whose k1 no partner has are dropped, or else replaced by null, before they are shuffled.

    By a bitmap of fixed size, so that some texts without a partner stay.
    """
    held = bitmap_of(partners.select(F.col("k1").alias("hash")))

    def run(batches):
        bitmap = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            fits = pa.array(in_bitmap(bitmap, batch.column(1).to_numpy().view(np.uint64)))
            if drop:
                yield batch.filter(fits)
            else:
                data = batch.column(3)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pc.if_else(fits, data, pa.scalar(None, data.type)), *batch.columns[4:]], batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in rows.dtypes))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((x & -x).bit_length() - 1) // 8


def maximal_repeats(suffixes: list[bytes], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of sorted suffixes whose left bytes differ.

    left holds the byte before each suffix, or -1 at the start of what is
    known, which differs from all.
    """
    out, stack = [], []  # length, first, left byte or -1 once they differ
    joined = lambda a, b: a if a == b else -1
    for i in range(1, len(suffixes) + 1):
        length = common_prefix(suffixes[i - 1], suffixes[i]) if i < len(suffixes) else 0
        first, byte = i - 1, left[i - 1]
        while stack and stack[-1][0] > length:
            deep, first, other = stack.pop()
            byte = joined(byte, other)
            if byte < 0:
                out.append((deep, first, i - 1))
        if length >= least:
            if stack and stack[-1][0] == length:
                stack[-1][2] = joined(stack[-1][2], byte)
            else:
                stack.append([length, first, byte])
    return out


def repeats_in(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated strings that begin at one of the first starts places of spans that lie one after another: span, start in it, bytes covered."""
    owner = np.repeat(np.arange(len(starts)), starts)
    inside = spread(starts)
    at = offsets[owner] + inside
    order = np.argsort(hashes := substring_hash(prefix_sums(data), at, at + least), kind="stable")
    hashes = hashes[order]
    cut = np.concatenate([[0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1, [len(hashes)]])
    size = np.diff(cut)
    left = np.where(inside > 0, data[at - 1].astype(np.int64), -1)
    ordered = left[order]
    low, high = np.minimum.reduceat(ordered, cut[:-1]), np.maximum.reduceat(ordered, cut[:-1])
    wanted = (size > 1) & ((low < 0) | (low != high))
    chosen = order[np.repeat(wanted, size)]
    held, ends = data.tobytes(), offsets[owner + 1]
    named = sorted((held[at[i] : ends[i]], i) for i in chosen.tolist())
    ids = np.array([i for _, i in named], np.int64)
    cover = np.zeros(len(ids), np.int64)
    for deep, a, b in maximal_repeats([s for s, _ in named], left[ids].tolist(), least):
        np.maximum(cover[a : b + 1], deep, out=cover[a : b + 1])
    ids, cover = ids[cover > 0], cover[cover > 0]
    return owner[ids], inside[ids], cover


def group_batches(batches, size: int):
    """Record batches sorted by their first column, regrouped into tables of whole keys of about size bytes."""
    held, volume = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        while batch.num_rows:
            if volume >= size:
                last = held[-1].column(0)[-1].as_py()
                other = int(np.searchsorted(keys != last, True)) if keys[0] == last else 0
                if other:
                    held.append(batch.slice(0, other))
                if other < batch.num_rows:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, volume = [], 0
                batch, keys = batch.slice(other), keys[other:]
                continue
            held.append(batch)
            volume += batch.nbytes
            batch = batch.slice(batch.num_rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    for _, data, offsets in chunks(pa.RecordBatch.from_arrays([column], ["x"]), "x", 1 << 62):
        return data, offsets


def cover_batch(table: pa.Table, spans: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    begin = table.column("first").to_numpy()[spans] + start
    return pa.RecordBatch.from_arrays([pa.array(table.column(k).to_numpy()[spans]) for k in ("k1", "k2")] + [pa.array(begin), pa.array(begin + size)], ["k1", "k2", "start", "end"])


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, kgram: int = KGRAM, reported: int = REPORTED) -> DataFrame:
    """(k1, k2, start, end): repeated strings of reported bytes and more in texts (by key); ranges may overlap.

    Of strings of length bytes, each that is repeated lies in a range of length bytes or more.
    """
    rows = keyed(docs, doc_id, text)
    again = stored(repeated_anchors(rows, reported, kgram), "again")
    found = stored(anchors(rows, length, reported, kgram, bitmap_of(again.select(F.col("anchor").alias("hash")))).join(again, "anchor", "left_semi"), "anchors")
    rep = F.min(F.struct("doc_id", "k1", "k2", "first", "last", "end"))
    spans = stored(found.groupBy("anchor", "span").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), rep.alias("rep")), "spans")
    repeated = spans.where("n > 1").select("anchor", "span", "rows")
    sure = with_facts(found, repeated, ["anchor", "span"], "k1", n="rows").select("k1", "k2", F.col("first").alias("start"), "end")
    several = spans.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1")
    need = spans.join(several, "anchor").select("anchor", (F.col("spans") > GROUP).alias("hot"), "rep.*")
    need = stored(need.groupBy("doc_id", "k1", "k2").agg(F.collect_list(F.struct("anchor", "hot", "first", "last", "end")).alias("need")), "need")
    texts = with_partner(rows, need, drop=True).alias("r").join(need.alias("n"), F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.k1") == F.col("n.k1")) & (F.col("r.k2") == F.col("n.k2"))).select("r.k1", "r.k2", "r.text", "need")

    def finer(span: np.ndarray, starts: int, anchor: int):
        """The starts of a span by the least k-gram beside the anchor: new anchor, first and last start."""
        at = np.arange(len(span) - kgram + 1)
        hashes = substring_hash(prefix_sums(span), at, at + kgram)
        other = np.where(hashes.view(np.int64) == anchor, np.uint64(0xFFFFFFFFFFFFFFFF), hashes)
        place, first, last = window_runs(other, reported - kgram + 1, np.array([0]), np.array([starts]))
        return mix(other[place] ^ np.int64(anchor).view(np.uint64)), first, last

    def cut(batches):
        for batch in batches:
            for one, data, offsets in chunks(batch, "text"):
                needs = one.column(3)
                flat = needs.flatten()
                owner = np.repeat(np.arange(len(needs)), needs.value_lengths().to_numpy())
                anchor, first, last, end = (flat.field(k).to_numpy() for k in (0, 2, 3, 4))
                hot = flat.field(1).to_numpy(zero_copy_only=False)
                # Of neighbours that were joined, the first string span of the run stands for all.
                last = np.minimum(last, first + reported - kgram)
                end = np.minimum(end, last + length)
                base = offsets[owner]
                held = data.tobytes()
                out: list[tuple] = []
                for o, k, b, f, z, e, h in zip(owner.tolist(), anchor.tolist(), base.tolist(), first.tolist(), last.tolist(), end.tolist(), hot.tolist()):
                    if not h:
                        out.append((k, False, o, f, z - f + 1, held[b + f : b + e]))
                        continue
                    for sub, x, y in zip(*(v.tolist() for v in finer(data[b + f : b + e], z - f + 1, k))):
                        out.append((sub - (1 << 64) if sub >> 63 else sub, True, o, f + x, y - x + 1, held[b + f + x : b + min(e, f + y + length)]))
                columns = list(zip(*out)) if out else [[]] * 6
                take = pa.array(columns[2], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), one.column(0).take(take), one.column(1).take(take), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.binary())],
                    ["anchor", "hot", "k1", "k2", "first", "starts", "span"],
                )

    kind = "anchor long, hot boolean, k1 long, k2 long, first long, starts long, span binary"
    pieces = texts.mapInArrow(cut, kind)

    def scan(batches):
        for held in group_batches(batches, BATCH):
            keys = np.stack([held.column(k).to_numpy() for k in ("anchor", "k1", "k2", "first")])
            order = np.lexsort(keys)
            fresh = np.ones(len(order), bool)
            fresh[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(0)  # rows with equal ids and texts give a span each
            held = held.take(pa.array(order[fresh]))
            data, offsets = bytes_of(held.column("span"))
            yield cover_batch(held, *repeats_in(data, offsets, held.column("starts").to_numpy(), reported))

    if not several.where(F.col("spans") > GROUP).isEmpty():
        pieces = stored(pieces, "pieces")
        hot = pieces.where("hot").withColumn("piece", F.xxhash64("span"))
        place = F.struct("k1", "k2", "first")
        facts = stored(hot.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(place).alias("lead")), "facts")
        ends = hot.select("anchor", "piece", "k1", "k2", F.col("first").alias("start"), (F.col("first") + F.length("span")).alias("end"))
        sure = sure.unionByName(with_facts(ends, facts.where("n > 1").select("anchor", "piece", "n"), ["anchor", "piece"], "k1").select("k1", "k2", "start", "end"))
        one = with_facts(hot, facts, ["anchor", "piece"], "k1").where(place == F.col("lead"))
        pieces = pieces.where("not hot").unionByName(one.select(*pieces.columns))
    whole = pieces.repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(scan, COVER)
    return sure.unionByName(whole)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, kgram: int = KGRAM, kept: bool = True, reported: int = REPORTED) -> DataFrame:
    """Each row of docs without the bytes of strings of length bytes that also start elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans (long), kept_sha256, n_passages (long: stretches that repeats of
    over 50 words and reported bytes cover, removed or not) and kept (binary: what is left, which
    may cut a character), unless kept is False. Equal rows are occurrences of their own, so
    repeated texts of length bytes or more vanish entirely. Null texts are empty; texts under length
    bytes stay whole; very long ones are treated whole; other columns aren't read.
    """
    reported = min(reported, length)
    grouped = covered(docs, doc_id, text, length, kgram, reported).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    ranges = stored(grouped, "ranges")
    rows = keyed(docs, doc_id, text)
    rows = rows.select(*rows.columns, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"), *([F.col("text").cast("binary").alias("whole")] if kept else []))
    rows = with_partner(rows, ranges, drop=False).join(ranges, ["k1", "k2"], "left")
    rows = rows.select("doc_id", "n_bytes", "sha256", F.when(F.col("ranges").isNotNull(), F.col("text")).alias("text"), "ranges", *(["whole"] if kept else []))

    def run(batches):
        space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        for batch in batches:
            out = []
            for d, n, whole, t, ranges, *data in zip(*(c.to_pylist() for c in batch.columns)):
                if ranges is None:
                    out.append((d, n, 0, 0, whole, 0, *data))
                    continue
                held = t.encode()
                gap = space[np.frombuffer(held, np.uint8)]
                begins = np.concatenate([[0], np.cumsum(~gap & np.concatenate([[True], gap[:-1]]))])
                every = [(r["start"], r["end"]) for r in ranges]
                spans = merged([r for r in every if r[1] - r[0] >= length])
                passages = merged([r for r in every if begins[r[1]] - begins[r[0]] >= PASSAGE])
                parts, at = [], 0
                for a, b in spans:
                    parts.append(held[at:a])
                    at = b
                left = b"".join([*parts, held[at:]])
                out.append((d, n, n - len(left), len(spans), hashlib.sha256(left).hexdigest(), len(passages), *([left] if kept else [])))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if kept else []))
            cols = list(zip(*out)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", *(["kept"] if kept else [])])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + (", kept binary" if kept else ""))
