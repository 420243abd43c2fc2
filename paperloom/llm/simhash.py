"""SimHash near-duplicates: fingerprints and their tiled exact comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, words
from .common import components, discard, stored, text_of, with_facts

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints in a tile at most; larger groups are split into several tiles.
TILE = 2048
# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def stir(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return rotate(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the byte strings data[start:start + length], all at once."""
    whole = (1 << 64) - 1
    lanes = [np.uint64(x & whole) for x in (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))]
    short = np.uint64(seed + int(P5) & whole)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    read8 = lambda at: np.ascontiguousarray(eights[at]).view("<u8").ravel()
    out = np.empty(len(start), np.uint64)
    order = np.argsort(length, kind="stable")
    length_sorted = length[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(length_sorted)) + 1, [len(order)]]) if len(order) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        rows, n = order[lo:hi], int(length_sorted[lo])
        at = start[rows]
        left = n
        if n >= 32:
            acc = [np.full(len(rows), x, np.uint64) for x in lanes]
            while left >= 32:
                for k in range(4):
                    acc[k] = stir(acc[k], read8(at + 8 * k))
                at, left = at + 32, left - 32
            h = rotate(acc[0], 1) + rotate(acc[1], 7) + rotate(acc[2], 12) + rotate(acc[3], 18)
            for a in acc:
                h = (h ^ stir(np.zeros_like(a), a)) * P1 + P4
        else:
            h = np.full(len(rows), short, np.uint64)
        h = h + np.uint64(n)
        while left >= 8:
            h = rotate(h ^ stir(np.zeros_like(h), read8(at)), 27) * P1 + P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = rotate(h ^ ((read8(at) & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at, left = at + 4, left - 4
        for _ in range(left):
            h = rotate(h ^ (padded[at].astype(np.uint64) * P5), 11) * P1
            at = at + 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def majority(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each range first..last of hashes, the bits that over half of them have."""
    out = np.zeros(len(first), np.uint64)
    full = np.flatnonzero(last > first)
    if not len(full):
        return out
    size = last[full] - first[full]
    # Sixteen-bit lanes hold counts up to 65,535, so long ranges are cut.
    parts = -(-size // 65_535)
    owner = np.repeat(np.arange(len(full)), parts)
    begin = np.concatenate([np.arange(a, b, 65_535) for a, b in zip(first[full], last[full])]) if parts.max() > 1 else first[full]
    lanes = np.uint64(0x0001000100010001)
    bits = np.zeros(len(full), np.uint64)
    lead = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    for j in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & lanes, begin)
        for k in range(4):
            total = np.add.reduceat((sums >> np.uint64(16 * k)) & np.uint64(0xFFFF), lead)
            bits |= (2 * total.astype(np.int64) > size).astype(np.uint64) << np.uint64(j + 16 * k)
    out[full] = bits
    return out


def fingerprint_chunk(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint for each text."""
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts, ends, first = words(lower, offsets)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.uint64)
    # The words with one space after each, so that every shingle is contiguous.
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    inside = np.zeros(len(lower) + 1, np.int32)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    joined = np.full(at[-1], 32, np.uint8)
    slots = np.ones(at[-1], bool)
    slots[at[1:] - 1] = False
    joined[slots] = lower[np.cumsum(inside[:-1]).astype(bool)]
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(n_shingles)])
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    head = first[:-1][owner] + np.arange(edge[-1]) - edge[:-1][owner]
    tail = head + np.minimum(n_words[owner], SHINGLE)
    return majority(xxh64(joined, at[head], at[tail] - 1 - at[head]), edge[:-1], edge[1:])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): a 64-bit SimHash of each row's word shingles.

    A null or wordless text has fingerprint zero; fp is the signed long.
    text_key is xxhash64 of doc_id and text.
    """

    def run(batches):
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(fingerprint_chunk(data, offsets).view(np.int64))], ["doc_id", "text_key", "fp"])

    t = text_of(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), t).alias("text_key"), t.alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


def star(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within radius between two tiles, thinned to a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    step = max(1, 2_000_000 // max(1, len(right)))
    pairs = []
    for i in range(0, len(left), step):
        near = np.bitwise_count(left[i : i + step, None] ^ right[None, :]) <= radius
        a, b = np.nonzero(near)
        for x, y in zip(left[i + a].view(np.int64).tolist(), right[b].view(np.int64).tolist()):
            if x != y and (not same or x < y):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    pairs.append((x, y))
    out = np.array(pairs, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (fp long) as all pairs within radius would.

    Population counts of the four 16-bit quarters key the tiles. Two
    fingerprints within radius have quarter counts that differ by radius in
    sum at most, so a tile meets only tiles with such keys; all other pairs of
    tiles are skipped. Keys with more than TILE fingerprints are split by
    hash into several tiles, each of which meets the others.
    """
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    keyed = fps.select("fp", *[quarter(k).alias(f"q{k}") for k in range(4)])
    qs = [f"q{k}" for k in range(4)]
    sizes = stored(keyed.groupBy(*qs).agg(F.count("*").alias("n"), F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "sizes")
    placed = with_facts(keyed, sizes, qs, "fp").select("fp", *qs, F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    # The quarters' counts, of 0 to 16 each, and the part make the number of a tile.
    tile = lambda qs, part: (((qs[0] * 17 + qs[1]) * 17 + qs[2]) * 17 + qs[3]).cast("long") * F.lit(1 << 32) + part
    tiles = placed.groupBy(*qs, "part").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    tiles = stored(tiles.select(tile([F.col(q) for q in qs], F.col("part")).alias("tile"), *qs, "part", "fps"), "tiles")
    steps = [(a, b, c, d) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) for c in range(-radius, radius + 1) for d in range(-radius, radius + 1) if abs(a) + abs(b) + abs(c) + abs(d) <= radius and (a, b, c, d) >= (0, 0, 0, 0)]
    away = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(s)]) for s in steps])).alias("d")
    named = tiles.select("tile", *qs)
    left = named.select(F.col("tile").alias("ltile"), *qs, away).select("ltile", *[(F.col(q) + F.col(f"d.d{k}")).alias(q) for k, q in enumerate(qs)])
    # Pairs of tiles are found by number and dealt out before their fingerprints are fetched.
    home = F.shiftright("ltile", 32) == F.shiftright("tile", 32)
    pairs = left.join(named, qs).where(~home | (F.col("ltile") <= F.col("tile"))).select("ltile", "tile")
    met = pairs.join(tiles.select(F.col("tile").alias("ltile"), F.col("fps").alias("lfps")), "ltile").join(tiles.select("tile", "fps"), "tile")
    met = met.select("lfps", "fps", (F.col("ltile") == F.col("tile")).alias("same"))

    def run(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                x, y = (batch.column(k)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
                u, v = star(x, y, batch.column(2)[i].as_py(), radius)
                a.append(u)
                b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) for each row of docs.

    root is a fingerprint of the component.
    component_id is the smallest doc_id that can be reached over links of up
    to radius differing bits, the row's own included; null ids count only
    where a component has no other. Null and wordless texts share fingerprint
    zero and are linked like any other. Repeated rows are returned repeatedly.
    """
    prints = stored(fingerprints(docs, doc_id, text), "prints")
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = components(links(fps.select("fp"), radius))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k")), "least")
    named = stored(with_facts(rooted, least, ["root"], "fp", n="k").select("fp", "root", "component_id", "n"), "named")
    discard(fps, rooted, least)
    return with_facts(prints, named, ["fp"], "text_key").select("doc_id", "text_key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id; all columns stay, whatever their names.

    Among rows with this id the text with the smallest key stays, and of
    rows with equal id and text any one. Null, empty and wordless texts are one component
    and keep one row, very long texts are read whole, an empty table stays empty.
    """
    key = F.xxhash64(F.col(f"`{doc_id}`"), text_of(F.col(f"`{text}`")))
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = near_duplicates(plain).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = found.groupBy("root").agg(F.min("text_key").alias("key")).select("key").distinct()
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return keyed.join(keep, "key", "left_semi").dropDuplicates(["key"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
