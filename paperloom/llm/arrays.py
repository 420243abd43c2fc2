"""Numpy views of Arrow text columns: words, hashes and sliding minima.

Texts are handled as the UTF-8 bytes that Arrow holds, a bounded chunk of rows
at a time, so memory follows the chunk or the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at a time, unless one text is longer.
CHUNK = 1_500_000
MULTIPLIER = 0x9E3779B97F4A7C55


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK):
    """Slices of batch with about size bytes of text, as (slice, data, offsets).

    data is uint8, offsets int64 from 0 with one more entry than rows. The
    column must be without nulls.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, held = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, which spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """MULTIPLIER to the powers 0..n and their inverses, modulo 2 ** 64."""
    if held.get("n", -1) < n:
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        for name, base in (("p", MULTIPLIER), ("q", inverse)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            held[name] = np.cumprod(x)
        held["n"] = n
    return held["p"][: n + 1], held["q"][: n + 1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Of data times powers, with a zero in front; feeds substring_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][:-1], out=out[1:])
    return out


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes start..end, alike for equal strings."""
    return mix((sums[end] - sums[start]) * powers(len(sums) - 1)[1][start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without ASCII white space), and the first word of each text and one past the last."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    gap = space[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = gap
    after = np.ones(len(data) + 1, bool)
    after[:-1] = gap
    before[offsets] = True
    after[offsets] = True
    starts = np.flatnonzero(~gap & before[:-1])
    ends = np.flatnonzero(~gap & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of x[i:i + width]; empty when x is shorter."""
    if len(x) < width:
        return x[:0]
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def window_runs(x: np.ndarray, width: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows x[i:i + width] with their least value in one place: place, first and last start.

    Only starts in the ranges first..last (exclusive, ascending) count, and runs
    stay within a range. Values are compared by their high 32 bits, the leftmost
    of equals wins: the place depends on what the window holds and nothing else.
    """
    high = np.uint64(0xFFFFFFFF00000000)
    least = sliding_min((x & high) | np.arange(len(x), dtype=np.uint64), width)
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    some = last > first
    first, last = first[some], last[some]
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none
    size = last - first
    at = np.repeat(first, size) + spread(size)
    place = place[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    fresh[np.cumsum(size) - size] = True
    begin = np.flatnonzero(fresh)
    return place[begin], at[begin], at[np.concatenate([begin[1:] - 1, [len(at) - 1]])]


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after another."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)
